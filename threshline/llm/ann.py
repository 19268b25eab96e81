"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors by hash order), so
its centres are a bounded broadcast; every vector is then assigned to a leaf.
A query walks the tree through a priority queue, best bin first: a bin's
promise is its centre's product with the query and ``SPREADS`` standard
deviations of its vectors along it. The query goes on visiting leaves until the best
bin left is a margin below its first leaf or a number of leaves is met, but never
before k + 1 candidates are counted. Margin and number are calibrated: on
``CALIBRATE`` queries, brute force over all vectors gives the true neighbours,
and of the pairs whose mean recall reaches the target the one with the fewest
visits is taken (all leaves, and so exact, if nothing less does). A query in a
dense cluster so visits few leaves, one far from all centres many. A leaf's
vectors are compared with the queries that visit it only.

Equal vectors are one entry with their k + 1 smallest ids, among candidates and
among queries: exact, as no query can use more. Leaves are packed into, or cut into,
bins of about ``BLOCK`` vectors, each met by at most ``BLOCK`` queries at once.

Cases: vectors that are null, all zero, or hold a null or non-finite component
take no part, nor do those of another length than the commonest (ties: the
longer); a null vec_id takes no part; rows that repeat a vec_id count as the
query's own for it and as one candidate if the vector is the same; an empty
table gives an empty result; columns beyond id and vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.llm.common import materialize

#: Vectors that the tree is fitted on, at most.
SAMPLE = 20_000
#: Queries that recall is calibrated on, at most.
CALIBRATE = 128
#: Standard deviations of a bin's vectors by which its promise lies above its centre's.
SPREADS = 2.0
#: Vectors, and queries, that one task compares at once.
BLOCK = 4096


class Tree:
    """Nodes with centres; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 8, seed: int = 3) -> None:
        self.centres: list[np.ndarray] = [sample.mean(0)]
        self.children: list[list[int]] = [[]]
        spread = lambda own: float(np.sqrt(((own - own.mean(0)) ** 2).mean()))
        spreads = [spread(sample)]
        rng, size = np.random.default_rng(seed), max(1, len(sample) // max(1, leaves))
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            if len(own) <= size or leaves <= 1:
                continue
            part = _kmeans(own, min(branch, -(-len(own) // size)), rng)
            if part.max(initial=0) == 0:
                continue
            for k in range(part.max() + 1):
                mine = own[part == k]
                if len(mine):
                    self.centres.append(mine.mean(0))
                    spreads.append(spread(mine))
                    self.children.append([])
                    self.children[node].append(len(self.centres) - 1)
                    todo.append((self.children[node][-1], mine))
        self.points = np.array(self.centres)
        self.half = (self.points**2).sum(1) / 2
        self.spreads = np.array(spreads)
        self.leaf = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}
        self.leaves = len(self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.points[kids].T - self.half[kids]).argmax(1)
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, margin: float, most: float = np.inf, sizes: np.ndarray | None = None, least: int = 0) -> tuple[list[int], list[float]]:
        """Leaves in best-bin-first order, and for each how far below the first leaf the traversal had come.

        The traversal ends when the best bin left is more than the margin below the first leaf, or ``most``
        leaves are met, once leaves of these sizes hold ``least`` vectors.
        """
        score = (self.points @ q + SPREADS * np.sqrt(q @ q) * self.spreads).tolist()
        queue, out, depth, held = [(-score[0], 0)], [], [], 0
        low = best = np.inf
        while queue:
            top, node = heapq.heappop(queue)
            kids = self.children[node]
            if out:
                low = min(low, -top)
                if (best - low > margin or len(out) >= most) and (sizes is None or held >= least):
                    break
            if not kids:
                if not out:
                    best = low = -top
                out.append(self.leaf[node])
                depth.append(best - low)
                held += 0 if sizes is None else int(sizes[self.leaf[node]])
            for k in kids:
                heapq.heappush(queue, (-score[k], k))
        return out, depth


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    c = c[rng.permutation(len(c))[:k]]
    part = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        part = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        own = [x[part == i] for i in range(len(c))]
        c = np.array([m.mean(0) for m in own if len(m)])
    part = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
    return np.unique(part, return_inverse=True)[1]


def _stack(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64) if len(col) else np.zeros((0, 1))


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(finite & F.exists("vec", lambda x: x != 0))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("vec") == (size["n"] if size else 0))


def _distinct(v: DataFrame, k: int) -> DataFrame:
    """(vec, ids): each distinct vector once, with its k + 1 smallest ids; ranks are cut before the shuffle."""
    rank = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = v.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k + 1 best finite scores, and of all that tie with the last of them."""
    edge = np.full(len(scores), -np.inf)
    if scores.shape[1] > k + 1:
        edge = -np.partition(-scores, k, axis=1)[:, k] - 1e-12
    return np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", leaf_rows: int = 32) -> tuple[DataFrame, dict]:
    """(query_id, rank, id, score) of each query's k nearest found, and what calibration found.

    ``queries`` are rows of the same form; a query's own id is no candidate for it.
    """
    data = materialize(_distinct(valid_vectors(table, id_col, vec_col), k), "vectors")
    asked = materialize(valid_vectors(queries, id_col, vec_col).distinct(), "queries")
    n = data.count()
    sample = _stack(data.orderBy(F.xxhash64("vec"), F.element_at("ids", 1)).limit(SAMPLE).select("vec").toPandas()["vec"])
    tree = Tree(sample, min(max(1, n // leaf_rows), max(1, len(sample) // 8))) if n else Tree(np.zeros((1, 1)), 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.assign(_stack(b["vec"])))

    data = materialize(data.mapInPandas(assign, "vec array<double>, ids array<long>, leaf int"), "leaves")
    margin, most, found = _calibrate(data, asked, tree, k, recall)
    once = asked.groupBy("vec").agg(F.min("id").alias("q"))
    # neighbouring leaves share a bin of about BLOCK vectors; a larger leaf has bins of its own. The tree bounds both.
    sizes = {r["leaf"]: r["count"] for r in data.groupBy("leaf").count().collect()}
    held = np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)])
    first, parts, at, full = [], [], 0, 0
    for leaf in range(tree.leaves):
        n_leaf = sizes.get(leaf, 0)
        if full and full + n_leaf > BLOCK:
            at, full = at + 1, 0
        first.append(at)
        parts.append(max(1, -(-n_leaf // BLOCK)))
        at, full = at + parts[-1] - 1, (full + n_leaf if parts[-1] == 1 else BLOCK)
    ints = lambda x: F.array(*[F.lit(i) for i in x])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, vec, raw in zip(b["q"], _stack(b["vec"]), b["vec"], strict=True):
                bins: dict[int, list[int]] = {}
                for leaf in tree.visit(vec, margin, most, held, k + 1)[0]:
                    for x in range(first[leaf], first[leaf] + parts[leaf]):
                        bins.setdefault(x, []).append(leaf)
                rows += [(q, raw, x, own) for x, own in bins.items()]
            yield pd.DataFrame(rows, columns=["q", "qvec", "bin", "leaves"])

    walked = materialize(once.mapInPandas(walk, "q long, qvec array<double>, bin int, leaves array<int>"), "visits")
    plan = walked.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs"))  # one row a bin
    spread = F.element_at(ints(first), F.col("leaf") + 1) + F.pmod(F.xxhash64(F.element_at("ids", 1)), F.element_at(ints(parts), F.col("leaf") + 1)).cast("int")
    x = data.withColumn("bin", spread).join(plan, "bin").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    q = walked.join(plan, "bin").withColumn("qb", F.pmod(F.xxhash64("q"), F.col("qs")).cast("int"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "bin": [], "near": []})
        left = left.sort_values("leaf", kind="stable")
        vecs, ids, out = _stack(left["vec"]), left["ids"].tolist(), []
        leaves, starts = np.unique(left["leaf"], return_index=True)
        spans = list(zip(leaves.tolist(), starts.tolist(), [*starts[1:].tolist(), len(left)], strict=True))
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            qs, scores = _stack(part["qvec"]), np.full((len(part), len(vecs)), -np.inf)
            own = np.concatenate([np.asarray(o) for o in part["leaves"]])
            who = np.repeat(np.arange(len(part)), [len(o) for o in part["leaves"]])
            by = np.argsort(own, kind="stable")
            own, who = own[by], who[by]
            for leaf, a, b in spans:
                rows = who[np.searchsorted(own, leaf) : np.searchsorted(own, leaf, "right")]
                if len(rows):
                    scores[rows, a:b] = qs[rows] @ vecs[a:b].T
            near: list[list[tuple]] = [[] for _ in range(len(part))]
            for r, c in zip(*(i.tolist() for i in _top(scores, k)), strict=True):
                near[r] += [(-scores[r, c], int(i)) for i in ids[c]]
            out += [(row, [{"low": s, "id": i} for s, i in sorted(m)[: k + 1]]) for row, m in zip(part["q"], near, strict=True) if m]
        return pd.DataFrame([(q, int(left["bin"].iloc[0]), m) for q, m in out], columns=["q", "bin", "near"])

    keys = ["bin", "qb"]
    near = x.select(*keys, "leaf", "vec", "ids").groupBy(*keys).cogroup(q.select(*keys, "q", "qvec", "leaves").groupBy(*keys)).applyInPandas(compare, "q long, bin int, near array<struct<low:double,id:long>>")
    few = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")
    near = near.groupBy("q", F.pmod("bin", F.lit(64)).alias("part")).agg(few)  # in two steps, so that no row holds the answers of all bins
    best = near.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    every = asked.join(once, "vec").select("id", "q").join(best, "q")
    own = F.slice(F.filter("near", lambda m: m["id"] != F.col("id")), 1, k)
    out = every.select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "m"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("m.id").alias("id"), (-F.col("m.low")).alias("score")), found


def _calibrate(data: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float) -> tuple[float, float, dict]:
    """The margin and number of leaves whose visits reach the recall on sampled queries, judged by brute force over all vectors."""
    sample = asked.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(CALIBRATE).toPandas()
    nothing = {"margin": 0.0, "most": 0, "leaves": tree.leaves, "mean_visits": 0.0, "recall": None}
    if not len(sample):
        return 0.0, 0.0, nothing
    qs, own = _stack(sample["vec"]), sample["id"].tolist()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple]] = [[] for _ in own]
        for b in batches:
            ids, leaf = b["ids"].tolist(), b["leaf"].tolist()
            scores = qs @ _stack(b["vec"]).T
            for r, c in zip(*(i.tolist() for i in _top(scores, k)), strict=True):
                held[r] += [(-scores[r, c], int(i), leaf[c]) for i in ids[c] if i != own[r]]
            held = [heapq.nsmallest(k, h) for h in held]
        yield pd.DataFrame([(r, *m) for r, h in enumerate(held) for m in h], columns=["r", "low", "id", "leaf"])

    near = data.mapInPandas(exact, "r int, low double, id long, leaf int")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("r").orderBy("low", "id"))).where(F.col("rank") <= k).select("r", "leaf").toPandas()
    if not len(near):
        return 0.0, 0.0, nothing
    walks = [tree.visit(q, np.inf) for q in qs]
    at = [{leaf: (i, d) for i, (leaf, d) in enumerate(zip(*w, strict=True))} for w in walks]
    rank, depth = np.array([at[r][leaf] for r, leaf in zip(near["r"], near["leaf"], strict=True)]).T
    weight = 1 / near.groupby("r")["leaf"].transform("size").to_numpy() / near["r"].nunique()
    depths = np.array([w[1] for w in walks])  # never falling along a walk
    best = None
    for margin in np.unique(np.quantile(depth, np.linspace(recall, 1, 24))) + 1e-9:
        reach = (depths <= margin).sum(1)
        inside = depth <= margin
        by = np.argsort(rank[inside], kind="stable")
        got = np.cumsum(weight[inside][by])
        i = int(np.searchsorted(got, recall - 1e-12))
        if i < len(got):
            most = rank[inside][by][i] + 1
            got = weight[inside][rank[inside] < most].sum()
            visits = np.minimum(reach, most).mean()
            if best is None or visits < best[0]:
                best = (visits, margin, most, got)
    if best is None:
        best = (tree.leaves, np.inf, tree.leaves, 1.0)
    visits, margin, most, got = best
    return float(margin), float(most), {"margin": float(margin), "most": int(most), "leaves": tree.leaves, "mean_visits": float(visits), "recall": float(got)}


def op9_approximate_neighbours(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found, _ = nearest(table, table.where("vec_id % 20 = 0"))
    return found.withColumnRenamed("id", "vec_id")
