"""SimHash near-duplicates through covering locality-sensitive hashing.

Each document becomes one 64-bit fingerprint. For a radius r, 2^(r+1)-1 bit
masks are built from inner products over GF(2): every bit position i has a
vector m(i) of r+1 bits, and mask v holds the positions with <m(i), v> = 1. Any
r positions leave some non-zero v orthogonal to all their vectors, so two
fingerprints within the radius agree under at least one mask: no pair is missed.

Distinct fingerprints are compared, never their copies. A bucket gives the
edges of a spanning forest of its links, not its pairs. Buckets above
``BUCKET`` fingerprints are cut into blocks, and each pair of blocks is a group
of its own, so no task holds a large bucket and none is capped.

Cases: a null or empty text has fingerprint zero and links like any other; a
null id stays a row, and never wins as smallest id while another exists;
repeated rows share a fingerprint, so a component; an empty table gives an
empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshline.llm.common import components, fresh, materialize, slices

#: Fingerprints that one group compares with each other at most, about.
BUCKET = 4096
#: Bytes of shingle sets up to which one task settles a component.
COMPONENT = 32 << 20


def covering_masks(radius: int) -> list[int]:
    """The masks for a radius, as signed 64-bit numbers."""
    top = 1 << (radius + 1)
    order = np.random.default_rng(20).permutation(np.arange(1, top))
    m = [int(order[i % len(order)]) for i in range(64)]
    out = []
    for v in range(1, top):
        mask = sum(1 << i for i in range(64) if (m[i] & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the word shingles' XXH64 (seed 42), as a signed number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    n, digest, bits = len(last), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    a, b = starts.tolist(), last.tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(joined[x:y], 42) for x, y in zip(a[at : at + 65536], b[at : at + 65536], strict=False)], dtype=np.uint64)
        bits += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (first, other) that connect what links within the radius connect."""
    us: list[int] = []
    vs: list[int] = []
    if len(fps) == 2:
        if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius:
            us.append(fps[0])
            vs.append(fps[1])
        return us, vs
    left = fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        seed = front[0]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                rest = ~near
                near[rest] |= (np.bitwise_count(front[at : at + 256, None] ^ left[rest][None, :]) <= radius).any(0)
            front, left = left[near], left[~near]
            us += [seed] * len(front)
            vs += front.tolist()
    return us, vs


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (column fp) with the connectivity of all links within the radius.

    One shuffle by bucket finds the edges of ordinary buckets and passes the
    members of large ones on, to be compared block by block.
    """
    masks = covering_masks(radius)
    rows = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask"))
    rows = rows.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
    limit = BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive whole and sorted; one may go on in the next batch."""
        bucket, held, large = None, np.zeros(0, np.int64), False
        for b in batches:
            keys, own = b.column(0).to_numpy(), b.column(1).to_numpy()
            if large or len(held):
                n = len(keys) if keys[-1] == bucket else int((keys != bucket).argmax())
                if large:
                    yield _edges([], [], [bucket] * n, own[:n])
                else:
                    held = np.concatenate((held, own[:n]))
                if n < len(keys):
                    yield _edges(*_of_buckets(held, [0, len(held)], radius), [], [])
                    held, large = held[:0], False
                elif len(held) > limit:
                    yield _edges([], [], [bucket] * len(held), held)
                    held, large = held[:0], True
                keys, own = keys[n:], own[n:]
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            last = cuts[-1]
            size = np.diff(cuts)
            wide = cuts[:-1][size > limit]
            for at in wide:
                n = int(size[cuts[:-1] == at][0])
                yield _edges([], [], [keys[at]] * n, own[at : at + n])
            some = np.flatnonzero((size > 1) & (size <= limit))
            spans = [(int(cuts[i]), int(cuts[i] + size[i])) for i in some]
            us, vs = [], []
            for x, y in spans:
                u, v = _forest(own[x:y].view(np.uint64), radius)
                us += u
                vs += v
            yield _edges(us, vs, [], [])
            bucket, held = int(keys[last]), own[last:]
            large = False
        if len(held) > 1:
            yield _edges(*_of_buckets(held, [0, len(held)], radius), [], [])

    found = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long, bucket long")
    found = materialize(found, "links")
    large = found.where("bucket IS NOT NULL").select("bucket", F.col("v").alias("fp"))
    blocks = large.groupBy("bucket").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    large = large.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    large = large.select("bucket", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keys = ["bucket", "lo", "hi"]
    large = large.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None
        for b in batches:
            b = b if tail is None else pd.concat([tail, b], ignore_index=True)
            k = b[keys].to_numpy()
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            at = cut[-1] if len(cut) else 0
            if at:
                yield _frame(*_of_buckets(b["fp"].to_numpy()[:at], [0, *cut.tolist()], radius))
            tail = b.iloc[at:]
        if tail is not None and len(tail):
            yield _frame(*_of_buckets(tail["fp"].to_numpy(), [0, len(tail)], radius))

    crossed = large.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(pairs, "u long, v long")
    return found.where("bucket IS NULL").select("u", "v").union(crossed)


def _signed(x: list) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def _edges(us: list, vs: list, buckets: list, members: np.ndarray | list) -> pa.RecordBatch:
    """Rows of edges, or of members of large buckets."""
    v = np.concatenate((_signed(vs), np.array(members, dtype=np.int64)))
    u = pa.array([*_signed(us).tolist(), *[None] * len(buckets)], pa.int64())
    b = pa.array([*[None] * len(us), *map(int, buckets)], pa.int64())
    return pa.RecordBatch.from_arrays([u, pa.array(v), b], names=["u", "v", "bucket"])


def _frame(us: list, vs: list) -> pd.DataFrame:
    return pd.DataFrame({"u": _signed(us), "v": _signed(vs)})


def _of_buckets(fps: np.ndarray, cuts: list[int], radius: int) -> tuple[list, list]:
    fps = np.ascontiguousarray(fps).view(np.uint64)
    us: list[int] = []
    vs: list[int] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        u, v = _forest(fps[a:b], radius)
        us += u
        vs += v
    return us, vs


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links within the radius."""
    fps = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return fps.join(rooted.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint32)
    n = max(1, len(parts) - words + 1)
    return np.unique(np.array([xxhash.xxh32_intdigest(b" ".join(parts[i : i + words])) for i in range(n)], dtype=np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def leaders(sets: list[np.ndarray], similarity: float) -> list[bool]:
    """In order: whether each set stays, which it does unless one that stays before it is as similar."""
    stays: list[int] = []
    out = []
    for i, s in enumerate(sets):
        near = any(min(len(s), len(sets[j])) >= similarity * max(len(s), len(sets[j])) and jaccard(s, sets[j]) >= similarity for j in stays)
        if not near:
            stays.append(i)
        out.append(not near)
    return out


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 7, finger_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the smallest id.

    Candidates are the components of SimHash links; ``finger_words`` and
    ``radius`` are wide enough that copies within the similarity nearly always
    link. Within a component, a text goes if its word shingles are as similar
    as ``similarity`` (Jaccard) to those of a text that stays before it.
    Small components are settled in one task each; of large ones, each round
    compares all open texts to one leader, as a join.
    """
    key = [F.col(id_col).cast("long").alias("k1"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("k2")]
    keyed = docs.select(*key, F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([fingerprint(t, finger_words) for t in b.column(3).to_pylist()], pa.int64())], names=["k1", "k2", "th", "fp"])

    fps = materialize(keyed.mapInArrow(run, "k1 long, k2 long, th long, fp long"), "fingerprints")
    nodes = materialize(fps.select("fp").distinct(), "nodes")
    roots = components(links(nodes, radius))
    rooted = fps.join(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "fp")
    place = F.struct(F.col("k1").isNull().alias("none"), "k1", "k2")
    texts = materialize(rooted.groupBy("root", "th").agg(F.min(place).alias("first"), F.count("*").alias("rows")), "texts")
    # counts are written before they are joined: between two plain shuffles, a hot component is split
    many = materialize(texts.groupBy("root").agg(F.count("*").alias("m")).where("m > 1"), "components")
    open_texts = texts.join(many.select("root"), "root").select("root", "th", "first")
    wanted = open_texts.select(F.col("first.k1").alias("w1"), F.col("first.k2").alias("w2"), "root", F.col("th").alias("wh"), "first")
    met = keyed.join(wanted, F.col("k1").eqNullSafe(F.col("w1")) & (F.col("k2") == F.col("w2"))).dropDuplicates(["root", "wh"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingles(t, words).tobytes() for t in b.column(3).to_pylist()], pa.binary())], names=["root", "th", "first", "own"])

    first_type = "struct<none:boolean,k1:bigint,k2:bigint>"
    known = materialize(met.select("root", "wh", "first", "text").mapInArrow(sets, f"root long, th long, first {first_type}, own binary"), "shingles")
    weight = materialize(known.groupBy("root").agg(F.sum(F.length("own") + 64).alias("bytes")), "weights")
    known = known.join(weight, "root")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["none", "k1", "k2"])
        stays = leaders([np.frombuffer(x, np.uint32) for x in pdf["own"]], similarity)
        return pdf.loc[~np.array(stays), ["root", "th"]]

    flat = known.select("root", "th", "first", "own", "bytes", F.col("first.none").alias("none"), F.coalesce("first.k1", F.lit(0)).alias("k1"), F.col("first.k2").alias("k2"))
    gone = flat.where(F.col("bytes") <= COMPONENT).drop("bytes", "first").groupBy("root").applyInPandas(settle, "root long, th long")
    lost = [materialize(gone, "near-copies")]
    rest = materialize(known.where(F.col("bytes") > COMPONENT).drop("bytes"), "open")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= similarity for x, y in zip(a, b, strict=True)], dtype=bool)

    while rest.limit(1).count():
        lead = rest.groupBy("root").agg(F.min("first").alias("lead"))
        one = rest.join(lead, "root").where(F.col("first") == F.col("lead")).select("root", "lead", F.col("own").alias("best"))
        judged = materialize(rest.join(one, "root").where(F.col("first") != F.col("lead")).withColumn("near", near("own", "best")).drop("best", "lead"), "judged")
        lost.append(judged.where("near").select("root", "th"))
        rest = judged.where("NOT near").drop("near")
    for more in lost[1:]:
        lost[0] = lost[0].union(more)
    bad = materialize(lost[0], "lost").withColumn("gone", F.lit(True))
    state = rooted.select("k1", "k2", "root", "th").join(texts, ["root", "th"]).join(bad, ["root", "th"], "left")
    state = state.where("gone OR rows > 1").withColumn("gone", F.coalesce("gone", F.lit(False)) | ~((F.col("k1").eqNullSafe(F.col("first.k1"))) & (F.col("k2") == F.col("first.k2"))))
    k1, k2, gone, n = (fresh(docs, x) for x in ("_k1", "_k2", "_gone", "_n"))
    state = state.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.first("gone").alias(gone), F.count("*").alias(n))
    state = materialize(state.where(F.col(gone) | (F.col(n) > 1)), "dropped")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(k1)) & (F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)) == F.col(k2))
    kept = docs.join(state.select(k1, k2), same, "left_anti")
    # rows that repeat id and text: one of them stays
    twice = docs.join(state.where(~F.col(gone)), same).dropDuplicates([k1, k2]).select(*[docs[c] for c in docs.columns])
    return kept.union(twice)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
