"""Toxicity by a classifier chain with out-of-fold predictions.

Linear models predict the categories one after the other; each takes the
probabilities of the categories before it as further inputs. While training,
these are out-of-fold predictions, so a later model never sees an earlier one's
fit to its own rows. Inputs are a document's distinct words and their first
four and five letters, which carries over to inflected and compounded words.

Training takes at most ``SAMPLE`` labelled rows (by hash order of their id);
scoring reads every whole text. The model is ``FEATURES`` weights a category,
a bounded broadcast.

Cases: null and empty texts have no words and get the bias alone; labels that
are null, or whose id has no document, are not used; with no labelled rows, or
none toxic, nothing is toxic; a null id is scored like others; repeated rows
get equal scores; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshline.llm.common import fresh, materialize

#: Labelled rows that the chain is fitted on, at most.
SAMPLE = 12_000
FEATURES = 4096
FOLDS = 3
#: Documents that a feature must occur in to be used.
LEAST = 4
#: Log odds that a feature must keep after SURE standard errors are taken off: it multiplies the odds for certain.
CLEAR, SURE = 1.0, 2.5

#: Kinds of toxic wording by which labelled toxic rows are told apart (fixed values).
INSULTS = "idiot moron loser clown scum"
CONTEMPT = "stupid disgusting trash worthless pathetic"
CATEGORIES = ("insult", "contempt", "toxic")

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


class Chain:
    """Weights of each category's model over a vocabulary and over the categories before it."""

    def __init__(self, vocabulary: dict[str, int], ids: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> None:
        self.vocabulary = vocabulary
        k = labels.shape[1]
        self.weights, self.links, self.bias = np.zeros((len(vocabulary), k)), np.zeros((k, k)), np.full(k, -20.0)
        x = _Rows(ids, len(vocabulary))
        held = np.zeros(labels.shape)
        for c in range(k):
            y = labels[:, c]
            if not 0 < y.sum() < len(y):
                continue
            before = held[:, :c]
            for f in range(FOLDS):
                fit, out = folds != f, folds == f
                if 0 < y[fit].sum() < fit.sum():
                    w, v, b = _logistic(x.take(fit), before[fit], y[fit])
                    held[out, c] = _sigmoid(x.take(out).dot(w) + before[out] @ v + b)
            self.weights[:, c], self.links[c, :c], self.bias[c] = _logistic(x, before, y)
        self.threshold = self._best_threshold(held[:, -1], labels[:, -1]) if len(ids) else 0.5

    @staticmethod
    def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
        grid = np.linspace(0.05, 0.95, 91)
        f1 = [2 * (y * (p >= t)).sum() / max(1.0, y.sum() + (p >= t).sum()) for t in grid]
        best = np.flatnonzero(np.isclose(f1, max(f1)))
        return float(grid[best[len(best) // 2]])

    def scores(self, texts: Iterator[str | None]) -> np.ndarray:
        cache = _Weights(self.vocabulary, self.weights)
        z = np.array([cache.total(words(t)) for t in texts]).reshape(-1, len(self.bias)) + self.bias
        p = np.zeros(z.shape)
        for c in range(z.shape[1]):
            p[:, c] = _sigmoid(z[:, c] + p[:, :c] @ self.links[c, :c])
        return p


class _Weights(dict):
    """Word to the row of its summed weights; words without any share row 0."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray) -> None:
        super().__init__()
        self.vocabulary, self.weights, self.rows = vocabulary, weights, [np.zeros(weights.shape[1])]

    def __missing__(self, word: str) -> int:
        ids = [self.vocabulary[f] for f in features(word) if f in self.vocabulary]
        row = 0
        if ids:
            row = len(self.rows)
            self.rows.append(self.weights[ids].sum(0))
        if len(self) < 500_000 or row:
            self[word] = row
        return row

    def total(self, own: set[str]) -> np.ndarray:
        out = np.zeros(self.weights.shape[1])
        for w in sorted(w for w in own if self[w]):
            out += self.rows[self[w]]
        return out


class _Rows:
    """Sparse counts: how many distinct words of the document have the feature."""

    def __init__(self, ids: list[np.ndarray], width: int) -> None:
        self.width, self.n = width, len(ids)
        self.row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        self.col = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)

    def take(self, mask: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        keep = mask[self.row]
        out.width, out.n = self.width, int(mask.sum())
        out.row, out.col = (np.cumsum(mask) - 1)[self.row[keep]], self.col[keep]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: _Rows, more: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by scaled gradient steps."""
    w, v, b = np.zeros(x.width), np.zeros(more.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    gw, gv, gb = np.full(x.width, 1e-8), np.full(more.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        g = (_sigmoid(x.dot(w) + more @ v + b) - y) / len(y)
        dw, dv, db = x.back(g) + ridge * w, more.T @ g + ridge * v, g.sum()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - 0.5 * dw / np.sqrt(gw), v - 0.5 * dv / np.sqrt(gv), b - 0.5 * db / np.sqrt(gb)
    return w, v, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from at most ``SAMPLE`` rows of ``labels`` (id, toxic) and their documents."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "words": [sorted(words(t)) for t in b["text"]]})

    rows = materialize(rows.mapInPandas(used, "id long, y double, words array<string>").dropDuplicates(["id"]), "labelled")
    kind = lambda names: ((F.col("y") > 0) & F.arrays_overlap("words", F.array(*[F.lit(w) for w in names.split()]))).cast("double")
    rows = rows.withColumns({"y0": kind(INSULTS), "y1": kind(CONTEMPT), "y2": F.col("y")})
    vocabulary = _select(rows)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.array(sorted(vocabulary[f] for w in own for f in features(w) if f in vocabulary), np.int32).tobytes() for own in b["words"]]
            yield b[["id", "y0", "y1", "y2"]].assign(ids=ids)

    got = rows.mapInPandas(known, "id long, y0 double, y1 double, y2 double, ids binary").toPandas().sort_values("id")
    ids = [np.frombuffer(i, np.int32) for i in got["ids"]]
    return Chain(vocabulary, ids, got[["y0", "y1", "y2"]].to_numpy(float), got["id"].to_numpy(np.int64) * 2654435761 % 1_000_003 % FOLDS)


def _select(rows: DataFrame) -> dict[str, int]:
    """The features that tell a category apart best, by the lower end of their log odds; counted by Spark."""
    kinds = ["y0", "y1", "y2"]
    own = F.array_distinct(F.flatten(F.transform("words", lambda w: F.array_compact(F.array(w, *[F.when(F.length(w) > n, F.concat(F.left(w, F.lit(n)), F.lit("*"))) for n in (4, 5)])))))
    total = rows.agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in kinds]).first()
    counts = rows.select(F.explode(own).alias("feature"), *kinds).groupBy("feature").agg(F.count("*").alias("t"), *[F.sum(k).alias(k) for k in kinds]).where(F.col("t") >= LEAST)
    scores = []
    for k in kinds:
        yes = float(total[k] or 0)
        cells = [F.col(k) + 0.5, F.lit(yes) - F.col(k) + 0.5, F.col("t") - F.col(k) + 0.5, F.lit(total["n"] - yes) - F.col("t") + F.col(k) + 0.5]
        odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
        scores.append(odds - SURE * F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3]) if 0 < yes < total["n"] else F.lit(0.0))
    best = counts.select("feature", F.greatest(*scores).alias("score")).where(F.col("score") >= CLEAR).orderBy(F.desc("score"), "feature").limit(FEATURES)
    return {f: i for i, f in enumerate(sorted(r["feature"] for r in best.select("feature").collect()))}


def probabilities(chain: Chain, text: Column) -> Column:
    """A struct of the categories' probabilities."""

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(chain.scores(b), columns=list(CATEGORIES))

    return score(text)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose toxic probability reaches the chain's threshold."""
    chain = fit(docs, labels, id_col, text_col)
    p = fresh(docs, "_p")
    return docs.withColumn(p, probabilities(chain, F.col(text_col))).where(F.col(f"{p}.toxic") < chain.threshold).drop(p)


def op5_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = fit(docs, labels)
    scored = docs.select("doc_id", probabilities(chain, F.col("text")).alias("p"))
    return scored.select("doc_id", *[F.col(f"p.{c}").alias(f"p_{c}") for c in CATEGORIES], (F.col("p.toxic") >= chain.threshold).alias("is_toxic"))
