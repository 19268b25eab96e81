"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become template tokens: numbers, units after
numbers, and names (capitalised words inside a sentence; runs count as one)
turn into typed placeholders, everything else into its lower-cased word.
Windows of ``WORDS`` template tokens are joined by hash. A document holds an
item if windows on nearby diagonals (document position less item position)
cover ``SIMILARITY`` of the item's windows and the slots are consistent: equal
values of the item always meet one value of the document. So a question with
other numbers or names is caught, and a text that only shares the scaffolding
is not.

A capitalised word that begins a sentence (or follows a colon) may be a name or
not, and so may a single capital letter. Windows over such words are made under
both readings, plain and name, of items and documents alike, and an item's
place counts as covered if either meets. The plain reading is also judged
alone, so that a changed first word costs its windows only. A run of names
whose first word is of that kind has the value of its next word.

A bitmap of fixed size (``BITS``) made from the benchmark goes to all
executors; only windows that hit it are shuffled, and the join then decides
exactly. Windows of fewer than two plain words are not used.

Cases: null and empty texts hold nothing; items of three or four tokens are
one window of their own length (with at least three plain words), shorter ones
and those without usable windows match nothing; repeated items count once;
repeated rows get the same answer; a null id is a document like others;
columns beyond id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshline.llm.common import fresh, materialize, slices

WORDS = 5
SIMILARITY = 0.8
BITS = 1 << 22
#: Diagonals that one insertion or deletion may shift, for which windows still count together.
BAND = 8

#: Units that follow a number (fixed values).
UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi ft in inch inches mile miles meter meters metre metres l ml litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent pct c f k degrees mph kmh w kw v a hz khz mhz ghz b kb mb gb tb".split())

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?:\n]")
_END, _NUMBER, _UNIT, _NAME = 0, 2, 4, 6
_MULT = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(WORDS)], dtype=np.uint64)


class _Codes(dict):
    """Token to code: the last bit says capitalised, the one before that it may be a unit, the third that it is a single capital."""

    def __missing__(self, token: str) -> int:
        if token in ".!?:\n":
            code = _END
        elif token[0].isdigit():
            code = _NUMBER
        else:
            code = (xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~7) | 8
            code |= (token[0].isupper() and len(token) > 1) | 2 * (token.lower() in UNITS) | 4 * (token[0].isupper() and len(token) == 1)
        if len(self) < 200_000:
            self[token] = code
        return code


_CODES = _Codes()


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template codes, slot flags, value hashes) of the text's tokens in the plain reading."""
    return _plain(text)[:3]


def _plain(text: str) -> tuple[np.ndarray, ...]:
    """``template``, whether each token may be a name, and whether it goes on a sentence."""
    tokens = _TOKEN.findall(text)
    code = np.array([_CODES[t] for t in tokens], dtype=np.uint64)
    none = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    if not len(code):
        return none
    plain = code >= 8
    before = np.concatenate(([_END], code[:-1])).astype(np.uint64)
    name = plain & ((code & np.uint64(1)) == 1) & (before != _END)
    unit = plain & ((code & np.uint64(2)) == 2) & (before == _NUMBER)
    value = code & ~np.uint64(7)
    numbers = np.flatnonzero(code == _NUMBER)
    if len(numbers):
        value[numbers] = [xxhash.xxh64_intdigest(tokens[i].encode()) & ~7 for i in numbers.tolist()]
    out = np.where(name, np.uint64(_NAME), np.where(unit, np.uint64(_UNIT), np.where(plain, value, code)))
    maybe, inside = plain & ~unit & ((code & np.uint64(5)) > 0), before != _END
    follow = np.concatenate(([False], name[1:] & name[:-1]))
    if follow.any():  # a run of names is one slot, whose value is all of them
        runs = np.cumsum(~follow) - 1
        total = np.zeros(runs[-1] + 1, np.uint64)
        np.add.at(total, runs, value * (np.uint64(2) * np.arange(len(value), dtype=np.uint64) - np.uint64(2) * np.flatnonzero(~follow).astype(np.uint64)[runs] + np.uint64(1)))
        out, value, maybe, inside = out[~follow], total, maybe[~follow], inside[~follow]
    keep = out != _END
    return out[keep], (out[keep] < 8), value[keep], maybe[keep], inside[keep]


def readings(text: str) -> list[tuple[np.ndarray, ...]]:
    """(codes, slots, values, places, changed) under the plain and, where it differs, the name reading.

    Places are token numbers of the plain reading; changed marks what that reading has otherwise.
    """
    codes, slots, values, maybe, inside = _plain(text)
    first = (codes, slots, values, np.arange(len(codes)), np.ones(len(codes), bool))
    new = maybe & ~slots
    if not new.any():
        return [first]
    at = np.flatnonzero(~np.concatenate(([False], maybe[1:] & maybe[:-1] & inside[1:])))
    more = np.diff(at, append=len(codes)) > 1
    out = np.where(maybe[at], np.uint64(_NAME), codes[at])
    return [first, (out, out < 8, values[at + more], at, more | new[at])]


def _near(changed: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` holds a changed token."""
    seen = np.concatenate(([0], np.cumsum(changed)))
    return seen[size:] > seen[:-size]


def windows(codes: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and usability of every window of ``size`` tokens."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, words = np.full(n, size, np.uint64), np.zeros(n, np.int64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(31))) * _MULT[0] + codes[i : i + n]
        words += ~slots[i : i + n]
    return h ^ (h >> np.uint64(29)), words >= (2 if size == WORDS else 3)


_DOC = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("named", pa.bool_()), ("h", pa.int64()), ("values", pa.list_(pa.int64()))])


def _values(slots: np.ndarray, values: np.ndarray, at: int, size: int) -> list[int]:
    return values[at : at + size][slots[at : at + size]].view(np.int64).tolist()


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ipos, place, inamed, n, places, h, ivalues, size) of each usable window of each distinct item under its readings.

    n counts the windows of the plain reading, places the tokens of the name reading where a window of either begins.
    """
    schema = pa.schema([("item", pa.int64()), ("version", pa.int64()), ("ipos", pa.int32()), ("place", pa.int32()), ("inamed", pa.bool_()), ("n", pa.int32()), ("places", pa.int32()), ("h", pa.int64()), ("ivalues", pa.list_(pa.int64())), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for item, version, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found, n, both = [], 0, readings(text or "")
                starts = both[-1][3]
                for named, (codes, slots, values, at, changed) in enumerate(both):
                    size = min(WORDS, len(codes))
                    if size >= 3:
                        h, ok = windows(codes, slots, size)
                        n = n if named else int(ok.sum())
                        for i in np.flatnonzero(ok & _near(changed, size)).tolist():
                            place = int(starts[np.searchsorted(starts, at[i], side="right") - 1])
                            found.append((int(at[i]), place, bool(named), int(h[i].view(np.int64)), _values(slots, values, i, size), size))
                places = len({f[1] for f in found})
                rows += [(item, version, i, place, named, n, places, *rest) for i, place, named, *rest in found]
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    d = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    return d.select("item", F.xxhash64("text"), "text").mapInArrow(run, "item long, version long, ipos int, place int, inamed boolean, n int, places int, h long, ivalues array<long>, size int")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, item, similarity, exact, start) of every item that a document holds; k1 is the id, k2 a hash of id and text."""
    bench = materialize(item_windows(items), "benchmark-windows")
    sizes = sorted({r["size"] for r in bench.select("size").distinct().collect()})  # 3 to 5
    hit = bench.select(F.pmod("h", F.lit(BITS)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()  # at most BITS
    bitmap = np.zeros(BITS, bool)
    bitmap[hit] = True
    packed = np.packbits(bitmap).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for b in slices(batches):
            rows = []
            for k1, k2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for named, (codes, slots, values, at, changed) in enumerate(readings(text or "")):
                    for size in sizes:
                        h, ok = windows(codes, slots, size)
                        if not len(h):
                            continue
                        if named:
                            ok &= _near(changed, size)
                        near = np.flatnonzero(ok & known[h.view(np.int64) & (BITS - 1)])
                        rows += [(k1, k2, p, bool(named), x, _values(slots, values, i, size)) for i, p, x in zip(near.tolist(), at[near].tolist(), h[near].view(np.int64).tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_DOC)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _DOC, strict=True)], schema=_DOC)

    d = docs.select(F.col(id_col).cast("long").alias("k1"), F.col(text_col).alias("text"))
    found = d.select("k1", F.xxhash64("k1", "text"), "text").mapInArrow(run, "k1 long, k2 long, pos int, named boolean, h long, values array<long>")
    met = found.join(bench, "h").where(F.size("values") == F.size("ivalues"))
    diagonal = F.col("pos") - F.col("ipos")
    band = F.explode(F.array_distinct(F.array(F.floor(diagonal / BAND) * 2, F.floor((diagonal + BAND // 2) / BAND) * 2 + 1)))
    met = met.withColumn("band", band)
    # the plain reading alone, and both together
    alone = F.struct(F.lit(False).alias("mixed"), F.col("ipos").alias("at"), F.col("n").alias("of"))
    mixed = F.struct(F.lit(True).alias("mixed"), F.col("place").alias("at"), F.col("places").alias("of"))
    way = F.when(F.col("named") | F.col("inamed"), F.array(mixed)).otherwise(F.array(alone, mixed))
    met = met.withColumn("way", F.explode(way)).select("*", "way.*")
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("ivalues", "values"))))
    held = met.groupBy("k1", "k2", "item", "version", "mixed", "of", "band").agg(F.count_distinct("at").alias("m"), pairs.alias("pairs"), F.min("pos").alias("start"))
    held = held.withColumn("similarity", F.col("m") / F.col("of")).where(F.col("similarity") >= SIMILARITY)
    held = held.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["ivalues"]))))
    exact = F.forall("pairs", lambda p: p["ivalues"] == p["values"])
    best = F.max(F.struct("similarity", exact.alias("exact"), (-F.col("start")).alias("low")))
    return held.groupBy("k1", "k2", "item").agg(best.alias("b")).select("k1", "k2", "item", F.col("b.similarity").alias("similarity"), F.col("b.exact").alias("exact"), (-F.col("b.low")).alias("start"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold an item."""
    k1, k2 = fresh(docs, "_k1"), fresh(docs, "_k2")
    bad = materialize(leaks(docs, items, id_col, text_col).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "contaminated")
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(k1)) & (key == F.col(k2)), "left_anti")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("k1").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "exact", F.col("start").cast("long").alias("start_token"))
