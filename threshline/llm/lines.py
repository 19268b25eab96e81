"""Line dedup by content-defined chunks of lines, and on to whole repeated runs.

A rolling hash over the hashes of the last ``WINDOW`` lines chooses chunk ends,
so an insertion shifts boundaries only near itself. A chunk of at least two
lines that occurred before (by id, then text hash, then position) is a copy and
goes whole. ``dedup_lines`` ends there.

What a passage shares with the chunks at its ends, and a passage too short to
hold a chunk, stays at that. So ``dedup_runs`` goes on at the finest cut, every
two adjacent lines that lie in no copy: across chunk ends and in the chunks that
were met first or once. A pair that occurred before goes too. As the first
occurrence of a pair is never in a copy, the two steps together remove exactly
the runs of two or more lines that occurred before. A pair of two blank lines
counts for nothing, and a chunk that holds one is left to its pairs. The first
occurrence of a line is never removed. A line that repeats between differing
neighbours stays too: it is no run.

A piece (chunk of at least two lines, or pair) whose 128-bit hash occurs more
than once among its kind is a candidate; all its occurrences but the first are
removed. Before anything is removed, the bytes of all occurrences are compared:
within a task against a bounded table of pieces it has met, and what that does
not settle in a shuffle by hash, one row a task and piece at most. Should two
different pieces share a hash, all is hashed anew under another key.

Only hashes and piece numbers are shuffled for the whole corpus; texts travel
once, compressed, and bytes only for repeated pieces. The join of texts is
a merge join, as the other side grows with the corpus. The hot side of each
join holds one row per hash, so a piece that a third of all documents share is
a skewed probe side that adaptive execution splits.

Cases: a null text stays null and has no lines; an empty text has one empty
line and stays; rows that repeat id and text are one document and are treated
alike (a first occurrence stays in each); a null id comes before others; an
empty table gives an empty result; other columns pass through, whatever their
names, and ``n_chars`` follows the new text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.llm.common import materialize, pack, release, slices, unpack

WINDOW = 3
#: A chunk ends where the rolling hash is a multiple of this, or after MOST lines.
EVERY = 4
MOST = 64
#: Bytes of pieces that a task keeps to compare further ones with.
MET = 16 << 20
#: (first line, line after the last, bytes or none, chunk it lies in) of every piece of a text; the last is null for a chunk, -1 for a pair in none.
Pieces = Callable[[str], list[tuple[int, int, bytes, int | None]]]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk; all lines are in one."""
    return _cut([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in text.split("\n")])


def _cut(hashes: list[int]) -> list[tuple[int, int]]:
    h = np.array(hashes, dtype=np.uint64)
    roll = np.zeros(len(h), np.uint64)
    for i in range(WINDOW):
        roll[i:] += h[: len(h) - i] * _POWERS[i]
    roll ^= roll >> np.uint64(29)
    ends, start = [], 0
    marks = np.flatnonzero(roll % np.uint64(EVERY) == 0).tolist()
    for m in [*marks, len(h) - 1]:
        while m + 1 - start > MOST:
            ends.append((start, start + MOST))
            start += MOST
        # a chunk of a single line waits for its next
        if m + 1 - start >= 2 or (m == len(h) - 1 and m >= start):
            ends.append((start, m + 1))
            start = m + 1
    return ends


def _pieces(text: str) -> list[tuple[int, int, bytes, None]]:
    """Chunks of at least two lines with their bytes; shorter ones with none."""
    lines = text.split("\n")
    return [(a, b, "\n".join(lines[a:b]).encode("utf-8", "surrogatepass") if b - a > 1 else b"", None) for a, b in chunks(text)]


def _runs(text: str) -> list[tuple[int, int, bytes, int | None]]:
    """The chunks, then every two adjacent lines, with their bytes; two blank lines, and chunks that hold them, with none."""
    lines = [x.encode("utf-8", "surrogatepass") for x in text.split("\n")]
    blank = [not x.strip() for x in lines]
    void = [x and y for x, y in zip(blank, blank[1:])]
    found, within = [], [-1] * len(void)
    for at, (a, b) in enumerate(_cut([xxhash.xxh64_intdigest(x) for x in lines])):
        whole = b - a > 1 and not any(void[a : b - 1])
        found.append((a, b, b"\n".join(lines[a:b]) if whole else b"", None))
        if whole:
            within[a : b - 1] = [at] * (b - 1 - a)
    return found + [(i, i + 2, b"" if void[i] else lines[i] + b"\n" + lines[i + 1], within[i]) for i in range(len(void))]


def _key(id_col: str, text_col: str) -> list:
    return [F.col(id_col).alias("k1"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k2")]


def _digest(data: bytes, salt: int) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=salt.to_bytes(16, "big")).digest()


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: Pieces = _pieces, salt: int = 0) -> DataFrame:
    """(k1, k2, at, h1, h2, within) of each multi-line piece; at is its number in the document, within that of its chunk."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("within", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for k1, k2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for at, (_, _, data, within) in enumerate(pieces(text)):
                    if data:
                        rows.append((k1, k2, at, *struct.unpack(">qq", _digest(data, salt)), within))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.contains("text", F.lit("\n")))
    return d.select(*_key("id", "text"), "text").mapInArrow(run, "k1 long, k2 long, at int, h1 long, h2 long, within int")


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", facts: bool = False) -> DataFrame:
    """``docs`` without the runs of two or more lines that occurred before; facts as in ``dedup_lines``."""
    return dedup_lines(docs, id_col, text_col, facts, _runs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", facts: bool = False, pieces: Pieces = _pieces) -> DataFrame:
    """``docs`` without globally repeated multi-line chunks; with ``facts``, also n_lines, n_chunks, removed_chunks (whole ones) and removed_lines."""
    salt = 0
    while True:
        marked = _marked(docs, id_col, text_col, pieces, salt)
        if not _collide(marked, pieces, salt):
            break
        release(marked)
        salt += 1
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    more = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"] if facts else []
    out = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)], *[T.StructField(m, T.LongType()) for m in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new, told, changed = [], [], []
            for data, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = None if data is None else unpack(data)
                kept = _without(text, gone, pieces) if gone else text
                new.append(kept)
                changed.append(bool(gone))
                if facts:
                    told.append(_facts(text, gone or [], pieces))
            cols = b.columns[3:]
            cols[text_at] = pa.array(new, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array([len(t) if x else c for c, t, x in zip(cols[chars_at].to_pylist(), new, changed, strict=True)], cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols + [pa.array([f[i] for f in told], pa.int64()) for i in range(len(more))], names=names + more)

    done = marked.mapInArrow(run, out)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], *more)


def _hits(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, at, later) of the pieces that repeat, later being at but for a first occurrence; and the table behind it."""
    place = F.struct("k1", "k2", "at")
    # one row a hash, written before the join: between two plain shuffles, a piece that very many documents share is split
    repeated = materialize(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first"), "repeated")
    return found.join(repeated, ["h1", "h2"]).select("k1", "k2", "at", F.when(~place.eqNullSafe(F.col("first")), F.col("at")).alias("later")), repeated


def _marked(docs: DataFrame, id_col: str, text_col: str, pieces: Pieces, salt: int) -> DataFrame:
    """A written table of (packed text, gone, seen, c0, c1, ...): the numbers of a row's pieces that go, and of all that repeat; the text's own column is null."""
    found = materialize(occurrences(docs, id_col, text_col, pieces, salt), "pieces")
    hits, repeated = _hits(found.where("within IS NULL"))
    written = [found, repeated]
    if pieces is _runs:
        hits = materialize(hits, "chunks")
        copies = hits.where("later IS NOT NULL").toDF("c1", "c2", "chunk", "later")
        inside = F.col("k1").eqNullSafe(F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("within") == F.col("chunk"))
        rest = materialize(found.where("within IS NOT NULL").join(copies, inside, "left_anti").select("k1", "k2", "at", "h1", "h2"), "pairs")
        finer, repeated = _hits(rest)
        written += [hits, rest, repeated]
        hits = hits.union(finer)
    marks = hits.groupBy("k1", "k2").agg(F.collect_set("later").alias("gone"), F.collect_set("at").alias("seen"))  # rows that repeat id and text have one list
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (docs.columns.index(c) for c in (id_col, text_col))
    small = T.StructType([T.StructField("packed", T.BinaryType()), *[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)], T.StructField("d2", T.LongType())])

    def pack_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = list(b.columns)
            packed = pa.array([t if t is None else pack(t) for t in cols[text_at].to_pylist()], pa.binary())
            cols[text_at] = pa.nulls(b.num_rows, cols[text_at].type)
            yield pa.RecordBatch.from_arrays([packed, *cols], names=["packed", *names, "d2"])

    d = docs.toDF(*names)
    d = d.withColumn("d2", F.xxhash64(F.col(f"c{id_at}").cast("long"), F.col(f"c{text_at}"))).mapInArrow(pack_column, small)
    d = d.join(marks.hint("merge"), F.col(f"c{id_at}").cast("long").eqNullSafe(F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    marked = materialize(d.select("packed", "gone", "seen", *names), "marked")
    for table in written:
        release(table)
    return marked


def _collide(marked: DataFrame, pieces: Pieces, salt: int) -> bool:
    """Whether two pieces of one hash differ in their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, bytes] = {}
        size = 0
        for b in slices(batches):
            rows = []
            for data, seen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = pieces(unpack(data))
                for at in seen:
                    data = parts[at][2]
                    d = _digest(data, salt)
                    if met.get(d) != data:
                        rows.append((*struct.unpack(">qq", d), data))
                        if d not in met and size < MET:
                            met[d] = data
                            size += len(data) + 160
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h1", "h2", "piece"])

    bytes_of = marked.where(F.size("seen") > 0).select("packed", "seen").mapInArrow(run, "h1 long, h2 long, piece binary")
    both = bytes_of.groupBy("h1", "h2").agg(F.min("piece").alias("a"), F.max("piece").alias("b"))
    return not both.where("a != b").isEmpty()


def _without(text: str, gone: list[int], pieces: Pieces) -> str:
    """The text without the lines of its pieces of these numbers."""
    lines, parts = text.split("\n"), pieces(text)
    dead = {i for at in gone for i in range(*parts[at][:2])}
    return "\n".join(x for i, x in enumerate(lines) if i not in dead)


def _facts(text: str | None, gone: list[int], pieces: Pieces) -> tuple[int, int, int, int]:
    if text is None:
        return 0, 0, 0, 0
    parts, cut = pieces(text) if gone else [], chunks(text)
    dead = {i for at in gone for i in range(*parts[at][:2])}
    return text.count("\n") + 1, len(cut), sum(dead.issuperset(range(a, b)) for a, b in cut) if dead else 0, len(dead)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), facts=True)
    return kept.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
