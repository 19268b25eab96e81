"""Exact removal of repeated 400-byte strings by suffix sorting in shards.

1. Every 400-byte window of a text has one anchor: the place of the least hash
   among its 32-byte substrings (leftmost of equals). The anchor depends on the
   window's content alone, so equal windows have equal anchor hashes. The
   windows of one anchor occurrence form a segment of the text. Where a text
   repeats itself at a short distance, only the first windows of the stretch do:
   all others equal one before them.
2. Segments are counted by anchor hash and content. An anchor that occurs once
   repeats nothing. If all segments of an anchor are equal, each of their
   windows repeats: their common prefix is the segment.
3. Anchors with different segments go to shards, each distinct segment once,
   with its number of copies. Those of hot anchors are cut into stripes of
   windows at similar distance to the anchor, dealt by the bytes that all
   windows of a stripe hold, so that only what agrees in them meets. A shard
   leaves out windows whose rolling hash no other segment shares, sorts the
   suffixes of the rest (``induce.ordered``), and keeps the windows whose common
   prefix with a neighbour in suffix order reaches the length.
4. Repeated windows return to all occurrences of their segments; a document's
   union of windows is removed.

The sort is external induced sorting: priority queues on disk carry tuples of
symbol, position and common prefix through the recursion. A shard's bytes,
marks, text, names and queues are files in the task's own temporary folder
where they exceed ``IN_MEMORY`` bytes, so a shard may be far larger than memory;
hashes are compared in as many passes as ``WINDOWS`` of them at once take.

Cases: a null text is empty; texts shorter than the length keep all; rows that
repeat id and text are documents of their own, so whatever they share goes; a
null id is a document like others; an empty table gives an empty result;
columns beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshline.llm.common import materialize, pack, slices, unpack_bytes
from threshline.llm.induce import Files, ordered

LENGTH = 400
#: Bytes of the substrings that anchors are chosen among.
GRAM = 32
#: Arrays above this many bytes are kept in files.
IN_MEMORY = 64 << 20
#: Hashes that one pass over a shard compares.
WINDOWS = 1 << 23
#: Bytes of segments that one sort takes at least, unless its partition ends; a larger group is sorted as one.
SHARD = 2 << 20
#: Distinct segments above which an anchor's windows are dealt to several shards by their distance to it.
HOT = 2048
STRIPE = 32
PIECE = 1 << 20
#: Distances at which a text is looked through for repeating itself, where it has more than a segment for each so many windows.
NEAR, DENSE = 64, 8

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLE: dict[str, np.ndarray] = {}


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size``-byte substring, from its content alone."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    if len(_TABLE.get("up", ())) < n:
        m = max(n, 1 << 17)
        _TABLE["up"], _TABLE["down"] = _powers(m, _BASE), _powers(m, _INVERSE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _TABLE["down"][:n], out=total[1:])
    h = (total[size:] - total[:-size]) * _TABLE["up"][: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by block prefixes and suffixes."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(data: bytes, local: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, anchor hash, anchor) of every segment, in order; long texts in overlapping pieces.

    With a list ``local``, stretches where the text repeats itself at a short distance are put there
    as (first, last) window, and only windows that equal none before them at that distance are in segments.
    """
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, PIECE + LENGTH - 1), at)
        if len(part) < LENGTH:
            return
        h = rolling(part, GRAM)
        place = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & _LOW
        new = np.concatenate(([True], place[1:] != place[:-1]))
        last = np.append(new[1:], True)
        if local is not None and new.sum() * DENSE > len(new):
            seen = np.zeros(len(new), bool)
            for a, b, distance in _periods(part):
                local.append((a + at, b + at))
                seen[a + distance : b + 1] = True
            new = ~seen & (new | np.append(False, seen[:-1]))
            last = ~seen & (last | np.append(seen[1:], True))
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        anchor = place[first].astype(np.int64)
        yield from zip((first + at).tolist(), (last + at).tolist(), h[anchor].view(np.int64).tolist(), (anchor + at).tolist(), strict=True)


def _periods(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first window, last window, distance) of stretches in which each window equals the one a short distance on or back."""
    for distance in range(1, min(NEAR, len(part) - LENGTH) + 1):
        same = part[distance:] == part[:-distance]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= LENGTH:
                yield a, b - LENGTH + distance, distance


def repeated_windows(parts: list[np.ndarray], length: int, files: Files) -> list[np.ndarray]:
    """For each part, the starts of its ``length``-byte windows that occur again in any part, by the suffix order of all."""
    n = sum(len(p) + 1 for p in parts) + 1
    text, starts, at = files.array(n, np.uint16), [], 0
    for p in parts:  # symbols from 2 on, 1 after each part, and 0 at the end
        starts.append(at)
        text[at : at + len(p)] = p
        text[at : at + len(p)] += 2
        text[at + len(p)] = 1
        at += len(p) + 1
    text[n - 1] = 0
    hit, prior = files.array(n, bool), -1
    for pos, lcp in ordered(text, 258, length, files):
        same = lcp >= length  # windows that reach over a part's end may be hit, and are not looked up
        hit[pos[same]] = True
        hit[np.concatenate(([prior], pos[:-1]))[same]] = True
        prior = pos[-1]
    return [np.flatnonzero(hit[a : a + max(0, len(p) - length + 1)]) for a, p in zip(starts, parts, strict=True)]


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))


class Shard:
    """Segments (h, sid, copies, offset of the first window in its segment, bytes) of whole groups, their bytes on disk where they are many."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []  # h, sid, copies, offset, from, to; of equal bytes only one is kept
        self.met: dict[tuple, int] = {}
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.file = None

    def add(self, h: int, stripe: int, sid: int, copies: int, at: int, part: bytes) -> None:
        key = (h, stripe, xxhash.xxh3_128_digest(part))
        first = self.met.setdefault(key, len(self.rows))
        if first < len(self.rows):
            _, _, _, _, lo, hi = self.rows[first]
            self.rows.append((h, sid, -first - 1, at, lo, hi))  # the same bytes: as the first
            return
        self.rows.append((h, sid, copies, at, self.size, self.size + len(part)))
        self.held.append(part)
        self.size += len(part)
        if self.size - self.written > IN_MEMORY:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(b"".join(self.held))
            self.held, self.written = [], self.size

    def data(self) -> np.ndarray:
        if not self.file:
            return np.frombuffer(b"".join(self.held), np.uint8)
        self.file.write(b"".join(self.held))
        self.file.flush()
        self.held, self.written = [], self.size
        return np.memmap(self.file, np.uint8, "r", shape=(self.size,))

    def close(self) -> None:
        if self.file:
            self.file.close()

    def windows(self) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """(h, sid, runs of repeated windows) of the segments with any."""
        data, files = self.data(), Files(IN_MEMORY)
        twice = {-c - 1 for _, _, c, *_ in self.rows if c < 0}
        own = [i for i, r in enumerate(self.rows) if r[2] > 0]
        counts = [max(0, self.rows[i][5] - self.rows[i][4] - LENGTH + 1) for i in own]
        ends = np.cumsum(counts)
        again = files.array(int(ends[-1]) if len(ends) else 0, bool)
        passes = max(1, -(-len(again) // WINDOWS))
        for k in range(passes):
            some, where = [], []
            for i, end, n in zip(own, ends.tolist(), counts, strict=True):
                h, _, _, _, lo, hi = self.rows[i]
                x = rolling(data[lo:hi], LENGTH) ^ np.uint64(h & (1 << 64) - 1)
                pick = np.flatnonzero((x >> np.uint64(40)) % np.uint64(passes) == k) if passes > 1 else np.arange(n)
                some.append(x[pick])
                where.append(pick + (end - n))
            if some:
                x, at = np.concatenate(some), np.concatenate(where)
                by = np.argsort(x)
                x, at = x[by], at[by]
                same = np.flatnonzero(x[1:] == x[:-1])
                again[at[same]] = True
                again[at[same + 1]] = True
        parts, back = [], []
        for i, end, n in zip(own, ends.tolist(), counts, strict=True):
            for x, y in _runs(np.flatnonzero(again[end - n : end])):
                parts.append(data[self.rows[i][4] + x : self.rows[i][4] + y + LENGTH])
                back.append((i, x))
        found: dict[int, list[tuple[int, int]]] = {i: [(0, n - 1)] for i, n in zip(own, counts, strict=True) if n and (self.rows[i][2] > 1 or i in twice)}
        for (i, x), starts in zip(back, repeated_windows(parts, LENGTH, files) if parts else [], strict=True):
            if self.rows[i][2] == 1 and i not in twice:
                found.setdefault(i, []).extend((a + x, b + x) for a, b in _runs(starts))
        out = []
        for i, (h, sid, copies, at, _, _) in enumerate(self.rows):
            runs = found.get(-copies - 1 if copies < 0 else i)
            if runs:
                out.append((h, sid, [(a + at, b + at) for a, b in runs]))
        return out


_ANCHORS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("sid", pa.int64())])
_RUN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for k1, k2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            data, local = _bytes_of(text), []
            for lo, hi, h, anchor in segments(data, local):
                # where the anchor stands belongs to the segment: equal ones are aligned
                sid = xxhash.xxh3_64_intdigest(data[lo : hi + LENGTH], (anchor - lo) & 0xFFFFFFFF)
                rows.append((k1, k2, lo, hi, h, sid - (1 << 64) if sid >> 63 else sid))
                if len(rows) >= 20_000:
                    yield _rows(_ANCHORS, rows)
                    rows = []
            rows += [(k1, k2, a, b, None, None) for a, b in local]
        yield _rows(_ANCHORS, rows)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        packed = [pack(t or "") for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["k1", "k2", "packed"])


_SEGMENT = pa.schema([("h", pa.int64()), ("stripe", pa.int64()), ("sid", pa.int64()), ("copies", pa.int64()), ("at", pa.int64()), ("part", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed segments; those of hot anchors in stripes of windows at similar distance to the anchor, dealt by what they all hold."""
    for b in slices(batches):
        rows = []
        for packed, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = unpack_bytes(packed)
            for w in wanted:
                lo, hi = w["lo"], w["hi"]
                if w["m"] <= HOT:
                    rows.append((w["h"], 0, w["sid"], w["n"], 0, data[lo : hi + LENGTH]))
                    continue
                h = rolling(np.frombuffer(data, np.uint8, hi + LENGTH - lo, lo), GRAM)
                anchor = lo + int(np.flatnonzero(h.view(np.int64) == w["h"])[0])
                edges = sorted({lo, hi + 1, *range(anchor - (anchor - lo) // STRIPE * STRIPE, hi + 1, STRIPE)})
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    k = (anchor - y) // STRIPE
                    core = data[max(0, anchor - STRIPE * k - 1) : anchor - STRIPE * (k + 1) + LENGTH]  # what every window of the stripe holds
                    deal = xxhash.xxh3_64_intdigest(core, k & 0xFFFFFFFF)
                    rows.append((w["h"], deal - (1 << 64) if deal >> 63 else deal, w["sid"], w["n"], x - lo, data[x : y - 1 + LENGTH]))
        yield _rows(_SEGMENT, rows)


_FOUND = pa.schema([("h", pa.int64()), ("sid", pa.int64()), ("runs", _RUN)])


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by (h, stripe); whole groups are gathered until a shard is full."""
    shard, last = Shard(), None
    for b in slices(batches):
        for h, stripe, sid, copies, at, part in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if shard.size >= SHARD and (h, stripe) != last:
                yield _found(shard)
                shard = Shard()
            shard.add(h, stripe, sid, copies, at, part)
            last = (h, stripe)
    yield _found(shard)


def _found(shard: Shard) -> pa.RecordBatch:
    got = shard.windows()
    shard.close()
    return _rows(_FOUND, [(h, sid, [{"a": a, "b": b} for a, b in runs]) for h, sid, runs in got])


def _merge(runs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal removed runs (from, to) of windows given as (first, last) starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + LENGTH))
        else:
            out.append((a, b + LENGTH))
    return [(a, min(b, n)) for a, b in out]


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _RUN)])


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for k1, packed, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            data = unpack_bytes(packed)
            spans = _merge([(lo["lo"] + r["a"], lo["lo"] + r["b"]) for lo in found or [] for r in lo["runs"]], len(data))
            digest, at = hashlib.sha256(), 0
            for x, y in spans:
                digest.update(data[at:x])
                at = y
            digest.update(data[at:])
            rows.append((k1, len(data), sum(y - x for x, y in spans), len(spans), digest.hexdigest(), [{"a": x, "b": y} for x, y in spans]))
        yield _rows(_RESULT, rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document; spans are byte ranges [a, b)."""
    d = docs.select(F.col(id_col).cast("long").alias("k1"), F.col(text_col).alias("text")).select("k1", F.xxhash64("k1", "text").alias("k2"), "text")
    every = materialize(d.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, "k1 long, k2 long, lo long, hi long, h long, sid long"), "anchors")
    anchors = every.where("h IS NOT NULL")
    kinds = anchors.groupBy("h", "sid").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("place"))
    total = anchors.groupBy("h").agg(F.count("*").alias("total")).where("total > 1").drop("total")
    kinds = materialize(kinds.join(total, "h"), "segments")
    mixed = materialize(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    whole = kinds.join(mixed, "h", "left_anti").select("h", "sid", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("place.hi") - F.col("place.lo")).alias("b"))).alias("runs"))
    wanted = kinds.join(mixed, "h").select("place.k1", "place.k2", F.struct("h", "sid", "n", "m", "place.lo", "place.hi").alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    packed = d.mapInArrow(_pack, "k1 long, k2 long, packed binary")
    same = lambda other: F.col("k1").eqNullSafe(F.col(f"{other}1")) & (F.col("k2") == F.col(f"{other}2"))
    once = packed.where(F.length("packed") > 0).join(wanted.toDF("w1", "w2", "wanted"), same("w")).select("packed", "wanted")
    parts = once.mapInArrow(_cut, "h long, stripe long, sid long, copies long, at long, part binary").dropDuplicates(["h", "stripe", "sid", "at"])
    runs = "array<struct<a:bigint,b:bigint>>"
    mixed_runs = parts.repartition("h", "stripe").sortWithinPartitions("h", "stripe").mapInArrow(_sorted_shards, f"h long, sid long, runs {runs}")
    # written before the join: between two plain shuffles, a segment that very many documents share is split
    found = materialize(whole.union(mixed_runs).groupBy("h", "sid").agg(F.flatten(F.collect_list("runs")).alias("runs")), "repeats")
    local = every.where("h IS NULL").select("k1", "k2", "lo", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("hi") - F.col("lo")).alias("b"))).alias("runs"))
    back = anchors.join(found, ["h", "sid"]).select("k1", "k2", "lo", "runs").union(local).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "runs")).alias("found"))
    out = packed.join(back.toDF("b1", "b2", "found"), same("b"), "left").select("k1", "packed", "found")
    return out.mapInArrow(_result, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {runs}")


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"))
