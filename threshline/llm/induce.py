"""External induced sorting: suffixes with their common prefixes, through queues that live on disk.

A string of symbols (the last one 0 and the only one) is sorted by recursion:

1. Leftmost S-type positions cut it into pieces. The pieces go through a queue
   by their first symbols, are compared further where these are equal, and named.
2. The string of names is sorted by the same procedure, unless all differ. Its
   common prefixes, counted in names, become common prefixes in symbols: the
   equal pieces' length, and a comparison of what follows them.
3. The sorted S-type positions induce the L-type suffixes, front to back, and
   these all S-type ones, back to front. Each is a priority queue of tuples
   (symbol, position, common prefix with the one before it in its bucket): what
   is taken out pushes its predecessor, whose common prefix is one more than
   the least among all taken out since the last push to that bucket.

A queue is a few sorted runs, each half as long as the one before at most;
runs are merged block by block. Whatever is longer than the given number
of bytes is a file that disappears with its last reader, so memory holds a
few such arrays and blocks of ``BLOCK`` records, however long the string is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Records that are processed at once.
BLOCK = 1 << 16
_TOP = np.iinfo(np.int32).max


class Files:
    """Arrays in memory, or in files of the task's own folder where they are longer than ``limit`` bytes."""

    def __init__(self, limit: int) -> None:
        self.limit, self.made = limit, 0

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.limit:
            return np.zeros(n, dtype)
        self.made += 1
        with tempfile.TemporaryFile() as f:  # the mapping keeps the space, which is freed with it
            f.truncate(n * np.dtype(dtype).itemsize)
            return np.memmap(f, dtype, "r+", shape=(n,))


class Queue:
    """Records (key, columns...) taken out by key, those of one key in the order in which they were put in."""

    def __init__(self, files: Files) -> None:
        self.files = files
        self.runs: list[list] = []  # [columns, first open record], older runs first

    def push(self, *cols: np.ndarray) -> None:
        """Records sorted by the first column."""
        if len(cols[0]):
            self.runs.append([cols, 0])
            while len(self.runs) > 1 and len(self.runs[-2][0][0]) - self.runs[-2][1] < 2 * (len(self.runs[-1][0][0]) - self.runs[-1][1]):
                b, a = self.runs.pop(), self.runs.pop()
                self.runs.append([self._merge(a, b), 0])

    def _merge(self, a: list, b: list) -> tuple:
        (x, i), (y, j) = a, b
        n, m = len(x[0]) - i, len(y[0]) - j
        if n + m <= BLOCK:
            by = np.argsort(np.concatenate((x[0][i:], y[0][j:])), kind="stable")
            return tuple(np.concatenate((u[i:], v[j:]))[by] for u, v in zip(x, y, strict=True))
        out = tuple(self.files.array(n + m, u.dtype) for u in x)
        at = 0
        while i < len(x[0]) or j < len(y[0]):
            ends = [int(c[0][min(k + BLOCK // 2, len(c[0])) - 1]) for c, k in ((x, i), (y, j)) if k < len(c[0])]
            top = min(ends)  # all records below it, and then those equal to it, older ones first
            for side in ("left", "right"):
                p, q = i + int(np.searchsorted(x[0][i:], top, side)), j + int(np.searchsorted(y[0][j:], top, side))
                if side == "right":
                    for cols, lo, hi in ((x, i, p), (y, j, q)):
                        for u, v in zip(out, cols, strict=True):
                            u[at : at + hi - lo] = v[lo:hi]
                        at += hi - lo
                elif p + q > i + j:
                    by = np.argsort(np.concatenate((x[0][i:p], y[0][j:q])), kind="stable")
                    for o, u, v in zip(out, x, y, strict=True):
                        o[at : at + len(by)] = np.concatenate((u[i:p], v[j:q]))[by]
                    at += len(by)
                i, j = p, q
        return out

    def least(self) -> int | None:
        return min((int(cols[0][at]) for cols, at in self.runs), default=None)

    def count(self, end: int) -> int:
        return sum(int(np.searchsorted(cols[0][at:], end)) for cols, at in self.runs)

    def peek(self, end: int) -> tuple[np.ndarray, ...] | None:
        """All records with a key below the end, in order."""
        parts = [(cols, at, at + int(np.searchsorted(cols[0][at:], end))) for cols, at in self.runs]
        parts = [p for p in parts if p[2] > p[1]]
        if not parts:
            return None
        if len(parts) == 1:
            cols, a, b = parts[0]
            return tuple(np.asarray(c[a:b]) for c in cols)
        keys = np.concatenate([cols[0][a:b] for cols, a, b in parts])
        by = np.argsort(keys, kind="stable")
        return (keys[by], *(np.concatenate([cols[i][a:b] for cols, a, b in parts])[by] for i in range(1, len(parts[0][0]))))

    def drop(self, end: int) -> None:
        for run in self.runs:
            run[1] += int(np.searchsorted(run[0][0][run[1] :], end))
        self.runs = [r for r in self.runs if r[1] < len(r[0][0])]

    def take_equal(self, key: int, most: int) -> tuple[np.ndarray, ...] | None:
        """At most so many records of one key that is the least, taken out."""
        got: list[tuple] = []
        for run in self.runs:
            cols, at = run
            n = min(most, int(np.searchsorted(cols[0][at:], key, "right")))
            if n:
                got.append(tuple(np.asarray(c[at : at + n]) for c in cols))
                run[1] += n
                most -= n
            if not most:
                break
        self.runs = [r for r in self.runs if r[1] < len(r[0][0])]
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else None


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, cut at ``most``; both end before the text does."""
    out, alive, n = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), len(text)
    step = 1
    while len(alive):
        # symbols are compared in doubling strides, and one by one where a stride differs
        x, y = a[alive] + out[alive], b[alive] + out[alive]
        width = min(step, 64)
        at = np.arange(width)
        same = text[np.minimum(x[:, None] + at, n - 1)] == text[np.minimum(y[:, None] + at, n - 1)]
        same &= (x[:, None] + at < n) & (y[:, None] + at < n)
        run = np.where(same.all(1), width, same.argmin(1))
        out[alive] += run
        alive = alive[(run == width) & (out[alive] < most[alive])]
        step *= 4
    return np.minimum(out, most)


class _Minima:
    """Least common prefix since the last push to a bucket, over blocks of which only the minima are kept."""

    def __init__(self, sigma: int, files: Files) -> None:
        self.block = files.array(sigma, np.int32)  # block of the last push, from 1
        self.tail = files.array(sigma, np.int32)  # least value after it in that block
        self.now = 1
        self.at, self.low = [1], [_TOP]  # blocks from which on the least value is this, rising

    def lcps(self, lcp: np.ndarray, who: np.ndarray, to: np.ndarray, cap: int) -> np.ndarray:
        """Common prefixes of pushed suffixes, sorted by bucket: ``who`` are their sources in the open block of these values."""
        first = np.ones(len(to), bool)
        np.not_equal(to[1:], to[:-1], out=first[1:])
        heads = first.nonzero()[0]
        got = np.minimum.accumulate(lcp)[who]
        if len(heads) < len(to):
            rest = (~first).nonzero()[0]
            got[rest] = self._least(lcp, who[rest - 1] + 1, who[rest] + 1)
        bucket = to[heads]
        old = np.asarray(self.block[bucket])
        since = np.minimum(self.tail[bucket], np.array(self.low)[np.searchsorted(self.at, old, "right").clip(max=len(self.at) - 1)])
        got[heads] = np.where(old > 0, np.minimum(got[heads], since), -1)  # the first of its bucket shares nothing
        after = np.minimum.accumulate(np.append(lcp, _TOP)[::-1])[::-1]
        self.tail[bucket] = after[who[np.append(heads[1:], len(to)) - 1] + 1]
        self.block[bucket] = self.now
        return np.minimum(got + 1, cap)

    @staticmethod
    def _least(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of each lcp[a:b], none empty, from tables of the least of 2, 4, 8... neighbours."""
        size = b - a
        level = np.frexp(size)[1] - 1
        table = np.empty((int(level.max()) + 1, len(lcp)), lcp.dtype)
        table[0] = lcp
        for k in range(1, len(table)):
            w = 1 << (k - 1)
            np.minimum(table[k - 1, :-w], table[k - 1, w:], out=table[k, :-w])
        return np.minimum(table[level, a], table[level, b - (1 << level)])

    def close(self, lcp: np.ndarray) -> None:
        """The block is done."""
        low = int(lcp.min())
        while len(self.low) > 1 and self.low[-2] >= low:
            del self.at[-2], self.low[-2]
        self.at[-1:], self.low[-1:] = [self.now, self.now + 1], [low, _TOP]
        self.now += 1


def _induced(text: np.ndarray, sigma: int, seeds: tuple[np.ndarray, ...], cap: int, files: Files, flip: bool, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(symbol, position, common prefix with the one before) of what seeds (the same, sorted) induce, in order, in blocks.

    Within a bucket what is induced comes before the seeds, which are returned too if ``both``.
    With ``flip`` all runs from the largest symbol down.
    """
    queue, minima = Queue(files), _Minima(sigma, files)
    keys = seeds[0]
    at, wide = 0, 1
    last = (-1, -1, False)  # symbol and position of the last one taken out, and whether it was a seed

    def before(pos: np.ndarray) -> np.ndarray:
        d = np.asarray(text[np.maximum(pos - 1, 0)]).astype(np.int64)
        return sigma - 1 - d if flip else d

    def settle(key: np.ndarray, pos: np.ndarray, lcp: np.ndarray, seeded: np.ndarray, d: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fix the values at seams, push the predecessors, and return what was taken out."""
        nonlocal last
        back = np.concatenate(([last[0]], key[:-1]))
        other = key != back
        was = np.concatenate(([last[2]], seeded[:-1]))
        seam = (seeded & ~was & ~other).nonzero()[0]  # a seed after what was induced
        lcp = lcp.copy()
        lcp[other] = 0
        if len(seam):
            prior = np.concatenate(([last[1]], pos[:-1]))[seam]
            lcp[seam] = common(text, prior, pos[seam], np.full(len(seam), cap))
        who = ok.nonzero()[0]
        if len(who):
            by = np.argsort(d[who], kind="stable")
            who = who[by]
            to = d[who]
            queue.push(to, pos[who] - 1, minima.lcps(lcp, who, to, cap).astype(np.int32))
        minima.close(lcp)
        last = (int(key[-1]), int(pos[-1]), bool(seeded[-1]))
        own = slice(None) if both else ~seeded
        return key[own], pos[own], lcp[own]

    while True:
        c = queue.least()
        if at < len(keys):
            c = int(keys[at]) if c is None else min(c, int(keys[at]))
        if c is None:
            return
        stop = at
        while True:
            end = c + wide
            stop = at + int(np.searchsorted(keys[at : at + BLOCK + 1], end))
            if wide == 1 or stop - at + queue.count(end) <= BLOCK:
                break
            wide = max(1, wide // 2)
        single = wide == 1
        if not single:
            q = queue.peek(end)
            s = tuple(np.asarray(x[at:stop]) for x in seeds)
            n = 0 if q is None else len(q[0])
            key, pos, lcp = s if q is None else (np.concatenate((u, v)) for u, v in zip(q, s, strict=True))
            seeded = np.arange(len(key)) >= n
            by = np.argsort(key, kind="stable")
            key, pos, lcp, seeded = key[by], pos[by], lcp[by], seeded[by]
            d = before(pos)
            ok = (pos > 0) & ((d > key) | ((d == key) & ~seeded))
            near = int(d[ok].min()) if ok.any() else end
            if near >= end:
                queue.drop(end)
                at, wide = stop, wide * 2
                yield settle(key, pos, lcp, seeded, d, ok)
                continue
            wide = max(1, near - c)  # the buckets before it push nothing among themselves
            single = near == c
            if not single:
                continue
        # one bucket: what is induced, in rounds as it may push to itself, and then its seeds
        while (got := queue.take_equal(c, BLOCK) if queue.least() == c else None) is not None:
            key, pos, lcp = got
            d = before(pos)
            yield settle(key, pos, lcp, np.zeros(len(key), bool), d, (pos > 0) & (d >= key))
        while at < len(keys) and keys[at] == c:
            stop = at + int(np.searchsorted(keys[at : at + BLOCK], c, "right"))
            key, pos, lcp = (np.asarray(x[at:stop]) for x in seeds)
            at = stop
            d = before(pos)
            yield settle(key, pos, lcp, np.ones(len(key), bool), d, (pos > 0) & (d > key))
        wide = 2


def _gathered(blocks: Iterator[tuple[np.ndarray, ...]], n: int, files: Files, types: tuple) -> tuple[tuple[np.ndarray, ...], int]:
    out, at = tuple(files.array(n, t) for t in types), 0
    for b in blocks:
        for o, x in zip(out, b, strict=True):
            o[at : at + len(x)] = x
        at += len(b[0])
    return out, at


def _cuts(text: np.ndarray, files: Files) -> np.ndarray:
    """The leftmost S-type positions, in order, the last symbol's among them; blocks are read from the back."""
    n = len(text)
    found, right, small = [np.array([n - 1])], int(text[n - 1]), True
    for lo in range((n - 2) // BLOCK * BLOCK, -1, -BLOCK) if n > 1 else ():
        t = np.append(np.asarray(text[lo : min(lo + BLOCK, n - 1)]).astype(np.int64), right)
        m = len(t) - 1
        change = np.where(t[1:] != t[:-1], np.arange(m), m)
        nxt = np.minimum.accumulate(change[::-1])[::-1]
        s = np.append(np.where(nxt < m, t[np.minimum(nxt + 1, m)] > t[np.minimum(nxt, m)], small), small)
        lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1 + lo
        found.append(lms if lo + m < n - 1 else lms[lms < n - 1])
        right, small = int(t[0]), bool(s[0])
    out, at = files.array(sum(map(len, found)), np.int64), 0
    for f in reversed(found):
        out[at : at + len(f)] = f
        at += len(f)
    return out


def _names(text: np.ndarray, sigma: int, cuts: np.ndarray, files: Files) -> tuple[np.ndarray, int]:
    """A name for the piece at each cut, by the order of the pieces (equal ones share theirs), and how many there are."""
    bits = int(sigma + 1).bit_length()
    per = max(1, 62 // bits)
    n = len(text)

    def key(own: np.ndarray, step: int) -> np.ndarray:
        """The next symbols of the pieces; the end of one comes after all symbols."""
        start = np.asarray(cuts[own])
        size = np.where(own + 1 < len(cuts), np.asarray(cuts[np.minimum(own + 1, len(cuts) - 1)]) - start + 1, 1)
        out = np.zeros(len(own), np.int64)
        for j in range(step * per, step * per + per):
            got = np.asarray(text[np.minimum(start + j, n - 1)]).astype(np.int64)
            out = (out << bits) | np.where(j < size, got, sigma)
        return out

    queue = Queue(files)
    for lo in range(0, len(cuts), BLOCK):
        own = np.arange(lo, min(lo + BLOCK, len(cuts)))
        k = key(own, 0)
        by = np.argsort(k, kind="stable")
        queue.push(k[by], own[by])
    names, count = files.array(len(cuts), np.int64), 0
    ended = (1 << bits) - 1
    wide = 1
    while (least := queue.least()) is not None:
        while wide > 1 and queue.count(least + wide) > BLOCK:
            wide //= 2
        k, own = queue.peek(least + wide)
        queue.drop(least + wide)
        wide = min(wide * 4, 1 << 60)
        new = np.concatenate(([True], k[1:] != k[:-1]))
        # groups of equal symbols go on until their pieces end
        open_ = np.flatnonzero(((k & ended) != sigma) & ~(new & np.append(new[1:], True)))
        step = 1
        while len(open_):
            group = np.cumsum(new)[open_]
            more = key(own[open_], step)
            by = np.lexsort((more, group))
            own[open_] = own[open_][by]
            group, more = group[by], more[by]
            differs = np.concatenate(([True], (group[1:] != group[:-1]) | (more[1:] != more[:-1])))
            new[open_] |= differs
            alone = new[open_] & np.append(new[open_][1:] | (group[1:] != group[:-1]), True)
            open_ = open_[((more & ended) != sigma) & ~alone]
            step += 1
        names[own] = count + np.cumsum(new) - 1
        count += int(new.sum())
    return names, count


def _turned(lcp: np.ndarray, out: np.ndarray, at: int) -> None:
    """Common prefixes with the one before, put into ``out`` back to front up to ``at``: each then belongs to the other of its pair."""
    room = min(at + 1, len(out)) - (at - len(lcp) + 1)
    out[at - len(lcp) + 1 : at + 1] = lcp[::-1][:room]


def ordered(text: np.ndarray, sigma: int, cap: int, files: Files) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, common prefix with the one before, at most ``cap``) of all suffixes but the last symbol's, from the largest down."""
    if len(text) < 2:
        return
    cuts = _cuts(text, files)
    m = len(cuts)
    names, count = _names(text, sigma, cuts, files)
    rank = files.array(m, np.int64)
    lcp = files.array(m, np.int32)
    if count == m:
        for lo in range(0, m, BLOCK):
            rank[names[lo : lo + BLOCK]] = np.arange(lo, min(lo + BLOCK, m))
    else:
        at = m
        for pos, shared in ordered(names, count, cap // 2 + 1, files):
            rank[at - len(pos) : at] = pos[::-1]
            _turned(shared, lcp, at)
            at -= len(pos)
        rank[0] = m - 1
    for lo in range(1, m, BLOCK):  # from names to symbols
        hi = min(lo + BLOCK, m)
        i, j, same = np.asarray(rank[lo - 1 : hi - 1]), np.asarray(rank[lo:hi]), np.asarray(lcp[lo:hi]).astype(np.int64)
        same[(i == m - 1) | (j == m - 1)] = 0
        a, b = np.asarray(cuts[i + same]), np.asarray(cuts[j + same])
        done = a - np.asarray(cuts[i])
        lcp[lo:hi] = np.minimum(cap, done + common(text, a, b, np.maximum(0, cap - done)))
    place, first = files.array(m, np.int64), files.array(m, np.int64)
    for lo in range(0, m, BLOCK):
        place[lo : lo + BLOCK] = cuts[rank[lo : lo + BLOCK]]
        first[lo : lo + BLOCK] = text[place[lo : lo + BLOCK]]
    del rank, names
    (key, pos, shared), n = _gathered(_induced(text, sigma, (first, place, lcp), cap, files, False, False), len(text), files, (np.int64, np.int64, np.int32))
    # the same from the back: each value goes to the other one of its pair
    back = tuple(files.array(n, t) for t in (np.int64, np.int64, np.int32))
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        back[0][n - hi : n - lo] = sigma - 1 - np.asarray(key[lo:hi])[::-1]
        back[1][n - hi : n - lo] = np.asarray(pos[lo:hi])[::-1]
        _turned(np.asarray(shared[lo:hi]), back[2], n - lo)
    del key, pos, shared
    for _, p, s in _induced(text, sigma, back, cap, files, True, True):
        yield p, s
