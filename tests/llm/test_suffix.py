import hashlib
import random

import numpy as np
import pytest

from threshline.llm import induce, suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) == 1)
        out.append((len(d), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(90), prose(600)
    texts = [None, "", "short", "a" * 3000, "x" + "ab" * 215 + "y", "z" + "ab" * 201, "-=" * 900 + prose(80), "abc" * 130 + "ab" + prose(60), "ab" * 900, "b" + "a" * 450, base, base, base[:1500] + "X" + base[1501:], base[200:900]]
    texts += [prose(40) + shared + prose(40) for _ in range(12)] + [prose(300) for _ in range(10)]
    for _ in range(6):
        w = base.split()
        for _ in range(8):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + [shared + shared, shared[:399], shared[1:401]]


def naive(t, cap):
    """Suffixes from the largest down without the last symbol's, and the common prefix of each with the one before."""
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist())[1:][::-1]

    def shared(a, b):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        return k

    return order, [0] + [shared(a, b) for a, b in zip(order, order[1:])]


def test_order_and_common_prefixes_of_random_strings(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(500):
        monkeypatch.setattr(induce, "BLOCK", int(rng.choice([2, 3, 7, 1 << 16])))
        n, sigma, cap = int(rng.integers(1, 60)), int(rng.integers(2, 6)), int(rng.integers(1, 20))
        t = np.append(rng.integers(1, sigma, n), 0)
        if trial % 5 == 0:
            t = np.append(np.tile(t[: max(1, n // 4)], 4), 0)
        blocks = list(induce.ordered(t, sigma, cap, induce.Files(int(rng.choice([16, 1 << 30])))))
        assert (np.concatenate([b[0] for b in blocks]).tolist(), np.concatenate([b[1] for b in blocks]).tolist()) == naive(t, cap)


def test_a_shard_far_larger_than_its_memory(monkeypatch):
    """With a limit of 64 KB for arrays and blocks of 2,048 records, 2 MB are sorted through files, to the same marks."""
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 6))) for _ in range(250_000)).encode()
    text += text[5_000:9_000] + text[100_000:100_600]
    parts = [np.frombuffer(text[:900_000], np.uint8), np.frombuffer(text[900_000:], np.uint8)]
    whole = suffix.repeated_windows(parts, 400, induce.Files(1 << 30))
    monkeypatch.setattr(induce, "BLOCK", 2048)
    files = induce.Files(64 << 10)
    small = suffix.repeated_windows(parts, 400, files)
    assert files.made > 20
    assert [w.tolist() for w in small] == [w.tolist() for w in whole]
    assert [len(w) for w in whole] == [3601 + 201, 3601 + 201]


def test_queues_keep_the_order_of_equal_keys(monkeypatch):
    monkeypatch.setattr(induce, "BLOCK", 16)
    rng = np.random.default_rng(3)
    queue, all_, n = induce.Queue(induce.Files(64)), [], 0
    for _ in range(60):
        k = np.sort(rng.integers(0, 9, int(rng.integers(1, 40))))
        queue.push(k, np.arange(n, n + len(k)))
        all_ += zip(k.tolist(), range(n, n + len(k)), strict=True)
        n += len(k)
    got = []
    for key in range(9):
        if key % 2:
            a, b = queue.peek(key + 1)
            queue.drop(key + 1)
            got += zip(a.tolist(), b.tolist(), strict=True)
        else:
            while queue.least() == key:
                a, b = queue.take_equal(key, 11)
                got += zip(a.tolist(), b.tolist(), strict=True)
    assert got == sorted(all_) and queue.least() is None


@pytest.mark.parametrize("unit", ["a", "-=", "abcabd", "x" * 63 + "y", "0123456789" * 8])
def test_texts_that_repeat_themselves(unit):
    """A text of one unit has at most a segment for each few windows; of a very short one few, and its stretch covers every window."""
    data, local = (unit * (100_000 // len(unit))).encode(), []
    found = list(suffix.segments(data, local))
    assert len(found) <= len(data) // suffix.DENSE
    if len(unit) < suffix.DENSE:
        assert len(found) <= 100 and any(a == 0 and b == len(data) - 400 for a, b in local)


def test_equal_windows_have_equal_anchors():
    a, b = (" ".join(f"w{(i * k) % 97}" for i in range(400)).encode() for k in (7, 11))
    shared = bytes(range(32, 127)) * 6
    keys = []
    for text in (a + shared + b, b + shared + a):
        at = text.index(shared)
        keys.append({p - at: (h, anchor - at) for lo, hi, h, anchor in suffix.segments(text) for p in range(lo, hi + 1) if at <= p <= at + len(shared) - 400})
    assert keys[0] == keys[1] and len(keys[0]) == len(shared) - 399


@pytest.mark.parametrize(("hot", "stripe", "passes"), [(2048, 32, 1 << 23), (1, 32, 900), (1, 5, 1 << 23)])
def test_against_brute_force(spark, monkeypatch, hot, stripe, passes):
    monkeypatch.setattr(suffix, "WINDOWS", passes)
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "STRIPE", stripe)
    monkeypatch.setattr(suffix, "PIECE", 700)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_repeated_rows_nulls_and_empty(spark):
    text = "the same long row " * 40
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix.remove_repeats(docs).collect()) == [(0, 0)] + [(720, 720)] * 3
    alone = spark.createDataFrame([(1, "".join(chr(97 + i * i % 26) + str(i) for i in range(400)))], "doc_id long, text string")
    assert [r.n_removed for r in suffix.remove_repeats(alone).collect()] == [0]
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stripes_keep_equal_windows_together(monkeypatch):
    """Windows at one distance to the anchor always share a stripe, wherever their segments begin and end."""
    import pyarrow as pa

    monkeypatch.setattr(suffix, "HOT", 0)
    text = " ".join(f"w{i * i % 1009}" for i in range(500)).encode()
    seen = {}
    for cut in (0, 1, 7, 31, 32, 33, 64, 100, 150):
        data = text[cut:]
        packed = suffix.pack(data.decode())
        for lo, hi, h, anchor in suffix.segments(data):
            batch = pa.RecordBatch.from_arrays([pa.array([packed]), pa.array([[{"h": h, "sid": 1, "n": 1, "m": 9, "lo": lo, "hi": hi}]])], names=["packed", "wanted"])
            rows = next(suffix._cut(iter([batch]))).to_pylist()
            assert sum(len(r["part"]) - 399 for r in rows) == hi - lo + 1
            for r in rows:
                for p in range(lo + r["at"], lo + r["at"] + len(r["part"]) - 399):
                    assert seen.setdefault((h, anchor - p), r["stripe"]) == r["stripe"]
