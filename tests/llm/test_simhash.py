import numpy as np
import pandas as pd
import xxhash

from threshline.llm import simhash

TEXTS = [None, "", "  \n", "one", "One two", "a b c d", "a b c d", "a b c e", *[f"the quick brown fox {i % 7} jumps over the lazy dog and runs away from {i}" for i in range(40)], "x " * 30000, "é è É Z"]


def brute(text, k=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) > len(s))


def parts(ids, fps, r):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= r:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(ids))}


def test_masks_cover_every_small_difference():
    rng = np.random.default_rng(1)
    for r in (2, 4):
        masks = [m & (2**64 - 1) for m in simhash.covering_masks(r)]
        assert len(masks) == 2 ** (r + 1) - 1
        for _ in range(2000):
            diff = sum(1 << int(b) for b in rng.choice(64, r, replace=False))
            assert any(not diff & m for m in masks)


def test_against_brute_force(spark):
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()}
    want = {i: brute(t) for i, t, _ in rows}
    assert {i: f for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == parts(list(want), list(want.values()), 4)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 50)
    rng = np.random.default_rng(2)
    fps = {int(rng.integers(0, 1 << 62)) for _ in range(30)}
    hub = int(rng.integers(0, 1 << 62))
    for _ in range(300):
        fps.add(hub ^ sum(1 << int(b) for b in rng.choice(60, 2, replace=False)))
    fps = sorted(fps)
    from threshline.llm.common import components

    found = {r.u: r.root for r in components(simhash.links(spark.createDataFrame(pd.DataFrame({"fp": fps})))).collect()}
    want = parts(fps, fps, 4)
    assert {f: found.get(f, f) for f in fps} == want


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    assert sorted((r.id or 0, r.component) for r in simhash.near_duplicates(rows).collect()) == [(0, 5), (5, 5), (5, 5)]


def brute_stay(rows, similarity=0.8, words=5):
    """Greedy by id: a text goes if one that stays before it is as similar."""
    def sh(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    stay = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = sh(t)
        if not any((not s and not o) or (len(s & o) / (len(s | o) or 1)) >= similarity for _, o in stay):
            stay.append((i, s))
    return sorted(str(i) for i, _ in stay)


def near_corpus():
    rng = np.random.default_rng(3)
    prose = lambda n: [f"w{int(x)}" for x in rng.integers(0, 4000, n)]
    rows = []
    for g in range(12):
        base = prose(160)
        rows.append((g * 100, " ".join(base)))
        for c in range(6):
            w = list(base)
            for _ in range(1 + c % 3):
                w[int(rng.integers(0, 160))] = "changed"
            rows.append((g * 100 + 1 + c, " ".join(w)))
    rows += [(5000 + i, " ".join(prose(50))) for i in range(40)]
    return [*rows, (6000, None), (6001, ""), (6002, "tiny text"), (6003, "Tiny  text"), (None, rows[0][1])]


def test_one_of_each_group_stays(spark, monkeypatch):
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, _k1 double")
    for limit in (32 << 20, 100):
        monkeypatch.setattr(simhash, "COMPONENT", limit)
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        got, want = {str(r.doc_id) for r in kept.collect()}, set(brute_stay(rows))
        # a copy at the edge of the similarity may have a fingerprint beyond the radius
        assert want <= got and len(got - want) <= 3


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()) == [(1, "a b c d e f"), (1, "other words here now")]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
