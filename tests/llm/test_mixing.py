import re

import pytest

from threshline.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / (sum(w[s] for s in free) or 1)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * w[s] for s in names}
        full |= set(over)


def test_targets_and_draws(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 5}" if i % 3 else "big", "w " * (i * 7 % 50) + "\tx\x0by é", 1) for i in range(600)] + [(9999, "s0", None, 1), (None, "lone", "a b c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for i, s, t, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s] = size.get(s, 0) + n
    want, taken = brute_targets(size), dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.placements)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 3 + 0.02 * want[s], s
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted((str(r.id), r.taken, str(r.placements)) for r in got) == sorted((str(r.id), r.taken, str(r.placements)) for r in again)
    assert len({p.shard for r in got for p in r.placements}) == 16


def test_the_tree_keeps_quotas_and_balances_shards(spark):
    quota = spark.createDataFrame([(1, 100), (2, 7), (3, 0), (4, 21)], "sid int, quota long")
    got = mixing.split_quotas(quota, 3, 5).collect()
    assert sorted((r.sid, r.slot) for r in got) == [(s, k) for s, q in ((1, 100), (2, 7), (4, 21)) for k in range(1, q + 1)]
    assert {sum(r.shard == k for r in got) for k in range(8)} == {16}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_documents(none).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.taken, r.target) for r in mixing.mix_documents(blank).collect()] == [(0, 0.0)] * 2
