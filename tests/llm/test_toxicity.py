import random

from threshline.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    bad = [*toxicity.INSULTS.split(), *toxicity.CONTEMPT.split()]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(60)] = rng.choice(bad) if rng.random() < 0.7 else "qxlow" + rng.choice("abcdefgh") * 2
        rows.append((i, " ".join(w).title(), int(toxic)))
    return rows


def test_held_out_accuracy_and_chain(spark):
    train, test = corpus(900, 1), corpus(400, 2)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in train], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    p = chain.scores([t for _, t, _ in test])
    said = p[:, 2] >= chain.threshold
    assert sum(bool(s) == bool(y) for s, (_, _, y) in zip(said, test, strict=True)) >= 0.95 * len(test)
    assert chain.links[2, :2].any() and not chain.links[0].any()
    again = toxicity.fit(docs.repartition(5), labels)
    assert (again.weights == chain.weights).all() and again.threshold == chain.threshold


def test_the_filter_and_edge_cases(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, None, 1.0), (7000, "", 1.0), (7001, "Fine words " * 20000, 1.0)], "doc_id long, text string, _p double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 7000, 7001} <= ids
    clean = {i for i, _, y in rows if not y}
    assert len(clean & ids) >= 0.98 * len(clean) and len(ids - clean) < 25
    none = labels.limit(0)
    assert toxicity.reject_toxic(docs, none).count() == docs.count()
    assert toxicity.reject_toxic(docs.limit(0), labels).count() == 0
