import time

import pytest

from threshline.llm import secrets

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark, 2400), trees=15)


def test_held_out_accuracy(spark, model):
    held = secrets.with_features(secrets.labelled_findings(spark, 1600, seed=99))
    judged = model.transform(held).select("secret", "prediction").collect()
    right = sum(r.secret == r.prediction for r in judged)
    assert right >= 0.93 * len(judged)
    found = sum(r.prediction for r in judged if r.secret)
    assert found >= 0.93 * sum(r.secret for r in judged)


def test_candidates_and_verdicts(spark, model):
    texts = {
        1: f'foo token = "{HEX}" bar',
        2: f"commit {HEX} by me",
        3: "see /static/images/background-2021.png for thebackgroundimageversion2021",
        4: None,
        5: "",
        6: 'password: "hunter2xZ91"',
        7: "A" * 5000 + "1 and api_key=your_api_key_here123",
        8: "words only in here, nothing else at all",
        9: f"token={HEX}, secret: {HEX}",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[1], "y"), (1, texts[1], "x")], "doc_id long, text string, value string")
    rows = secrets.scan(docs, model).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
        if r.id is not None:
            assert texts[r.id][r.start : r.start + len(r.value)] == r.value
    assert [r.value for r in by[9]] == [HEX, HEX] and len(by[1]) == 2 and len(by[None]) == 1
    assert not {4, 5, 8} & set(by)
    yes = lambda i, v: next(r.score >= 0.5 for r in by[i] if r.value == v)
    assert yes(1, HEX) and not yes(2, HEX) and yes(9, HEX)
    assert not any(r.score >= 0.5 for r in by[3]) and yes(6, "hunter2xZ91")
    assert not any(r.score >= 0.5 for r in by[7])


def test_empty(spark, model):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_key_words_inside_names(spark):
    forms = [("DB_PASSWORD=", "correcthorsebattery"), ("client_secret=", "CorrectHorseBattery"), ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMIK7MDENGbPxRfiCYzzzz"), ("access_token=", HEX), ("/etc/app.d/my_api_key: ", "abc123xyz789"), ("sum ", "QUJDREVGR0hJSktMTU5PUA==")]
    docs = spark.createDataFrame([(i, f"export {k}{v} end") for i, (k, v) in enumerate(forms)], "doc_id long, text string")
    got = {r.id: r for r in secrets.candidates(docs).collect()}
    for i, (key, value) in enumerate(forms):
        assert (got[i].value, got[i].start, got[i].before) == (value, len("export " + key), "export " + key)


def test_very_many_candidates_in_one_text(spark):
    """The place of each candidate comes from blocked sums: cost does not grow with the square of their number."""
    n = 60_000
    docs = spark.createDataFrame([(1, "é abc1def2ghi3jkl4mno" * 1 + " abc1def2ghi3jkl4mno" * n)], "doc_id long, text string")
    began = time.time()
    r = secrets.candidates(docs).selectExpr("count(*) AS n", "min(start) AS lo", "max(start) AS hi", "count(DISTINCT start) AS places").first()
    assert (r.n, r.lo, r.hi, r.places) == (n + 1, 2, 2 + 20 * n, n + 1)
    assert time.time() - began < 120
