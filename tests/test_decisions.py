import pytest
from pyspark.sql import functions as F

from threshline import engine
from threshline.functions import dims
from threshline.operators import evaluation, fusion, insights, links, model, reputation

BASE = {"p_text": 0.6, "p_url": 0.5, "p_meta": 0.3, "text_used": True, "trusted_sender": False, "crypto_verified": False, "inbox_soft": False, "outlook_internal": False, "strong_link": False, "links_elsewhere": False, "rep_max": 0.0, "rep_sources": []}
SCHEMA = "id int, p_text double, p_url double, p_meta double, text_used boolean, trusted_sender boolean, crypto_verified boolean, inbox_soft boolean, outlook_internal boolean, strong_link boolean, links_elsewhere boolean, rep_max double, rep_sources array<string>"
GSB = ["google_safe_browsing"]
CASES = [
    ({}, (False, "default", [])), ({"p_text": 0.9}, (True, "default", ["confident_text"])), ({"p_text": 0.99, "text_used": False}, (False, "default", [])), ({"p_url": 0.94, "p_meta": 0.05, "p_text": 0.0}, (False, "default", [])),
    ({"p_url": 0.95, "p_meta": 0.05, "p_text": 0.0, "strong_link": True}, (True, "default", ["confirmed_link"])), ({"p_text": 0.99, "p_meta": 0.99, "p_url": 0.0, "trusted_sender": True}, (False, "trusted_sender", [])), ({"trusted_sender": True, "rep_max": 1.0, "rep_sources": GSB}, (True, "trusted_sender", ["safe_browsing"])),
    ({"crypto_verified": True, "links_elsewhere": True, "p_text": 0.5}, (True, "crypto_verified", ["links_elsewhere"])), ({"crypto_verified": True, "links_elsewhere": True, "p_text": 0.4}, (False, "crypto_verified", [])), ({"inbox_soft": True, "outlook_internal": True}, (False, "outlook_internal", [])), ({"inbox_soft": True}, (False, "gmail_inbox_soft", [])),
    ({"rep_max": 1.0, "rep_sources": GSB, "p_text": 0.1, "p_meta": 0.1, "p_url": 0.1}, (False, "default", [])),
]


def test_mail_verdicts(spark):
    rows = [(i, *(BASE | c).values()) for i, (c, _) in enumerate(CASES)]
    got = {r.id: (r.is_phishing, r.trust_path, r.forced_by) for r in fusion.decide_email(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    fused = fusion.decide_email(spark.createDataFrame(rows[:1], SCHEMA)).first().fused
    assert fused == pytest.approx(0.34 * 0.6 + 0.33 * 0.5 + 0.33 * 0.3)


def test_reputation_lifts_the_link_score(spark):
    d = spark.createDataFrame([(0.1, 1.0), (0.1, 0.8), (0.99, 1.0), (0.4, 0.0)], "p double, r double")
    assert [round(x[0], 6) for x in d.select(fusion.apply_reputation(F.col("p"), F.col("r"))).collect()] == [0.95, round(0.7 * 0.8 + 0.03, 6), 0.99, 0.4]


def test_attachment_verdicts(spark):
    cases = [
        (["contains_form", "contains_password_field"], False, 0.65, True), (["contains_macros"], True, 0.45, True), (["disk_image_attachment"], False, 0.40, False), (["contains_form"], True, 0.15, False),
        (["contains_macros", "remote_template", "dde_field"], False, 0.7, True), (["calendar_invite", "no_such"], False, 0.0, False), ([], False, 0.0, False),
    ]
    rows = [(i, 0.1, 0.1, f, t, 0.0, [], 0.0) for i, (f, t, _, _) in enumerate(cases)]
    d = fusion.decide_attachment(spark.createDataFrame(rows, "id int, p_text double, p_url double, flags array<string>, parent_trusted boolean, rep_max double, rep_sources array<string>, url_rule_score double"))
    assert {r.id: (round(r.feature_bonus, 6), r.is_phishing) for r in d.collect()} == {i: (b, v) for i, (_, _, b, v) in enumerate(cases)}


def test_link_ranking_rules(spark):
    rows = [(1, 0, 0, "https://a.x/1"), (1, 0, 1, "https://a.x/2"), (1, 0, 2, "https://b.x/1"), (1, 1, 0, "https://a.x/1"), (1, 1, 1, "https://c.x/1"), (1, 1, 2, "https://a.x/3")]
    d = spark.createDataFrame(rows, "mail_id int, grp int, pos int, url string")
    got = [r.url for r in links.rank_links(d).orderBy("rank").collect()]
    assert got == ["https://a.x/1", "https://b.x/1", "https://a.x/2", "https://c.x/1", "https://a.x/3"]
    assert links.rank_links(d, limit=2).count() == 2
    kept = [r.url for r in links.rank_links(d, ranked=F.col("grp") == 0).orderBy("rank").collect()]
    assert kept[:3] == ["https://a.x/1", "https://a.x/2", "https://b.x/1"]


def test_link_agent(spark):
    rows = [(1, 0, 0, "http://1.2.3.4/"), (2, 0, 0, "https://fine.example/a"), (2, 0, 1, "https://hidden.tk/")]
    bodies = spark.createDataFrame([(1, "see http://1.2.3.4/"), (2, "see https://fine.example/a"), (3, "no links")], "mail_id int, body string")
    got = {r.mail_id: round(r.p_url, 2) for r in links.url_agent(spark.createDataFrame(rows, "mail_id int, grp int, pos int, url string"), bodies).collect()}
    assert got == {1: 0.65, 2: 0.30, 3: 0.05}


def test_cascade_and_cache(spark):
    u = spark.createDataFrame([("https://gsb.x/",), ("https://phish.x/a",), ("https://phish.x/b",), ("https://docs.google.com/b",), ("both.x",), ("https://cached.x/",), ("https://clean.x/",)], "url string")
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    cache = t([("https://cached.x/", True, 1.0, ["urlhaus"], ["MALWARE"])], "url string, malicious boolean, score double, sources array<string>, threat_types array<string>")
    v = reputation.cascade(u, t([("https://gsb.x/", "MALWARE")], "url string, threat_type string"), t([("https://phish.x/a",)], "url string"), t([("phish.x",), ("docs.google.com",)], "host string"), t([("http://both.x",)], "url string"), t([("both.x", "SPAM")], "domain string, threat_type string"), cache)
    got = {r.url: (r.score, r.sources, r.cached) for r in v.collect()}
    assert got["https://gsb.x/"] == (1.0, GSB, False) and got["https://phish.x/a"][1] == ["phishtank"] and got["https://phish.x/b"] == (pytest.approx(0.6), ["phishtank"], False)
    assert got["https://docs.google.com/b"][0] == 0 and got["http://both.x"] == (1.0, ["urlhaus", "spamhaus_dbl"], False) and got["https://cached.x/"] == (1.0, ["urlhaus"], True)
    assert {r.url for r in reputation.cacheable(v).collect()} == set(got) - {"https://cached.x/"}


def test_quota_is_all_or_nothing(spark):
    d = spark.createDataFrame([("2024-01-01 00:00:00", 1, 80), ("2024-01-01 00:01:00", 2, 20), ("2024-01-01 00:02:00", 3, 10), ("2024-01-02 00:00:00", 4, 90)], "ts string, id long, n long").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id: r.admitted for r in reputation.admit_quota(d, 100, 10).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_confusion_and_intervals(spark):
    rows = [("1", "en", "phishing", "phishing", None), ("2", "en", "phishing", "safe", None), ("3", "fr", "phishing", "phishing", None), ("4", "en", "legit", "phishing", None), ("5", "fr", "legit", "safe", None), ("6", "fr", "legit", "safe", "HTTP 413")]
    run = spark.createDataFrame(rows, "id string, lang string, label string, verdict string, error string")
    got = {r.lang: (r.tp, r.fn, r.fp, r.tn) for r in evaluation.confusion_by_language(run).collect()}
    assert got == {"all": (2, 1, 1, 1), "en": (1, 1, 1, 0), "fr": (1, 0, 0, 1)}
    d = spark.createDataFrame([(0, 81), (1804, 2000), (0, 0)], "k long, n long").select(evaluation.share_text(F.col("k"), F.col("n")))
    assert [r[0] for r in d.collect()] == ["0.0% (0/81, 95% CI 0.0% to 4.5%)", "90.2% (1804/2000, 95% CI 88.8% to 91.4%)", "n/a"]
    assert {r.id for r in evaluation.fixed_sample(run.select("label", "id"), 1).collect()} == {"1", "4"}


def test_history(spark):
    rows = [(1, "2024-02-01 10:00:00", "gmail", "phishing", 0.9, "correct", [("Verify", 0.5), ("25px", 3.0)]), (2, "2024-02-01 11:00:00", "gmail", "phishing", 0.8, "wrong", [("verify", -0.25)]), (3, "2024-02-03 11:00:00", None, "safe", 0.1, None, [("verify", 9.0)])]
    d = spark.createDataFrame(rows, "id int, ts string, source string, verdict string, score double, label string, tokens array<struct<token:string,weight:double>>").withColumn("ts", F.to_timestamp("ts"))
    t = insights.totals(d).first()
    assert (t.total, t.phishing, t.phishing_pct, t.safe_pct) == (3, 2, 67, 33)
    assert [(r.token, r.weight) for r in insights.top_tokens(d, []).collect()] == [("verify", 0.75)]
    days = insights.daily(d, F.to_date(F.lit("2024-02-03"))).collect()
    assert len(days) == 30 and sum(r.phishing for r in days) == 2
    assert {r.source: r.n for r in insights.by_source(d).collect() if r.n} == {"gmail": 2, "unknown": 1}
    live = evaluation.confusion(d).first()
    assert (live.tp, live.fp, live.tn, live.fn, live.accuracy, live.recall) == (1, 1, 0, 0, 0.5, 1.0)


def test_analyse_end_to_end(spark):
    good = "mx; dkim=pass header.d=paypal.com; spf=pass smtp.mailfrom=paypal.com; dmarc=pass header.from=paypal.com"
    mail = [(1, "hello there my friend", "PayPal <service@paypal.com>", "", good, "x"), (2, "verify your account", "PayPal <x@evil.tk>", "", "mx; dkim=pass header.d=evil.tk", "x"), (3, "plain words for you", "A <a@b.example>", "", None, "x")]
    m = spark.createDataFrame(mail, "mail_id int, body string, from_header string, reply_to string, auth_header string, subject string").withColumns({"inbox_soft": F.lit(False), "outlook_internal": F.lit(False)})
    l = spark.createDataFrame([(1, 0, 0, "https://www.paypal.com/a"), (2, 0, 0, "http://1.2.3.4/login")], "mail_id int, grp int, pos int, url string")
    got = {r.mail_id: r for r in engine.analyse(m, l).collect()}
    assert (got[1].verdict, got[1].trust_path) == ("safe", "trusted_sender") and got[1].p_meta == 0.0
    assert got[2].verdict == "phishing" and got[2].forced_by == ["confident_sender"] and got[2].brand == "paypal"
    assert got[3].verdict == "safe" and got[3].trust_path == "default"


def test_analyse_reads_lookalikes_and_parents(spark):
    """Look-alike letters and accents show a brand; a trusted domain's subdomain is trusted; the model's score comes in."""
    ok = "mx; dkim=pass header.d=mail.paypal.com; spf=pass smtp.mailfrom=mail.paypal.com; dmarc=pass header.from=mail.paypal.com"
    mail = [(1, '"РayPal" <x@evil.tk>', None), (2, "Paypál <x@evil.tk>", None), (3, "Service <a@mail.paypal.com>", ok), (4, None, None), (5, "Bank of America <x@evil.tk>", None)]
    m = spark.createDataFrame([(i, "verify your account now", f, "", a, "s") for i, f, a in mail], "mail_id int, body string, from_header string, reply_to string, auth_header string, subject string").withColumns({"inbox_soft": F.lit(False), "outlook_internal": F.lit(False)})
    l = spark.createDataFrame([], "mail_id int, grp int, pos int, url string")
    fitted = model.fit_text(spark.createDataFrame([(i, "verify account now" if i % 2 else "lunch on friday", i % 2) for i in range(40)], "id int, text string, label int"))
    got = {r.mail_id: r for r in engine.analyse(m, l, text_model=fitted).collect()}
    assert [got[i].brand for i in (1, 2, 3, 4)] == ["paypal", "paypal", None, None]
    assert got[3].trust_path == "trusted_sender" and got[1].trust_path == "default"
    assert all(got[i].p_text > 0.5 and got[i].p_url == 0.05 for i in got)


def test_text_model_and_explanations(spark):
    rows = [(i, "verify account now urgent refund" if i % 2 else "meeting notes lunch friday team", i % 2) for i in range(80)]
    d = spark.createDataFrame(rows, "id int, text string, label int")
    m = model.fit_text(d)
    p = {r.id: r.p_text for r in model.text_agent(d, m).collect()}
    assert all((p[i] > 0.5) == bool(i % 2) for i in p)
    soft = {r.id: r.p_text for r in model.score_text(d, m, 4.0).collect()}
    assert all(abs(soft[i] - 0.5) < abs(p[i] - 0.5) for i in p)
    top = model.explain(d.where("id = 1"), m, "id").collect()
    assert top and all(r.weight > 0 for r in top) and dims.words
