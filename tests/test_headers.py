import datetime as dt

from pyspark.sql import functions as F

from threshline.functions import dims, headers

FROMS = {
    "Chronopost <info@qdsoddsmn.us>": "chronopost", '"PayPal" <service@paypal.com>': None, "PayPal <x@paypal.co.uk>": "paypal", "UPS <a@b.example>": "ups", "ups fan <a@b.example>": None, "Jane Doe <jane@gmail.com>": None,
    "La Poste <x@laposte.fr>": None, "la poste <x@evil.tk>": "la poste", "PаyPal <x@evil.example>": "paypal", '"Info" <x@evil.example>, "PayPal" <x@evil.example>': "paypal", "<x@evil.example> (PayPal)": "paypal", "Booking.com <x@booking.com>": None, "PayPal <a@paypal.duckdns.org>": "paypal",
}


def test_impersonated_brands(spark):
    rows = spark.createDataFrame(list(enumerate(FROMS)), "mail_id int, from_header string")
    got = {r.mail_id: r.brand for r in headers.impersonations(rows, dims.brands(spark)).collect()}
    want = dict(enumerate(FROMS.values()))
    want[2] = None  # co.uk is the brand's own ending
    assert got == want


AUTH = [
    ("a@paypal.com", "mx; dkim=pass header.d=paypal.com; spf=pass smtp.mailfrom=b@mail.paypal.com; dmarc=pass header.from=paypal.com", ("pass", "pass", "pass", True, True, True)),
    ("a@paypal.com", 'mx; spf=pass smtp.mailfrom="dkim=pass header.i=@paypal.com; x"@evil.example', ("pass", "none", "none", False, False, False)),
    ("a@paypal.com", "mx; dkim=pass (dkim=pass header.d=paypal.com; (nested; dkim=pass)) header.d=evil.example", ("none", "pass", "none", False, False, False)),
    ("a@paypal.co.uk", "mx; dkim=pass header.d=evil.co.uk", ("none", "pass", "none", False, False, False)),
    ("a@x.example", "mx; dkim=fail header.d=x.example; dkim=pass header.i=@mail.x.example", ("none", "pass", "none", True, False, True)),
    ("a@x.example", None, ("none", "none", "none", False, False, False)),
]


def test_authentication(spark):
    rows = spark.createDataFrame([(i, f"N <{a}>", h) for i, (a, h, _) in enumerate(AUTH)], "mail_id int, from_header string, auth_header string")
    got = {r.mail_id: (r.spf, r.dkim, r.dmarc, r.aligned, r.all_pass, r.crypto_verified) for r in headers.auth_verdict(rows).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(AUTH)}


def test_dates_and_header_maps(spark):
    d = spark.createDataFrame([("Tue, 05 Mar 2024 10:00:00 +0200 (EET)",), ("5 Mar 2024 10:00:00",), ("nonsense",)], "d string")
    got = [r[0] for r in d.select(headers.sent_on(F.col("d"))).collect()]
    assert [g and g.astimezone(dt.UTC).hour for g in got] == [8, 10, None]
    items = [[("From", "a@x"), ("Subject", "one   two"), ("X-A", "1"), ("From", "b@y"), ("X-A", "2")]]
    h = spark.createDataFrame([(items[0],)], "i array<struct<name:string,value:string>>").select(headers.header_map(F.col("i"))).first()[0]
    assert h == {"from": "a@x", "subject": "one two", "x-a": "2"}


def test_header_features(spark):
    h = {"from": "A <a@bank.example>", "reply-to": "x@evil.example", "received-spf": "fail", "authentication-results": "dkim=fail; dmarc=fail", "subject": "URGENT: verify your account"}
    d = spark.createDataFrame([(h, ["from 10.0.0.1", "b"], ["From", "X-Mailer"])], "h map<string,string>, r array<string>, n array<string>")
    f = d.select(*[v.alias(k) for k, v in headers.header_features(F.col("h"), F.col("r"), F.col("n")).items()]).first().asDict()
    assert len(f) == 37
    assert (f["reply_to_mismatch"], f["spf_fail"], f["dkim_fail"], f["dmarc_fail"], f["suspicious_ip_count"]) == (1, 1, 1, 1, 1) and f["subject_urgent_keywords"] >= 2


def test_forwards_and_synthesized_results(spark):
    d = spark.createDataFrame([("x\n---- Forwarded message ----\nFrom: A <a@b.example>", None), ("hi", "TR: x"), ("we forwarded message", None)], "b string, s string")
    p = headers.forward_parts(F.col("b"), F.col("s"))
    assert [(r[0], r[1]) for r in d.select(p["detected"], p["original_sender"]).collect()] == [(True, "a@b.example"), (True, None), (False, None)]
    s = spark.createDataFrame([("mail.paypal.com", "x.example", None, "paypal.com"), (None, None, None, "a.b"), ("bad host", None, "v.example", "a.b")], "s string, m string, v string, f string")
    got = [r[0] for r in s.select(headers.synthesized_auth(*map(F.col, "smvf"))).collect()]
    assert got == ["client-context; dkim=pass header.i=@mail.paypal.com; spf=pass smtp.mailfrom=x.example; dmarc=pass header.from=paypal.com", "", "client-context; spf=pass smtp.mailfrom=v.example"]
