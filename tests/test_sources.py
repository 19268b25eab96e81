import io
import json
import zipfile

from pyspark.sql import functions as F

from threshline.functions import headers
from threshline.sources import files, html, mail, stores

EML = b"From: A <a@b.example>\r\nFrom: C <c@d.example>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hello</p><div style='display:none'>secret <a href='https://hidden.tk/x'>h</a></div><a href='https://seen.example/'>s</a>"


def test_mail_folders_and_mbox(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "sub" / "b.eml").write_bytes(b"no headers at all \xff")
    d = mail.parse_mail(mail.read_mail(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r for r in d.collect()}
    a = got["a.eml"]
    assert a.body == "Hello\ns\nsecret h" and a.visible_urls == ["https://seen.example/"] and a.hidden_urls == ["https://hidden.tk/x"] and a.from_unproven and len(a.mail_id) == 16
    assert got["b.eml"].body is not None
    links = mail.mail_links(d.where("size(visible_urls) > 0")).collect()
    assert [(r.grp, r.pos, r.url) for r in links] == [(0, 0, "https://seen.example/"), (1, 0, "https://hidden.tk/x")]
    subject = d.where("from_unproven").select(F.try_element_at(headers.header_map(F.col("headers")), F.lit("subject"))).first()[0]
    assert subject == "café"
    (tmp_path / "box.mbox").write_bytes(b"From x\nSubject: 1\n\none\n>From here\n\nFrom y\nSubject: 2\n\ntwo\n")
    rows = mail.read_mbox(spark, str(tmp_path / "box.mbox")).orderBy("pos").collect()
    assert [bytes(r.raw) for r in rows] == [b"Subject: 1\n\none\nFrom here\n", b"Subject: 2\n\ntwo\n"]
    spark.dataSource.register(mail.MboxSource)
    assert spark.read.format("mbox").load(str(tmp_path / "box.mbox")).count() == 2


HIDDEN = {
    "display:none": True, "display: none !important; display:block": True, "visibility:hidden": True, "opacity:0": True, "opacity:.5": False, "font-size:0": True, "font-size:1px": True, "font-size:12px": False, "color:#fff;background:#ffffff": True, "color:white;background-color:rgb(250,250,250)": True, "color:#000;background:#fff": False,
    "color:transparent": True, "color:rgba(0,0,0,0)": True, "position:absolute;left:-9999px": True, "left:-9999px": False, "text-indent:-9999px": True, "width:0;height:0;overflow:hidden": True, "width:0": False, "transform:scale(0)": True, "mso-hide:all": True, "": False, "color:hsl(0,0%,100%);background:#fff": True, "color:red": False,
}


#: Styles that other readers of the same mail agree on: hidden or not on a white page.
SHARED = {
    "color:#333": False, "display:none": True, "visibility:hidden": True, "opacity:0": True, "opacity:0.9": False, "font-size:0": True, "font-size:1px": True, "font-size:0.01em": True, "font-size:1em": False, "color:transparent": True, "color:rgba(0,0,0,0)": True, "color:#ffffff;background-color:#ffffff": True,
    "color:#ffffff;background-color:#0b57d0": False, "overflow:hidden;max-height:0": True, "overflow-y:hidden;max-height:0": True, "overflow:hidden;height:20px": False, "position:absolute;left:-9999px": True, "position:relative;left:-20px": False, "text-indent:-9999px": True, "transform:scale(0)": True, "transform:scaleY(0)": True,
    "transform:scaleX(0)": True, "transform:scale(1.2)": False, "position:absolute;clip:rect(0px, 0px, 0px, 0px)": True, "clip-path:inset(100%)": True, "clip-path:inset(10%)": False, "color:#fefefe": True, "color:#d0d0d0": False, "background-color:rgba(0,0,0,0.06);color:#000000": False, "background-color:rgba(0,0,0,0.06);color:#ffffff": True,
    "color:hsl(0, 0%, 100%)": True, "color:rgb(100%, 100%, 100%)": True, "background-color:#0b57d0;color:#ffffff": False, "color:#999999": False, "background: no-repeat center #0b57d0; color: #ffffff": False, "background: rgb(11, 87, 208) no-repeat; color: #ffffff": False, "display:/*x*/none": True, "background: linear-gradient(#0b57d0, #003399); color: #ffffff": False,
    "display: none !important; display: block": True, "color:whitesmoke": True, "color:rebeccapurple": False,
}


def test_hidden_styles():
    assert {s: html.hidden_style(s) for s in HIDDEN} == HIDDEN
    assert {s: html.hidden_style(s) for s in SHARED} == SHARED
    assert html.hidden_style("color:#ffffff", (255, 255, 255)) and not html.hidden_style("color:#ffffff", (20, 20, 20))


def test_hidden_text_of_pages():
    """Backgrounds, ink and sizes are handed down; rules for print do not count."""
    cases = {
        "<div style='background:#141414'><p style='color:#fff'>light</p></div>": "light",
        "<body style='color:#fff'><p>white <b style='color:#000'>black</b></p></body>": "black\nwhite",
        "<table bgcolor=0b57d0><tr><td style='color:white'>cell</td></tr></table>": "cell",
        "<p style='font-size:1px'>tiny <span style='font-size:100%'>still</span><span style='font-size:14px'> big</span></p>": "big\ntiny still",
        "<div style='visibility:hidden'>gone <i style='visibility:visible'>back</i></div>": "back\ngone",
        "<style>@media print{.a{display:none}} @media screen{.b{display:none}} .c{color:#fff}</style><p class=a>a</p><p class=b>b</p><p class=c>c</p>": "a\nb\nc",
        "<p hidden>h</p><font color=white>f</font>x": "x\nh\nf",
    }
    assert {p: html.to_text(p) for p in cases} == cases


def test_pages(spark):
    page = "<style>.x{display:none}</style><form><input TYPE=' PASSWORD '></form><p class=x>gone</p><p>shown</p><iframe></iframe><meta http-equiv=Refresh><script>new Blob([1])</script>"
    d = spark.createDataFrame([(page,), ("",), (None,)], "h string")
    rows = d.select(html.page_flags("h").alias("f"), html.html_text("h").alias("t")).collect()
    assert rows[0].f == ["contains_form", "contains_password_field", "contains_javascript", "contains_iframe", "meta_refresh_redirect", "embeds_another_file"]
    assert rows[0].t == "shown\ngone" and rows[1].f == [] == rows[2].f


def test_pages_inside_pages():
    inner = "<form action='https://in.evil.tk/'><input type=password><a href='https://in.evil.tk/x'>go</a></form>"
    import base64

    coded = base64.b64encode(inner.encode()).decode()
    for page in (f'<iframe srcdoc="{inner}"></iframe>'.replace("'", "&#39;"), f"<object data='data:text/html;base64,{coded}'></object>", f'<meta http-equiv="refresh" content="0;url=data:text/html;base64,{coded}">', f"<script>document.write(atob('{coded}'))</script>"):
        p = html.read(page)
        assert {"form", "password"} <= p.facts and "https://in.evil.tk/x" in p.links[0], page
    code = "var a = 'https://ev' + \"il.tk/a\"; b = '\\x68ttp://hex.tk/'; c = String.fromCharCode(104,116,116,112,58,47,47,99,46,116,107); d = 'kt.kcab//:sptth'"
    joined = " ".join(html.script_readings(code))
    assert all(u in joined for u in ("https://evil.tk/a", "http://hex.tk/", "http://c.tk", "https://back.tk"))
    assert html.link_groups("<base href='https://b.example/d/'><a href='x.php'>x</a>")[0] == ["https://b.example/d/x.php"]


def test_saved_mails_and_archives(spark):
    raw = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=q\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<form><input type=password></form><a href='https://p.example/'>x</a>\r\n--q\r\nContent-Type: application/octet-stream; name=a.pdf.exe\r\nContent-Disposition: attachment; filename=a.pdf.exe\r\n\r\nMZ\r\n--q--\r\n"
    d = spark.createDataFrame([(1, "page.mht", raw, None)], "id int, filename string, content binary, mime string")
    r = files.analyse(d).first()
    assert r.kind == "mime" and r.notable_features == ["double_extension", "executable_in_archive", "contains_form", "contains_password_field", "inner_files_not_extracted"] and r.extracted_urls == ["https://p.example/"]


def _zip(members, encrypt=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in members.items():
            z.writestr(n, b)
    raw = bytearray(out.getvalue())
    if encrypt:
        at = raw.find(b"PK\x01\x02")
        raw[at + 8] |= 1
        raw[6] |= 1
    return bytes(raw)


def test_archives_and_packages(spark):
    big = {"page.html": b"x", "a.txt": b"t" * 100, "evil.pdf.exe": b"MZ", "dir/": b""}
    d = spark.createDataFrame([(1, _zip(big)), (2, _zip({"a.txt": b"x"}, True)), (3, b"PK broken"), (4, _zip({"z.txt": b"0" * (3 << 20)}))], "id int, content binary")
    got = {r.id: r for r in files.analyse_zip(d).collect()}
    assert got[1].notable_features == ["double_extension", "executable_in_archive"] and got[1].entry_count == 4
    assert got[2].encrypted and "encrypted_archive" in got[2].notable_features
    assert got[3].notable_features == ["uninspectable_archive"] and "zip_bomb_suspected" in got[4].notable_features
    z = files.analyse_zip(d.where("id = 1"))
    assert z.select(files.choose_inner(F.col("entries"))).first()[0] == ["page.html", "a.txt"]
    assert files.member_report(z, "id").first().members[0].reasons == ["fake extension", "program"]
    doc = {"word/document.xml": b'<d xmlns:w="w"><w:p><w:t>Hi</w:t></w:p><w:instrText>HYPERLINK "https://l.example/x"</w:instrText><w:instrText> DDEAUTO c</w:instrText></d>', "word/vbaProject.bin": b"", "word/_rels/s.rels": b'<R Type="http://x/attachedTemplate" Target="https://t.example/t.dotm" TargetMode="External"/>'}
    o = files.office_package(_zip(doc))
    assert o["kind"] == "docx" and o["extracted_text"] == "Hi" and set(o["notable_features"]) == {"contains_macros", "remote_template", "dde_field"} and "https://l.example/x" in o["extracted_urls"]
    assert "suspicious_xml_doctype" in files.office_package(_zip({"word/document.xml": b"<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"}))["notable_features"]


def test_types_by_signature_and_name(spark):
    rows = [("invoice.txt", b"%PDF-1.4", None, "application/pdf"), ("a.docx", b"PK\x03\x04", None, files.OOXML[0]), ("a.bin", b"PK\x03\x04", None, "application/zip"), ("a.txt", b"  <HTML>", None, "text/html"), ("a.svg", b"<svg>", None, "image/svg+xml"), ("p.webp", b"RIFF1234WEBP", None, "image/webp"), ("x", b"\x01", "Text/X; q", "text/x"), ("x", b"\x01", None, "application/octet-stream")]
    d = spark.createDataFrame(rows, "n string, c binary, h string, want string")
    got = d.select("want", files.sniff_type(F.col("n"), F.col("c"), F.col("h")).alias("g")).collect()
    assert [(r.want, r.g) for r in got] == [(r.want, r.want) for r in got]


def test_calendars_and_pdfs(spark):
    ics = b"BEGIN:VCALENDAR\r\nSUMMARY:Pay\\, now\r\nDESCRIPTION:go https://a.exa\r\n mple/x\r\nORGANIZER;CN=Boss:mailto:b@c.example\r\nX-MEET:https://m.example/1\r\nEND:VCALENDAR"
    c = files.calendar_facts(F.col("c"))
    r = spark.createDataFrame([(ics,)], "c binary").select(*[v.alias(k) for k, v in c.items()]).first()
    assert r.organizer == "b@c.example" and r.extracted_text.startswith("Pay, now") and r.extracted_urls == ["https://a.example/x", "https://m.example/1"] and r.notable_features == ["calendar_invite", "calendar_with_links"]
    p = spark.createDataFrame([(b"%PDF /JS /JavaScript /URI (https://x.example)",)], "c binary").select(files.pdf_markers(F.col("c")), files.pdf_links(F.col("c"))).first()
    assert p[0] == ["contains_javascript", "contains_link_annotation"] and p[1] == ["https://x.example"]


def test_stores(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": "a", "v": 1}, {"id": "b", "v": 2}, {"id": "a", "v": 3})))
    assert {r.id: r.v for r in stores.load_results(spark, str(tmp_path / "r.jsonl"), "id string, v int").collect()} == {"a": 3, "b": 2}
    (tmp_path / "feed.json").write_text(json.dumps([{"url": "https://X.example/a"}, {"url": "https://x.example/b"}]))
    u, h = stores.load_feed(spark, str(tmp_path / "feed.json"))
    assert u.count() == 2 and [r.host for r in h.collect()] == ["x.example"]


def test_functions_in_sql(spark):
    from threshline.functions import registry

    registry.register(spark)
    spark.createDataFrame([(_zip({"a.txt": b"x", "b/": b""}),)], "c binary").createOrReplaceTempView("zips")
    got = spark.sql("SELECT e.name, e.is_dir FROM zips, LATERAL zip_entries(c) e ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("a.txt", False), ("b/", True)]
    assert spark.sql("SELECT html_text('<p>a</p><p>b</p>')").first()[0] == "a\nb"


def test_office_files_under_other_names(spark):
    raw = _zip({"word/document.xml": b"<d><t>Hi</t></d>", "word/vbaProject.bin": b""})
    r = files.analyse(spark.createDataFrame([(1, "letter.zip", raw, None)], "id int, filename string, content binary, mime string")).first()
    assert r.kind == "archive_zip" and "contains_macros" in r.notable_features and r.extracted_text == "Hi"


def test_lookups_and_sizes(spark):
    from threshline import engine
    from threshline.operators import evaluation, reputation

    d = spark.createDataFrame([("127.0.1.4",), ("127.0.1.77",), ("127.255.255.254",)], "c string").select(reputation.blocklist_verdict(F.col("c")).alias("v")).collect()
    assert [r.v and (r.v.threat_type, r.v.category) for r in d] == [("SOCIAL_ENGINEERING", "phish"), ("SUSPICIOUS", "listed_unknown_code"), None]
    j = '{"events":[{"eventAction":"last changed","eventDate":"2020-01-01"},{"eventAction":"registration","eventDate":"1999-05-06T01:02:03Z"}]}'
    assert str(spark.createDataFrame([(j,)], "j string").select(evaluation.registration_date(F.col("j"))).first()[0]) == "1999-05-06"
    kept, refused = engine.within_size(spark.createDataFrame([("ab",), ("abcdef",), (None,)], "b string"), "b", 3)
    assert kept.count() == 1 and {r.reason for r in refused.collect()} == {"too large", "unsized"}


def test_words_that_styles_make():
    page = "<style>.a::before{content:'Pay'} .b:after{content:'x';display:none}</style><p class=a>now</p><p class=b>y</p>"
    assert html.to_text(page) == "Pay now\ny"


def test_reports_are_stored_redacted_until_full(spark, tmp_path):
    from threshline.operators import insights

    d = spark.createDataFrame([("r1", "2024-03-01", "bug", "mail me at a.b@c.example", "safe", 0.1), ("r2", "2024-04-01", "nonsense", "x", "safe", 0.1), ("r3", "2024-04-01", "bug", "x", "safe", 1.5)], "reference string, received string, kind string, text string, verdict string, fused_score double").withColumn("received", F.to_date("received"))
    good, bad = insights.valid_reports(d)
    assert {r.reference: r.reason for r in bad.collect()} == {"r2": "kind", "r3": "fused_score"}
    path = str(tmp_path / "reports")
    assert insights.store_reports(good, path) and not insights.store_reports(good, path, 1)
    back = spark.read.json(path)
    assert [(r.month, r.text) for r in back.select("month", "text").collect()] == [("2024-03", "mail me at <EMAIL>")]
    assert insights.without_reports(back, good.select("reference")).count() == 0


def test_mail_is_parsed_whole():
    part = b"--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\n" + (b"QUJD" * 18 + b"\r\n") * 30_000
    late = b"Subject: s\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n" + part + b"--b\r\nContent-Type: text/html\r\n\r\n<p>late words</p><a href='https://late.example/x'>x</a>\r\n--b--\r\n"
    got = mail.parse(late)
    assert len(late) > 2 << 20 and got["body"].startswith("late words") and got["visible_urls"] == ["https://late.example/x"]
    long = mail.parse(b"Content-Type: text/plain\r\n\r\n" + b"word " * 300_000 + b"https://end.example/y")
    assert long["text_urls"] == ["https://end.example/y"] and len(long["body"]) > 1_400_000


def test_member_flags_equal_the_column_form(spark):
    from threshline.functions import text

    names = ["invoice.pdf.exe", "scan.jpg   .js", "a/b\\run.exe .", "invoice\u202efdp.exe", "x.iso", "x.zip", "a.txt", "plain", "invoice.pdf。exe", "dir/.hidden", "a.b.c.lnk", "", "x.t\u200bar", "UP.PS1"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.name_flags(F.col("n"), True).alias("f")).collect()
    assert {r.n: r.f for r in got} == {n: files.member_flags(n) for n in names}


def test_inner_files_and_reports(spark):
    import zlib

    from threshline import engine

    shown = zlib.compress(b"BT (Pay \\(now\\)) Tj T* [(at) 20 ( once)] TJ ET")
    pdf = b"%PDF-1.4\n<< /Length 9 /Filter /FlateDecode >> stream\n" + shown + b"\nendstream /OpenAction /URI (https://bad.example/x)"
    raw = _zip({"a/invoice.pdf": pdf, "evil.pdf.exe": b"MZ", "inner.zip": b"PK", "form.html": b"<form><input type=password></form>", "big.txt": b"0" * (2 << 20)})
    d = spark.createDataFrame([(1, "f.zip", raw, None, False), (2, "none.pdf", None, None, False)], "id int, filename string, content binary, mime string, parent_trusted boolean")
    bad = spark.createDataFrame([("https://bad.example/x", True, 1.0, ["google_safe_browsing"], ["MALWARE"])], "url string, malicious boolean, score double, sources array<string>, threat_types array<string>")
    got = {r.id: r for r in engine.analyse_attachments(d, bad).collect()}
    r = got[1]
    assert r.extracted_text.endswith("Pay (now)\nat once") and r.extracted_urls == ["https://bad.example/x"]
    assert {"nested_archive", "zip_bomb_suspected", "contains_password_field", "auto_execute_on_open", "executable_in_archive"} <= set(r.notable_features)
    reasons = {m.name: m.reasons for m in r.suspicious_files}
    assert reasons["evil.pdf.exe"] == ["fake extension", "program"] and reasons["a/invoice.pdf"] == ["runs on open", "flagged link"] and reasons["form.html"] == ["password form"]
    assert r.rep_max == 1.0 and r.p_url >= 0.95 and r.is_phishing
    assert got[2].notable_features == [] and got[2].suspicious_files == []
