"""Mail-shaped inputs over the given tables, in SQL that Spark and DuckDB both read.

``@name`` stands for a table: a Parquet path in Spark, a view in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LINKS = """
SELECT page_id AS mail_id, 0 AS grp, 0 AS pos, url FROM @pages
UNION ALL SELECT page_id, 0, 1, CASE page_id % 18
  WHEN 0 THEN 'http://192.168.10.5/login' WHEN 1 THEN 'https://paypal.com@evil.tk/verify' WHEN 2 THEN 'https:evil.click/account' WHEN 3 THEN 'http://3232235777/'
  WHEN 4 THEN 'https://storage.googleapis.com/b/page.html' WHEN 5 THEN 'https://xn--pypal-4ve.com/secure' WHEN 6 THEN 'https://www.google.com/search?q=x' WHEN 7 THEN 'https://www.paypal.com/home?x=1'
  WHEN 8 THEN 'https://u123.ct.sendgrid.net/ls/click' WHEN 9 THEN 'https://docs.google.com/forms/d/1' WHEN 10 THEN 'https://bit.ly/2x' WHEN 11 THEN 'https://shop.acme.co.uk:8443/a%20b?user=1&token=2'
  WHEN 12 THEN 'HTTPS://GitHub.com./user/repo' WHEN 13 THEN 'https://drive.google.com/file/d/1' WHEN 14 THEN 'https://www.paypal.com/redirect?u=x' WHEN 15 THEN 'https://alice.github.io/page'
  WHEN 16 THEN 'https://fonts.googleapis.com/css' ELSE 'https://laposte.fr/suivi' END FROM @pages
UNION ALL SELECT page_id, 1, 0, 'https://' || CASE page_id % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'www.shop' ELSE 'cdn' END || '.acme.example/p/' || CAST(page_id % 50 AS STRING) FROM @pages
UNION ALL SELECT page_id, 1, 1, 'https://shop.acme.example/second/' || CAST(page_id % 7 AS STRING) FROM @pages
UNION ALL SELECT page_id, 1, 2, url FROM @pages
"""

MAIL = """
SELECT doc_id AS mail_id, text AS body,
  CASE doc_id % 8 WHEN 0 THEN '"PayPal" <service@paypal.com>' WHEN 1 THEN 'PayPal Support <help@secure-pay.tk>' WHEN 2 THEN 'Jane Doe <jane@mail.acme.co.uk>' WHEN 3 THEN 'UPS <no-reply@parcel.example>'
    WHEN 4 THEN 'ups fan <fan@club.example>' WHEN 5 THEN 'La Poste <suivi@laposte.fr>' WHEN 6 THEN 'Chronopost info <x@evil.xyz>' ELSE 'noreply@github.com' END AS from_header,
  CASE doc_id % 5 WHEN 0 THEN 'other@reply.example' WHEN 1 THEN 'service@paypal.com' ELSE '' END AS reply_to,
  CASE doc_id % 7 WHEN 0 THEN 'mx.example; spf=pass smtp.mailfrom=bounce@mail.paypal.com; dkim=pass header.d=paypal.com; dmarc=pass header.from=paypal.com'
    WHEN 1 THEN 'mx.example; spf=fail smtp.mailfrom=x@evil.tk; dkim=fail header.d=evil.tk; dmarc=fail header.from=paypal.com'
    WHEN 2 THEN 'mx.example; dkim=fail header.d=paypal.com; dkim=pass header.i=@acme.co.uk; spf=softfail smtp.mailfrom=a@b.example'
    WHEN 3 THEN 'mx.example; dkim=pass header.d=other.example; spf=pass smtp.mailfrom=laposte.fr' WHEN 4 THEN 'spf=none; x dkim=pass header.d=github.com; dkim=neutral'
    WHEN 5 THEN 'mx.example; dkim=pass header.d=mail.github.com; spf=neutral; dmarc=pass header.from=github.com' ELSE NULL END AS auth_header,
  CASE doc_id % 6 WHEN 0 THEN 'Fwd: news' WHEN 1 THEN 'TR: avis' WHEN 2 THEN 'forward this' WHEN 3 THEN NULL ELSE 'Your account' END AS subject,
  lang
FROM @documents
"""

SCORES = """
SELECT doc_id AS id, CAST(doc_id % 11 AS DOUBLE) / 10 AS p_text, CAST(doc_id % 7 AS DOUBLE) / 6 AS p_url, CAST(doc_id % 5 AS DOUBLE) / 4 AS p_meta,
  doc_id % 13 <> 0 AS text_used, doc_id % 17 = 0 AS trusted_sender, doc_id % 5 = 0 AS crypto_verified, doc_id % 3 = 0 AS inbox_soft, doc_id % 6 = 0 AS outlook_internal,
  doc_id % 4 = 0 AS strong_link, doc_id % 10 = 0 AS links_elsewhere, CASE doc_id % 9 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rep_max, doc_id % 18 = 0 AS gsb,
  doc_id % 2 = 0 AS parent_trusted, CAST(doc_id % 4 AS DOUBLE) / 8 AS url_rule_score,
  CASE doc_id % 8 WHEN 0 THEN 'contains_form,contains_password_field' WHEN 1 THEN 'contains_macros,legacy_office_format' WHEN 2 THEN 'encrypted_archive,nested_archive' WHEN 3 THEN 'double_extension,executable_in_archive'
    WHEN 4 THEN 'calendar_invite,calendar_with_links' WHEN 5 THEN 'unheard_of' WHEN 6 THEN 'contains_javascript,launch_external_action,auto_execute_on_open' ELSE 'contains_link_annotation' END AS flags
FROM @documents
"""

RUN = """
SELECT CAST(d.doc_id AS STRING) AS id, d.lang, CASE WHEN l.toxic = 1 THEN 'phishing' ELSE 'legit' END AS label, CASE WHEN (d.n_chars + d.doc_id) % 7 < 2 OR (l.toxic = 1 AND d.doc_id % 4 <> 0) THEN 'phishing' ELSE 'safe' END AS verdict,
  CAST(d.n_chars % 100 AS DOUBLE) / 100 AS p_text, CAST(d.doc_id % 10 AS DOUBLE) / 10 AS p_url, CAST(d.doc_id % 4 AS DOUBLE) / 4 AS p_meta, d.doc_id % 3 = 0 AS override,
  CASE d.doc_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'crypto_verified' WHEN 2 THEN 'trusted_sender' END AS trust_path, CASE WHEN d.doc_id % 29 = 0 THEN 'HTTP 413' WHEN d.doc_id % 31 = 0 THEN 'TimeoutError' END AS error
FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id
"""

SCANS = """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'click' THEN 'gmail' WHEN 'view' THEN 'outlook' WHEN 'purchase' THEN 'file' ELSE event_type END AS source, user_id,
  CASE WHEN value >= 60 THEN 'phishing' ELSE 'safe' END AS verdict, CASE WHEN value > 100 THEN CAST(1 AS DOUBLE) ELSE CAST(value AS DOUBLE) / 100 END AS score, CASE event_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' END AS label
FROM @events
"""

NAMES = """
SELECT doc_id AS id, CASE doc_id % 14 WHEN 0 THEN 'invoice.pdf.exe' WHEN 1 THEN 'scan.jpg   .js' WHEN 2 THEN 'run.PS1 .' WHEN 3 THEN 'folder/page.url' WHEN 4 THEN 'disk.iso' WHEN 5 THEN 'inner.tar.gz' WHEN 6 THEN 'report.docx'
  WHEN 7 THEN 'noextension' WHEN 8 THEN 'a.b.c.txt' WHEN 9 THEN 'image.png' WHEN 10 THEN 'setup.msi' WHEN 11 THEN 'x.html' WHEN 12 THEN 'archive.pdf.zip' ELSE 'mail.eml' END AS name
FROM @documents
"""

CELLS = "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || lang || source AS cell FROM @documents"

FORWARDS = """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Fwd: x' WHEN 1 THEN 'hello' END AS subject,
  CASE doc_id % 6 WHEN 0 THEN '---------- Forwarded message ---------' || chr(10) || 'From: Ann <Ann@Old.example>' || chr(10) || 'hi' WHEN 1 THEN 'text' || chr(10) || 'Begin forwarded message:' || chr(10) || 'De : bob@site.example'
    WHEN 2 THEN 'we forwarded message to you' WHEN 3 THEN 'From: Carl <carl@x.example>' || chr(10) || 'no marker' WHEN 4 THEN '-- Original Message --' || chr(10) || 'Subject: none' ELSE 'plain' END AS body
FROM @documents
"""

TEXTS = """
SELECT doc_id AS id, lang, CASE doc_id % 6 WHEN 0 THEN 'see https://Acme.example/a?b=1, and www.other.example. ' WHEN 1 THEN 'write to jo.doe@mail.acme.example or +33 6 12 34 56 78 ' WHEN 2 THEN 'card 4111 1111 1111 1111 and @handle_x '
  WHEN 3 THEN 'IBAN FR76 3000 6000 0112 3456 789 ok ' WHEN 4 THEN 'user max_power99 said https://a.example https://b.example hi ' ELSE '' END || text AS text
FROM @documents
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"@(\w+)", rf"parquet.`{sf_dir}/\1.parquet`", _tables(sql)).replace("\x01", "@"))


def duck(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", _tables(sql)).replace("\x01", "@")


def _tables(sql: str) -> str:
    """Only @names after FROM or JOIN are tables; other signs are put aside."""
    return re.sub(r"(?<!FROM )(?<!JOIN )@", "\x01", sql)
