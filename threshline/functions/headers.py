"""Mail headers: authentication results, senders, brands, forwards and dates, as column expressions.

Address lists need an RFC 5322 parser; those few functions are pandas UDFs over
the standard library, and everything after them is native.
"""

from __future__ import annotations

import re
import unicodedata
from email.header import decode_header, make_header
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.functions import dims, urls

_RESULTS = "pass|fail|softfail|neutral|temperror|permerror|none|bestguesspass|policy"


def without_comments(value: Column) -> Column:
    """Nested comments and the contents of quoted strings dropped: an escape goes first, then quotes, then innermost comments up to eight deep."""
    v = F.regexp_replace(F.left(value, F.lit(20_000)), r"\\.", "")
    # a quote inside a comment is text, a parenthesis inside quotes is text: whichever opens first wins
    v = F.regexp_replace(v, r'"[^"]*"', '"q"')
    for _ in range(8):
        v = F.regexp_replace(v, r"\([^()]*\)", " ")
    return F.regexp_replace(v, r"\(.*$", "")


def clauses(value: Column) -> Column:
    """(method, result, domain, pos) of each result of an Authentication-Results value."""
    start = rf"(?i)^\s*(spf|dkim|dmarc)\s*=\s*({_RESULTS})\b"
    parts = F.filter(F.split(without_comments(value), ";"), lambda s: s.rlike(start))

    def one(s: Column, i: Column) -> Column:
        method = F.lower(F.regexp_extract(s, start, 1))
        rest = F.regexp_replace(s, start, "")
        ident = (
            F.when(method == "spf", F.regexp_extract(rest, r"(?i)smtp\.mailfrom=([^\s;]+)", 1))
            .when(method == "dkim", F.regexp_extract(rest, r"(?i)header\.(?:i|d)=@?([^\s;]+)", 1))
            .otherwise(F.regexp_extract(rest, r"(?i)header\.from=([^\s;]+)", 1))
        )
        return F.struct(method.alias("method"), F.lower(F.regexp_extract(s, start, 2)).alias("result"), domain_of(ident).alias("domain"), i.alias("pos"))

    return F.transform(parts, one)


def domain_of(address: Column) -> Column:
    a = F.lower(F.btrim(F.trim(address), F.lit('<>"')))
    a = F.element_at(F.split(a, "@"), -1)
    return F.trim(F.regexp_replace(F.split_part(F.regexp_replace(a, r"\.+$", ""), F.lit(">"), F.lit(1)), r"\.+$", ""))


def simple_sender_domain(header: Column) -> Column:
    """Domain of the address between angle brackets, else of the first address; for ordinary headers."""
    angle = F.regexp_extract(header, r"<\s*[^<>\s@]+@([A-Za-z0-9._-]+)\s*>[^<>]*$", 1)
    return F.regexp_replace(F.lower(F.when(angle != "", angle).otherwise(F.regexp_extract(header, r"@([A-Za-z0-9._-]+)", 1))), r"\.+$", "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sender_domains(header: pd.Series) -> pd.Series:
    """Every domain a From header names, in order."""

    def one(h: str | None) -> list[str]:
        found = [a.rpartition("@")[2].lower().rstrip(".") for _, a in getaddresses([(h or "")[:8000]]) if "@" in a]
        found += [d.lower().rstrip(".") for d in re.findall(r"<[^<>]{0,500}@([A-Za-z0-9._-]+)\s*>", (h or "")[:8000])]
        return list(dict.fromkeys(d for d in found if d))

    return header.map(one)


@F.pandas_udf(T.StringType())
def display_names(header: pd.Series) -> pd.Series:
    """Names a From header shows: parsed names, what stands before its last address, and comments."""

    def one(h: str | None) -> str:
        h = " ".join((h or "")[:32_000].split())[:8000]
        names = [n for n, _ in getaddresses([h]) if n]
        if "<" in h:
            names.append(re.sub(r"<\s*[^<>\s]{1,200}@[^<>\s@]{1,253}\s*>", " ", h.rpartition("<")[0]))
        names += re.findall(r"\(([^()]*)\)", h)
        return " ".join(names)

    return header.map(one)


def decode_words(value: str | None) -> str | None:
    """RFC 2047 words decoded; the value as written where that fails."""
    try:
        return value if value is None or "=?" not in value else str(make_header(decode_header(value)))
    except (LookupError, UnicodeError, ValueError):
        return value


@F.pandas_udf(T.StringType())
def decoded_header(value: pd.Series) -> pd.Series:
    return value.map(decode_words)


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form without accents."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t)) if not unicodedata.combining(c))

    return text.map(one)


#: Letters drawn like Latin ones (fixed values): the letters, then what they look like.
LOOKALIKES = ("аеорсухіјѕԁԛԝѵһӏАВЕКМНОРСТХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧłđøıɑɡɩ", "aeopcyxijsdqwvhlABEKMHOPCTXIJSaopvikABEZHIKMNOPTYXldoiagi")


def plain_words(name: Column, lower: bool = True) -> Column:
    """Words of a name, between single spaces, with look-alike letters read as Latin and accents dropped."""
    t = F.translate(folded(name), *LOOKALIKES)
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}.]+", " ")), F.lit(" "))
    return F.lower(t) if lower else t


def brand_owns(owners: Column, domain: Column) -> Column:
    """The domain's organisation is the brand's: a whole domain, or its first label under a usual ending."""
    org = urls.org_domain(domain)
    label, rest = F.split_part(org, F.lit("."), F.lit(1)), F.regexp_replace(org, r"^[^.]*\.", "")
    ending = F.element_at(F.split(org, r"\."), -1)
    usual = ending.isin(dims.BRAND_TLDS + dims.BRAND_CCTLDS) | org.isin(dims.WELL_KNOWN) | org.isin(dims.TRUSTED_SEED)
    return (org != "") & (F.array_contains(owners, org) | (F.array_contains(owners, label) & ~rest.isin(dims.SHARED_SUFFIXES) & usual))


def ordinary(header: Column) -> Column:
    """A header that patterns read as well as an address parser: ASCII, one address at most, no comment, no encoded word."""
    return header.rlike(r"^[\x00-\x7F]*$") & ~header.rlike(r"@[\s\S]*@|[(\\]|=\?")


def impersonations(mail: DataFrame, brands: DataFrame, id_col: str = "mail_id", from_col: str = "from_header", native: bool = False) -> DataFrame:
    """(id, brand): the first brand a From shows whose addresses are not the brand's, null where none.

    Ordinary headers are read by patterns, the others by the address parser;
    with ``native`` all are read by patterns, without Python, and look-alike
    letters are not folded. Brands are found by an equi-join on the names'
    word sequences, so the brand table may have any size.
    """
    h = F.coalesce(F.col(from_col), F.lit(""))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(h, r"<[^<>]*>", " "), r"[^A-Za-z0-9.]+", " ")), F.lit(" "))
    m = mail.select(F.col(id_col).alias("id"), plain.alias("u"), F.array(simple_sender_domain(h)).alias("ds"), F.when(~ordinary(h), h).alias("odd"))
    if not native:  # ordinary headers are null to the parser
        m = m.select("id", F.when(F.col("odd").isNull(), F.col("u")).otherwise(plain_words(display_names("odd"), False)).alias("u"), F.when(F.col("odd").isNull(), F.col("ds")).otherwise(sender_domains("odd")).alias("ds"))
        m = m.withColumn("ds", F.when(F.size("ds") == 0, F.array(F.lit(""))).otherwise(F.col("ds")))
    b = brands.select("ord", "brand", "owners", F.size(F.split("brand", " ")).alias("n"))
    sizes = [r["n"] for r in b.select("n").distinct().collect()]  # lengths of names, a handful
    words = F.filter(F.split("u", " "), lambda w: w != "")

    def runs(n: int) -> Column:
        starts = F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("ws", i, n), " "))

    grams = F.flatten(F.array(*[runs(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    shown = m.withColumn("ws", words).where(F.size("ws") > 0).select("id", "ds", F.explode(F.array_distinct(grams)).alias("g")).withColumn("brand", F.lower("g"))
    hit = shown.join(b, "brand").where(((F.length("brand") > 3) | (F.col("g") == F.upper("brand"))) & ~F.forall("ds", lambda d: brand_owns(F.col("owners"), d)))
    first = hit.groupBy("id").agg(F.min_by("brand", "ord").alias("brand"))
    return mail.select(F.col(id_col).alias("id")).distinct().join(first, "id", "left").select(F.col("id").alias(id_col), "brand")


def forward_parts(body: Column, subject: Column) -> dict[str, Column]:
    """Whether a mail is a forward, and the sender that the forwarded block names (on plain addresses)."""
    marker = r"(?im)^[ \t]*(?:-{2,}[ \t]*(?:forwarded message|original message|message transf[ée]r[ée]|message d'origine|mensaje reenviado|mensaje original)[ \t]*-{2,}|begin forwarded message\s*:|d[ée]but du message (?:r[ée]exp[ée]di[ée]|transf[ée]r[ée])\s*:)"
    marked = body.rlike(marker)
    found = marked | F.coalesce(subject.rlike(r"(?i)^\s*(?:fwd?|tr|wg|rv|enc)\s*:"), F.lit(False))
    tail = F.left(F.when(marked, F.try_element_at(F.split(body, marker, 2), F.lit(2))).otherwise(body), F.lit(5000))
    lines = F.transform(F.slice(F.split(tail, r"\r?\n"), 1, 40), lambda x: F.left(x, F.lit(300)))
    first = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"(?i)^\s*(?:from|de|von)\s*:")), F.lit(1))
    address = F.lower(F.coalesce(F.nullif(F.regexp_extract(first, r"<\s*([^<>\s@]+@[^<>\s@]+\.[^<>\s@]+)\s*>", 1), F.lit("")), F.regexp_extract(first, r"([^\s<>:,;\"()]+@[^\s<>,;\"()]+\.[^\s<>,;\"()]+)", 1)))
    return {"detected": found, "original_sender": F.when(found & (address != ""), address)}


def auth_verdict(mail: DataFrame, id_col: str = "mail_id", from_col: str = "from_header", auth_col: str = "auth_header", arc_col: str | None = None, domain: Column | None = None) -> DataFrame:
    """Per mail: spf, dkim, dmarc (result and domain), aligned, all_pass, crypto_verified, header_present.

    Per method the kept result is an aligned pass, else any pass, else the first.
    """
    dom = domain if domain is not None else simple_sender_domain(F.col(from_col))
    auth = F.nullif(F.col(auth_col), F.lit(""))
    arc = F.nullif(F.col(arc_col), F.lit("")) if arc_col else F.lit(None).cast("string")
    m = mail.select(id_col, F.coalesce(dom, F.lit("")).alias("from_domain"), F.coalesce(auth, arc).alias("ar"), auth.isNull().alias("arc_only"))
    m = m.withColumn("org", urls.org_domain(F.col("from_domain"))).withColumn("c", clauses(F.coalesce("ar", F.lit(""))))
    rank = lambda c: F.when(c["result"] != "pass", 0).when((c["domain"] != "") & (urls.org_domain(c["domain"]) == F.col("org")), 2).otherwise(1)

    def best(method: str) -> Column:
        own = F.filter("c", lambda c: c["method"] == method)
        ranked = F.array_sort(F.transform(own, lambda c: F.struct((-rank(c)).alias("r"), c["pos"].alias("pos"), c["result"].alias("result"), c["domain"].alias("domain"))))
        return F.try_element_at(ranked, F.lit(1))

    for method in ("spf", "dkim", "dmarc"):
        m = m.withColumn(f"b_{method}", best(method))
    for method in ("spf", "dkim", "dmarc"):
        m = m.withColumn(method, F.coalesce(F.col(f"b_{method}.result"), F.lit("none"))).withColumn(f"{method}_domain", F.coalesce(F.col(f"b_{method}.domain"), F.lit("")))
    ok = lambda k: (F.col(k) == "pass") & (F.col(f"{k}_domain") != "") & (urls.org_domain(F.col(f"{k}_domain")) == F.col("org"))
    proven = ~F.col("arc_only") & (F.col("org") != "")
    return m.select(
        id_col, "from_domain", "spf", "dkim", "dmarc", "spf_domain", "dkim_domain", "dmarc_domain",
        (proven & (ok("spf") | ok("dkim") | ok("dmarc"))).alias("aligned"),
        ((F.col("spf") == "pass") & (F.col("dkim") == "pass") & (F.col("dmarc") == "pass")).alias("all_pass"),
        (proven & ok("dkim")).alias("crypto_verified"), F.col("ar").isNotNull().alias("header_present"),
    )


def auth_delta(verdict: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Score change and reasons from a verdict, with a (domain, category) blocklist."""
    v = verdict
    if listed is not None:
        v = v.join(listed.select(F.col("domain").alias("from_domain"), "category"), "from_domain", "left")
    else:
        v = v.withColumn("category", F.lit(None).cast("string"))
    signs = [
        (F.col("crypto_verified"), -0.20, F.lit("dkim_aligned")), (F.col("all_pass"), -0.10, F.lit("spf+dkim+dmarc_pass")), (F.col("spf") == "fail", 0.15, F.lit("spf_fail")), (F.col("dkim") == "fail", 0.20, F.lit("dkim_fail")),
        (F.col("dmarc") == "fail", 0.25, F.lit("dmarc_fail")), (F.col("category").isNotNull(), 0.60, F.concat(F.lit("spamhaus_dbl:"), F.col("category"))), (~F.col("header_present"), 0.10, F.lit("no_auth_header")),
    ]
    delta = F.lit(0.0)
    for sign, points, _ in signs:
        delta = delta + F.when(sign, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(sign, name) for sign, _, name in signs]))
    return v.withColumn("score_delta", F.round(delta, 3)).withColumn("reasons", reasons).drop("category")


def metadata_score(from_header: Column, reply_to: Column, auth: Column, impersonated: Column) -> Column:
    """Header rules: another reply address, a failed check in the raw header, no header, a brand's name."""
    sender, reply = simple_sender_domain(F.coalesce(from_header, F.lit(""))), simple_sender_domain(F.coalesce(reply_to, F.lit("")))
    raw = F.coalesce(auth, F.lit(""))
    total = F.when((reply != "") & (reply != sender), 0.45).otherwise(0.0) + F.when(raw.contains("dkim=fail") | raw.contains("spf=fail"), 0.40).otherwise(0.0) + F.when(auth.isNull(), 0.15).otherwise(0.0) + F.when(impersonated, 0.35).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def synthesized_auth(signed_by: Column, mailed_by: Column, via: Column, from_domain: Column) -> Column:
    """An Authentication-Results value from what a mail client shows, empty without any."""
    host = lambda c: F.when(urls.is_hostname(F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")), F.regexp_replace(F.lower(F.trim(c)), r"\.+$", ""))
    signed, mailed = host(signed_by), F.coalesce(host(mailed_by), host(via))
    same = urls.org_domain(signed) == urls.org_domain(from_domain)
    text = F.concat_ws("; ", F.lit("client-context"), F.concat(F.lit("dkim=pass header.i=@"), signed), F.concat(F.lit("spf=pass smtp.mailfrom="), mailed), F.when(same & (from_domain != ""), F.concat(F.lit("dmarc=pass header.from="), from_domain)))
    return F.when(signed.isNull() & mailed.isNull(), "").otherwise(text)


def sent_on(date: Column) -> Column:
    """A mail's Date header as a timestamp; without a zone it counts as UTC."""
    d = F.trim(F.regexp_replace(F.regexp_replace(date, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
    d = F.regexp_replace(F.regexp_replace(d, r"(?:GMT|UTC|UT|Z)$", "+0000"), r"\s+", " ")
    d = F.when(d.rlike(r"[+-][0-9]{4}$"), d).otherwise(F.concat(d, F.lit(" +0000")))
    return F.coalesce(F.try_to_timestamp(d, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(d, F.lit("d MMM yyyy HH:mm Z")))


def header_map(items: Column) -> Column:
    """One value a header from (name, value) pairs as written: the first for identity headers, the last for others; spaces collapsed, cut at 8,000."""
    first = ["authentication-results", "arc-authentication-results", "from", "reply-to", "return-path", "subject"]
    low = F.transform(items, lambda x: F.struct(F.lower(x["name"]).alias("k"), F.left(F.trim(F.regexp_replace(x["value"], r"\s+", " ")), F.lit(8000)).alias("v")))
    names = F.array_distinct(F.transform(low, lambda x: x["k"]))
    pick = lambda k: F.filter(low, lambda x: x["k"] == k)
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.when(k.isin(first), F.element_at(pick(k), 1)["v"]).otherwise(F.element_at(pick(k), -1)["v"]).alias("value"))))


def header_features(h: Column, received: Column, names: Column) -> dict[str, Column]:
    """Features of a header map (lower-case keys), its Received values and its header names as written."""
    get = lambda k: F.coalesce(F.try_element_at(h, F.lit(k)), F.lit(""))
    dom = lambda c: F.element_at(F.split(F.regexp_extract(c, r"[\w.-]+@[\w.-]+\.\w+", 0), "@"), -1)
    sender, spf, auth, subject = dom(get("from")), F.lower(get("received-spf")), F.lower(get("authentication-results")), get("subject")
    soft = spf.contains("softfail")
    fail = spf.contains("fail") & ~soft
    urgent = F.lit(0)
    for k in dims.URGENT:
        urgent = urgent + F.lower(subject).contains(k).cast("int")
    differs = lambda k: (dom(get(k)) != sender) & (get(k) != "")
    out = {
        "sender_domain_length": F.length(sender), "sender_has_subdomain": (F.length(sender) - F.length(F.replace(sender, F.lit("."), F.lit("")))) > 1, "sender_has_digits": sender.rlike("[0-9]"), "sender_has_hyphen": sender.contains("-"),
        "reply_to_mismatch": differs("reply-to"), "has_reply_to": get("reply-to") != "", "return_path_mismatch": differs("return-path"),
        "spf_pass": spf.contains("pass") & ~soft & ~fail, "spf_fail": fail, "spf_softfail": soft, "spf_none": (spf == "") | spf.contains("none"),
        "dkim_pass": auth.contains("dkim=pass"), "dkim_fail": auth.contains("dkim=fail"), "dkim_none": auth.contains("dkim=none") | ~auth.contains("dkim"),
        "dmarc_pass": auth.contains("dmarc=pass"), "dmarc_fail": auth.contains("dmarc=fail"), "dmarc_none": auth.contains("dmarc=none") | ~auth.contains("dmarc"),
        "num_received_headers": F.size(received), "excessive_received_headers": F.size(received) > 10, "suspicious_ip_count": F.size(F.filter(received, lambda r: r.rlike(r"192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\."))),
        "subject_length": F.length(subject), "subject_has_re": F.lower(subject).startswith("re:"), "subject_has_fwd": F.lower(subject).startswith("fwd:"), "subject_all_caps": (F.upper(subject) == subject) & (F.lower(subject) != subject) & (F.length(subject) > 5),
        "subject_excessive_punctuation": F.length(F.regexp_replace(subject, "[^!?]", "")) > 3, "subject_urgent_keywords": urgent, "message_id_domain_mismatch": differs("message-id"), "has_message_id": get("message-id") != "",
        "num_x_headers": F.size(F.filter(names, lambda n: n.startswith("X-"))), "has_x_mailer": F.map_contains_key(h, "x-mailer"), "has_x_originating_ip": F.map_contains_key(h, "x-originating-ip"), "has_date": get("date") != "",
        "has_mime_version": get("mime-version") != "", "mime_version_1_0": get("mime-version") == "1.0", "is_multipart": F.lower(get("content-type")).contains("multipart"), "is_html": F.lower(get("content-type")).contains("text/html"),
        "high_priority": F.lower(get("x-priority")).contains("high") | F.lower(get("importance")).contains("high") | get("x-priority").contains("1"),
    }
    return {k: v.cast("int") for k, v in out.items()}
