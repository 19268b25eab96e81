"""Addresses of links as browsers read them, as column expressions.

Hosts that are percent-encoded or not ASCII need Unicode normalisation, which
has no built-in: ``browser_url`` sends only those through a pandas UDF.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.functions import dims

_SCHEME = r"^\s*(?i:(https?)):[/\\]*"
IN_TEXT = r"""(?i)(?:https?://|www\.)[^\s"'<>)\]}]+"""


def any_suffix(host: Column, suffixes: list[str]) -> Column:
    """The host is one of the suffixes or below one: each suffix of the host is looked up, so the list may be long."""
    return F.arrays_overlap(host_suffixes(host), dims.words(suffixes))


def host_suffixes(host: Column) -> Column:
    """The host and all its parents: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


@F.pandas_udf(T.StringType())
def _unicode_host(host: pd.Series) -> pd.Series:
    dots = str.maketrans({"。": ".", "．": ".", "｡": "."})

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        d = unicodedata.normalize("NFKC", unquote(h)).translate(dots)
        return h if set(d) & set("/\\?#@[]% :") else d

    return host.map(one)


def split_url(url: Column, unicode_hosts: bool = False) -> dict[str, Column]:
    """scheme, userinfo, host, port and tail of an address; scheme is empty where it is not http(s)."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    rest = F.replace(F.regexp_replace(url, _SCHEME, ""), F.lit("\\"), F.lit("/"))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(authority) + 1)
    userinfo = F.regexp_extract(authority, r"^(.*)@", 1)
    hostport = F.regexp_replace(authority, r"^.*@", "")
    port = F.when(hostport.startswith("["), F.regexp_extract(hostport, r"\](:[0-9]+)$", 1)).otherwise(F.regexp_extract(hostport, r"(:[0-9]+)$", 1))
    host = F.when(hostport.startswith("["), F.regexp_extract(hostport, r"^\[[^\]]*\]?", 0)).otherwise(F.regexp_replace(hostport, ":[0-9]*$", ""))
    if unicode_hosts:
        host = F.when(host.rlike("[^\\x00-\\x7F]|%"), _unicode_host(host)).otherwise(host)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return {"scheme": scheme, "userinfo": userinfo, "has_userinfo": authority.contains("@"), "host": host, "port": port, "tail": tail}


def browser_url(url: Column, unicode_hosts: bool = True) -> Column:
    p = split_url(url, unicode_hosts)
    at = F.when(p["has_userinfo"], F.concat(p["userinfo"], F.lit("@"))).otherwise("")
    return F.when(p["scheme"] == "", url).otherwise(F.concat(p["scheme"], F.lit("://"), at, p["host"], p["port"], p["tail"]))


def link_host(url: Column, unicode_hosts: bool = False) -> Column:
    """The host after any user part, lower case, without brackets or final dots; addresses without a scheme count as http."""
    whole = F.when(url.rlike(_SCHEME), url).when(url.contains("://"), F.regexp_replace(url, r"^[^:]*://", "http://")).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_replace(split_url(whole, unicode_hosts)["host"], r"^\[|\]$", "")


def has_userinfo(url: Column) -> Column:
    return F.when(url.rlike(_SCHEME), split_url(url)["has_userinfo"]).otherwise(F.regexp_extract(F.regexp_replace(url, "^[^:]*://", ""), r"^[^/?#]*", 0).contains("@"))


def org_domain(domain: Column) -> Column:
    """The registrable domain: two labels, or three under country second levels and shared hosts."""
    parts = F.filter(F.split(F.lower(F.trim(domain)), r"\."), lambda p: p != "")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), F.lit(n)), ".")
    deep = last(2).isin(dims.SHARED_SUFFIXES) | ((F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(dims.SECOND_LEVEL))
    return F.when(F.size(parts) == 0, "").when((F.size(parts) > 2) & deep, last(3)).otherwise(last(2))


def ip_host(host: Column) -> Column:
    """Dotted, IPv6, or one to four decimal, octal or hexadecimal numbers."""
    number = r"(?:0[xX][0-9a-fA-F]+|[0-9]+)"
    bare = F.regexp_replace(host, r"^\[|\]$|\.$", "")
    return bare.rlike(rf"^{number}(?:\.{number}){{0,3}}$") | (bare.contains(":") & bare.rlike("^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"))


def lookalike_host(host: Column) -> Column:
    return host.rlike(r"[^\x00-\x7F]|(?:^|\.)xn--")


def on_cloud_file_host(host: Column) -> Column:
    return any_suffix(host, dims.CLOUD_FILE_HOSTS)


def browser_path(path: Column) -> Column:
    """Percent-decoded, with dot segments resolved and empty segments dropped."""
    plain = F.replace(F.coalesce(F.try_url_decode(F.replace(F.when(path == "", "/").otherwise(path), F.lit("+"), F.lit("%2B"))), path), F.lit("\\"), F.lit("/"))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.filter(F.split(plain, "/"), lambda s: ~s.isin("", ".")),
        none,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    end = F.when(plain.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


#: Another address inside a link, or a path that only redirects (fixed pattern values).
EMBEDDED = r"(?i)https?:|[/\\]{2}|[=?&#]\s*www\.[\w-]+\.|^/amp/(?:s/)?[\w-]+(?:\.[\w-]+)+|^/(?:url|redirect|l\.php|slink|linkredirect|iclouddrive|safe_redirect|away)(?:[/?#.]|$)"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def well_known_link(url: Column, host: Column | None = None) -> Column:
    """A link to a large known site that carries no other address."""
    host, tail = link_host(url) if host is None else host, split_url(url)["tail"]
    path, rest = F.regexp_extract(tail, "^[^?#]*", 0), F.regexp_extract(tail, "[?#].*$", 0)
    query, fragment = F.regexp_extract(rest, r"^\?([^#]*)", 1), F.regexp_extract(rest, "#(.*)$", 1)
    whole = _decoded(_decoded(F.concat(browser_path(path), F.lit("?"), query, F.lit("#"), fragment)))
    known = host.isin(dims.WELL_KNOWN) | org_domain(host).isin(dims.WELL_KNOWN)
    # the cheap test first: most links are to no known site
    return known & (host != "") & ~on_cloud_file_host(host) & ~any_suffix(host, dims.USER_CONTENT_HOSTS) & ~whole.rlike(EMBEDDED)


def suspicious_tld(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1).isin(dims.SUSPICIOUS_TLDS)


def rule_score(url: Column, host: Column | None = None, known: Column | None = None) -> Column:
    """Rule score of one address: http, IP, user part, length, TLD, look-alike, words, cloud file; known sites at most .10.

    Pass the host, and whether the site is known, where they are columns already.
    """
    host = link_host(url) if host is None else host
    known = well_known_link(url, host) if known is None else known
    parts = [
        (F.lower(url).startswith("http://"), 0.25), (ip_host(host), 0.40), (has_userinfo(url), 0.35), (F.length(url) > 75, 0.15), (suspicious_tld(host), 0.30),
        (lookalike_host(host), 0.30), (url.rlike("(?i)login|verify|account|update|secure"), 0.10), (on_cloud_file_host(host), 0.45),
    ]
    total = F.lit(0.0)
    for sign, points in parts:
        total = total + F.when(sign, points).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(known, F.least(total, F.lit(0.10))).otherwise(total))


def strong_sign(url: Column, host: Column | None = None, known: Column | None = None) -> Column:
    host = link_host(url) if host is None else host
    known = well_known_link(url, host) if known is None else known
    return ~known & (ip_host(host) | has_userinfo(url) | lookalike_host(host) | suspicious_tld(host) | on_cloud_file_host(host))


def urls_in_text(text: Column, limit: int | None = None) -> Column:
    """Addresses written in a text, end punctuation cut, www. completed, as browsers read them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
    found = F.transform(found, lambda u: browser_url(F.when(F.lower(F.left(u, F.lit(4))) == "www.", F.concat(F.lit("http://"), u)).otherwise(u), unicode_hosts=False))
    found = F.array_distinct(found) if limit else found
    return F.slice(found, 1, limit) if limit else found


def client_links(urls: Column, limit: int = 50) -> Column:
    """Kept links of a client: http(s), below 2,049 characters, distinct in order, then cut."""
    kept = F.transform(F.filter(urls, lambda u: u.isNotNull() & (F.length(u) <= 2048)), lambda u: browser_url(F.trim(u), unicode_hosts=False))
    return F.slice(F.array_distinct(F.filter(kept, lambda u: u.rlike("^https?://"))), 1, limit)


def lookup_form(url: Column) -> Column:
    """The form under which reputation is kept: trimmed, with a scheme."""
    u = F.trim(url)
    return F.when(u == "", "").when(u.rlike("^(?i)https?://"), u).otherwise(F.concat(F.lit("http://"), u))


def shared_service(url: Column) -> Column:
    """The first file or form service whose host and path match, else null."""
    facts = F.struct(host_suffixes(link_host(url)).alias("hosts"), browser_path(F.regexp_extract(split_url(url)["tail"], "^[^?#]*", 0)).alias("path"))

    def first(f: Column) -> Column:
        return F.coalesce(*[F.when(F.arrays_overlap(f["hosts"], dims.words(hosts.split())) & f["path"].startswith(prefix), name) for hosts, prefix, name in dims.SHARE_SERVICES])

    return F.element_at(F.transform(F.array(facts), lambda f: first(f)), 1)


def payload_url(payload: Column) -> Column:
    """The address of a scanned code: http(s), or a bare domain; else null."""
    p = F.trim(payload)
    full = F.when(p.rlike("^(?i)https?://"), p).when(p.rlike(r"^(?i)[a-z0-9][a-z0-9.-]{0,251}\.[a-z]{2,24}(?:/\S*)?$"), F.concat(F.lit("http://"), p))
    return F.when(F.length(p) <= 2048, browser_url(full, unicode_hosts=False))


def absolute_http(href: Column) -> Column:
    """An href as an absolute http(s) address, or empty."""
    h = F.regexp_replace(F.trim(href), r"[\t\r\n]", "")
    return F.when(h.rlike(_SCHEME), browser_url(h, unicode_hosts=False)).when(h.rlike(r"^[/\\]{2}"), browser_url(F.concat(F.lit("http:"), h), unicode_hosts=False)).otherwise("")


def is_hostname(name: Column) -> Column:
    labels = F.split(name, r"\.")
    return F.length(name).between(1, 253) & (F.size(labels) >= 2) & F.forall(labels, lambda p: p.rlike("^[a-z0-9-]{1,63}$"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0 where either side is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


#: Addresses as the trained link model finds them in a text.
MODEL_URL = r"""https?://[^\s<>"{}|\\^`\[\]]+"""


def model_features(url: Column) -> dict[str, Column]:
    """Features of one address, all integers, as the link model was trained on (typosquatting needs ``similarity``)."""
    scheme_rest = F.regexp_replace(url, "^[a-zA-Z]+://", "")
    domain = F.lower(F.regexp_extract(scheme_rest, r"^[^/?#]*", 0))
    tail = F.substr(scheme_rest, F.length(domain) + 1)
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    port = F.try_to_number(F.regexp_extract(domain, ":([0-9]{1,5})$", 1), F.lit("99999"))
    known = F.lit(False)
    for d in dims.MODEL_DOMAINS:
        known = known | (domain == d) | domain.endswith(f".{d}")
    has = lambda c, words: F.greatest(*[c.contains(w) for w in words])
    ends = F.greatest(*[domain.endswith(t) for t in dims.MODEL_TLDS])
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    params = F.lit(0)
    for p in dims.SUSPICIOUS_PARAMS:
        params = params + F.lower(query).contains(p).cast("int")
    out = {
        "domain_length": F.length(domain),
        "domain_has_ip": domain.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
        "domain_has_hyphen": domain.contains("-"),
        "domain_has_at_symbol": url.contains("@"),
        "domain_dots_count": dots,
        "excessive_subdomains": dots > 3,
        "domain_has_suspicious_tld": ends,
        "domain_length_suspicious": F.length(domain) > 30,
        "possible_brand_spoofing": has(domain, dims.MODEL_BRANDS) & ~known,
        "path_length": F.length(path),
        "path_has_suspicious_keywords": has(F.lower(path), dims.PATH_KEYWORDS),
        "url_has_encoding": url.contains("%"),
        "url_has_redirection": F.regexp_extract(scheme_rest, "^(.*?)(?:://|$)", 1).contains("//"),
        "has_query_params": query != "",
        "query_param_count": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "suspicious_param_count": params,
        "uses_non_standard_port": F.coalesce(~port.isin(80, 443), F.lit(False)),
        "is_shortened_url": has(domain, dims.SHORTENERS),
        "uses_https": F.lower(url).startswith("https://"),
    }
    return {k: v.cast("int") for k, v in out.items()}
