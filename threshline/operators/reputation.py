"""Reputation of links: cache, a primary list under a quota, and three fallback lists, as joins over distinct addresses.

Lists are DataFrames, so that a deployment brings its own providers:
primary (url, threat_type), phish_urls (url), phish_hosts (host), malware (url), blocklist (domain, threat_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.functions import dims, urls
from threshline.operators.ordered import fold_sorted

PER_SCAN, TTL_HOURS = 30, 24
#: Blocklist answer, threat type and category (fixed values).
DBL_CODES = {"127.0.1.2": ("SPAM", "spam"), "127.0.1.4": ("SOCIAL_ENGINEERING", "phish"), "127.0.1.5": ("MALWARE", "malware"), "127.0.1.6": ("BOTNET_CC", "botnet_cc"), "127.0.1.102": ("SPAM", "abused_legit_spam"), "127.0.1.103": ("SUSPICIOUS", "abused_legit_redirector"), "127.0.1.104": ("SOCIAL_ENGINEERING", "abused_legit_phish"), "127.0.1.105": ("MALWARE", "abused_legit_malware"), "127.0.1.106": ("BOTNET_CC", "abused_legit_botnet_cc")}


def blocklist_verdict(code: Column) -> Column:
    """(threat_type, category, code) of a blocklist's answer; null for refusals and answers that are none."""
    known = F.create_map(*[x for k, (t, c) in DBL_CODES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("threat_type"), F.lit(c).alias("category")))])
    other = F.struct(F.lit("SUSPICIOUS").alias("threat_type"), F.lit("listed_unknown_code").alias("category"))
    v = F.coalesce(F.try_element_at(known, code), other)
    return F.when(code.startswith("127.0.1."), F.struct(v["threat_type"].alias("threat_type"), v["category"].alias("category"), code.alias("code")))


def phish_lookup(links: DataFrame, phish_urls: DataFrame, phish_hosts: DataFrame) -> DataFrame:
    """Adds match: "url" for a listed address, "domain" for a listed host that is no shared one, else null."""
    host = urls.link_host(F.col("url"))
    d = links.withColumn("host", host)
    d = d.join(phish_urls.select("url", F.lit(True).alias("_u")).distinct(), "url", "left").join(phish_hosts.select("host", F.lit(True).alias("_h")).distinct(), "host", "left")
    shared = urls.any_suffix(F.regexp_replace("host", r"^www\.", ""), dims.SHARED_PATH_HOSTS)
    return d.withColumn("match", F.when(F.col("_u"), "url").when(F.col("_h") & ~shared, "domain")).drop("_u", "_h")


def fallback_score(n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), 0.4 * n + 0.2)).otherwise(0.0)


def cascade(links: DataFrame, primary: DataFrame, phish_urls: DataFrame, phish_hosts: DataFrame, malware: DataFrame, blocklist: DataFrame, cache: DataFrame | None = None, key: str | None = None, per_scan: int = PER_SCAN) -> DataFrame:
    """A verdict for each distinct address (or each row, with ``key`` and ``rank``: only the first ``per_scan`` of a mail meet the primary list).

    The cache has (url, malicious, score, sources, threat_types) of verdicts that still hold.
    """
    d = links.withColumn("url", urls.lookup_form(F.col("url"))).where("url != ''")
    checked = d.where(F.col("rank") <= per_scan).select("url").distinct() if key else d.select("url").distinct()
    u = d.select("url").distinct().join(checked.withColumn("checked", F.lit(True)), "url", "left")
    none = F.array().cast("array<string>")
    if cache is not None:
        held = cache.select("url", *[F.col(c).alias(f"c_{c}") for c in ("malicious", "score", "sources", "threat_types")])
        u = u.join(held, "url", "left")
    else:
        u = u.withColumns({"c_malicious": F.lit(None).cast("boolean"), "c_score": F.lit(None).cast("double"), "c_sources": F.lit(None).cast("array<string>"), "c_threat_types": F.lit(None).cast("array<string>")})
    p = primary.groupBy("url").agg(F.array_sort(F.collect_set("threat_type")).alias("p_types"))
    u = phish_lookup(u.join(p, "url", "left"), phish_urls, phish_hosts)
    u = u.join(malware.select("url", F.lit(True).alias("mal")).distinct(), "url", "left")
    b = blocklist.groupBy("domain").agg(F.min("threat_type").alias("b_type"))
    u = u.join(b.withColumnRenamed("domain", "host"), "host", "left")
    hit = F.coalesce(F.col("checked"), F.lit(False)) & F.col("p_types").isNotNull()
    sources = F.array_compact(F.array(F.when(F.col("match").isNotNull(), "phishtank"), F.when(F.col("mal"), "urlhaus"), F.when(F.col("b_type").isNotNull(), "spamhaus_dbl")))
    types = F.array_compact(F.array(F.when(F.col("match").isNotNull(), "PHISHING"), F.when(F.col("mal"), "MALWARE"), F.col("b_type")))
    cached = F.col("c_malicious").isNotNull()
    u = u.withColumn("sources", F.when(cached, F.coalesce("c_sources", none)).when(hit, F.array(F.lit("google_safe_browsing"))).otherwise(sources))
    u = u.withColumn("threat_types", F.when(cached, F.coalesce("c_threat_types", none)).when(hit, F.col("p_types")).otherwise(F.array_sort(F.array_distinct(types))))
    tiers = F.when(cached, none).when(hit, F.array(F.lit("gsb"))).when(F.coalesce(F.col("checked"), F.lit(False)), dims.words(["gsb_clean", "phishtank", "urlhaus", "spamhaus_dbl"])).otherwise(dims.words(["phishtank", "urlhaus", "spamhaus_dbl"]))
    u = u.withColumn("score", F.when(cached, F.col("c_score")).when(hit, 1.0).otherwise(fallback_score(F.size("sources")))).withColumn("tiers_run", tiers)
    u = u.select("url", F.when(cached, F.col("c_malicious")).otherwise(F.size("sources") > 0).alias("malicious"), "score", "sources", "threat_types", "tiers_run", cached.alias("cached"))
    return d.join(u, "url") if key else u


def cacheable(verdicts: DataFrame) -> DataFrame:
    """Verdicts to keep: malicious ones, and clean ones that the primary list answered for."""
    return verdicts.where(~F.col("cached") & (F.col("malicious") | F.array_contains("tiers_run", "gsb_clean")))


def fully_checked(verdicts: Column) -> Column:
    return F.forall(verdicts, lambda v: v["malicious"] | F.array_contains(v["tiers_run"], "gsb_clean"))


def keep_latest(rows: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame:
    """The last row of each key, and of those the newest ``most``."""
    d = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return d.orderBy(F.desc(order), key).limit(most) if most else d


def unexpired(cache: DataFrame, now: Column, hours: int = TTL_HOURS) -> DataFrame:
    return cache.where(F.col("stored_at") > now - F.expr(f"INTERVAL {hours} HOURS"))


def admit_quota(requests: DataFrame, limit: int, buffer: int) -> DataFrame:
    """(day, id, admitted): all-or-nothing requests of size n against a daily budget, in order of ts and id.

    A refused request leaves room for a smaller one, so no running sum decides; each day is folded in order.
    """
    most = limit - buffer

    def step(used: int, row: tuple) -> tuple[int, bool]:
        ok = used + row[3] <= most
        return used + row[3] * ok, ok

    rows = requests.select(F.to_date("ts").alias("day"), "ts", F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"))
    return fold_sorted(rows, "day", ["ts", "id"], int, step, "admitted", "boolean", ["day", "id"])


def admit_units(requests: DataFrame, limit: int, buffer: int) -> DataFrame:
    """The same for requests of size 1, where a running count is exact and scales with the day's rows."""
    at = F.row_number().over(W.partitionBy("day").orderBy("ts", "id"))
    return requests.withColumn("day", F.to_date("ts")).withColumn("at", at).select("day", "id", (F.col("at") <= limit - buffer).alias("admitted"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate) of rows with a boolean hit."""
    return lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
