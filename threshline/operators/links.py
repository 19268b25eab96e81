"""Links of mails: ranking, profiles, features, and the score of the link agent.

Every distinct address is judged once; facts are joined back to the mails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.functions import dims, urls

ANY = "domain_has_ip domain_has_hyphen domain_has_at_symbol excessive_subdomains domain_has_suspicious_tld domain_length_suspicious possible_brand_spoofing path_has_suspicious_keywords url_has_encoding url_has_redirection has_query_params uses_non_standard_port is_shortened_url".split()
MOST = "domain_length domain_dots_count path_length query_param_count suspicious_param_count".split()


def url_facts(links: DataFrame, url_col: str = "url") -> DataFrame:
    """One row a distinct address: host, organisation, rule score and classes."""
    u = links.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    url, host, known = F.col("url"), F.col("host"), F.col("well_known")
    u = u.withColumn("host", urls.link_host(url))
    u = u.withColumns({"org": urls.org_domain(host), "is_ip": urls.ip_host(host), "has_user": urls.has_userinfo(url), "cloud": urls.on_cloud_file_host(host), "well_known": urls.well_known_link(url, host)})
    return u.withColumns({"rule_score": urls.rule_score(url, host, known), "strong": urls.strong_sign(url, host, known)})


def link_profile(links: DataFrame, senders: DataFrame, key: str = "mail_id") -> DataFrame:
    """Counts of a mail's distinct links by where they go; ``senders`` has (key, from_domain)."""
    facts = url_facts(links)
    d = links.select(key, "url").distinct().join(facts, "url").where((F.col("host") != "") & ~F.col("host").isin(dims.ASSET_HOSTS))
    d = d.join(senders.select(key, urls.org_domain(F.coalesce("from_domain", F.lit(""))).alias("own")), key, "left")
    kind = F.when((F.col("own") != "") & (F.col("org") == F.col("own")), "aligned").when(F.col("org").isin(dims.TRACKING), "tracking").when(F.col("cloud"), "cloud").when(F.col("well_known"), "well_known").otherwise("other")
    kinds = ("aligned", "well_known", "cloud", "tracking", "other")
    return d.withColumn("kind", kind).groupBy(key).agg(F.count("*").alias("links"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def links_elsewhere(cloud: Column, aligned: Column, other: Column) -> Column:
    return (cloud > 0) | ((aligned == 0) & (other > 0))


def rank_links(links: DataFrame, key: str = "mail_id", limit: int = 100, ranked: Column | None = None) -> DataFrame:
    """(key, grp, pos, url) to (key, rank, url): groups in order; in a group each host's first link before any second; distinct; cut at the end.

    Groups for which ``ranked`` holds keep their order.
    """
    at = F.row_number().over(W.partitionBy(key, "url").orderBy("grp", "pos"))
    once = links.select(key, "grp", "pos", "url", (ranked if ranked is not None else F.lit(False)).alias("kept")).withColumn("n", at).where("n = 1")
    second = F.row_number().over(W.partitionBy(key, "grp", "host").orderBy("pos"))
    once = once.withColumn("host", urls.link_host(F.col("url"))).withColumn("second", F.when(F.col("kept"), 0).otherwise((second > 1).cast("int")))
    rank = F.row_number().over(W.partitionBy(key).orderBy("grp", "second", "pos"))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select(key, "rank", "url")


def url_features(links: DataFrame, key: str = "mail_id", typosquatting: bool = False) -> DataFrame:
    """Features of a mail's written links: any, largest, all, and counts. Typosquatting runs a pandas UDF."""
    f = urls.model_features(F.col("url"))
    each = links.select("url").distinct().withColumns(f)
    if typosquatting:
        domain = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))
        hit = F.lit(False)
        for d in dims.MODEL_DOMAINS:
            hit = hit | ((urls.similarity(domain, F.lit(d)) > 0.8) & (domain != d))
        each = each.withColumn("potential_typosquatting", hit.cast("int"))
    names = ANY + (["potential_typosquatting"] if typosquatting else [])
    d = links.select(key, "url").join(each, "url")
    return d.groupBy(key).agg(F.count("*").alias("url_count"), F.lit(1).alias("has_urls"), (F.count("*") > 5).cast("int").alias("excessive_urls"), *[F.max(n).alias(n) for n in names + MOST], F.min("uses_https").alias("uses_https"))


def url_agent(links: DataFrame, bodies: DataFrame, key: str = "mail_id") -> DataFrame:
    """(key, p_url): .05 without links; the worst rule score of written links, of hidden ones at least .05."""
    d = links.select(key, "url").distinct().join(url_facts(links).select("url", "rule_score"), "url").join(bodies.select(key, "body"), key)
    written = F.array_contains(urls.urls_in_text(F.col("body")), F.col("url")) | F.contains("body", F.col("url"))
    s = d.withColumn("written", written).groupBy(key).agg(F.max(F.when(F.col("written"), F.col("rule_score"))).alias("seen"), F.max(F.when(~F.col("written"), F.col("rule_score"))).alias("hidden"))
    score = F.greatest(F.coalesce("seen", F.lit(0.05)), F.coalesce("hidden", F.lit(0.0)))
    return bodies.select(key).join(s, key, "left").select(key, F.coalesce(score, F.lit(0.05)).alias("p_url"))


def judged_links(ranked: DataFrame, key: str = "mail_id") -> DataFrame:
    """(key, links): each mail's ranked links with their facts, one array a mail (``rank_links`` bounds it); every distinct address is judged once."""
    facts = url_facts(ranked).select("url", "host", "org", "cloud", "well_known", "rule_score", "strong")
    each = F.struct("rank", "url", "host", "org", "cloud", "well_known", "rule_score", "strong")
    return ranked.join(facts, "url").groupBy(key).agg(F.sort_array(F.collect_list(each)).alias("links"))


def link_signs(links: Column, body: Column, own: Column) -> dict[str, Column]:
    """Within a mail's row: p_url as of ``url_agent``, strong_link, and the counts of ``link_profile``; ``own`` is the sender's organisation."""
    pages = F.filter(links, lambda x: (x["host"] != "") & ~x["host"].isin(dims.ASSET_HOSTS))
    kind = lambda x: F.when((own != "") & (x["org"] == own), "aligned").when(x["org"].isin(dims.TRACKING), "tracking").when(x["cloud"], "cloud").when(x["well_known"], "well_known").otherwise("other")
    found = urls.urls_in_text(body)

    def agent(said: Column) -> Column:
        written = lambda x: F.array_contains(said, x["url"]) | F.contains(body, x["url"])
        worst = lambda xs: F.array_max(F.transform(xs, lambda x: x["rule_score"]))
        return F.greatest(F.coalesce(worst(F.filter(links, written)), F.lit(0.05)), F.coalesce(worst(F.filter(links, lambda x: ~written(x))), F.lit(0.0)))

    p_url = F.when(F.size(links) > 0, F.element_at(F.transform(F.array(found), agent), 1)).otherwise(F.lit(0.05))
    count = lambda k: F.size(F.filter(pages, lambda x: kind(x) == k))
    kinds = {k: count(k) for k in ("aligned", "cloud", "other")}
    return {"p_url": p_url, "strong_link": F.exists(links, lambda x: x["strong"]), **kinds}


def shared_links(links: DataFrame, key: str = "mail_id") -> DataFrame:
    """(key, count, services, urls): links to file and form services; services in order of appearance, the first ten links."""
    hits = links.withColumn("service", urls.shared_service(F.col("url"))).where("service IS NOT NULL")
    first = F.array_sort(F.collect_list(F.struct("pos", "service", "url")))
    g = hits.groupBy(key).agg(F.count("*").alias("count"), first.alias("hits"))
    return g.select(key, "count", F.array_distinct(F.transform("hits", lambda h: h["service"])).alias("services"), F.transform(F.slice("hits", 1, 10), lambda h: h["url"]).alias("urls"))


def trusted_hosts(hosts: DataFrame, trusted: DataFrame, host_col: str = "host") -> DataFrame:
    """Rows whose host or one of its parents is listed: an equi-join on exploded suffixes, for lists of any size."""
    return hosts.join(listed_hosts(hosts, trusted, host_col), host_col, "left_semi")


def listed_hosts(hosts: DataFrame, listed: DataFrame, host_col: str = "host") -> DataFrame:
    """The distinct hosts that are listed, or have a parent that is; ``listed`` has a column domain."""
    d = hosts.select(host_col).distinct().withColumn("domain", F.explode(urls.host_suffixes(F.col(host_col))))
    return d.join(listed, "domain", "left_semi").select(host_col).distinct()
