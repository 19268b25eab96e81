"""From scores to verdicts: weighted fusion, trust paths and forcing signs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshline.functions import dims

# Fixed values of the decision.
W_TEXT, W_URL, W_META = 0.34, 0.33, 0.33
OVERRIDE, URL_RULE_MIN = 0.85, 0.25
URL_FLOOR, BLEND, LINK_TEXT_MIN = 0.95, 0.7, 0.5
IMPERSONATION_META, TRUSTED_META = 0.9, 0.05
ATTACHMENT, ATTACHMENT_TRUSTED, ATTACHMENT_TEXT, BONUS_MAX = 0.55, 0.72, 0.5, 0.7


def fuse(p_text: Column, p_url: Column, p_meta: Column, text_used: Column, factor: Column) -> Column:
    """Without usable text the other two share the weight; the text factor is not made up for elsewhere."""
    return F.when(text_used, W_TEXT * factor * p_text + W_URL * p_url + W_META * p_meta).otherwise((W_URL * p_url + W_META * p_meta) / (W_URL + W_META))


def apply_reputation(p_url: Column, rep_max: Column) -> Column:
    blended = BLEND * rep_max + (1 - BLEND) * p_url
    return F.when(rep_max >= 0.99, F.greatest(p_url, F.lit(URL_FLOOR))).when(rep_max > 0, F.greatest(p_url, blended)).otherwise(p_url)


def trust_path(trusted_sender: Column, crypto: Column, inbox_soft: Column, internal: Column) -> Column:
    return F.when(trusted_sender, "trusted_sender").when(crypto, "crypto_verified").when(inbox_soft & internal, "outlook_internal").when(inbox_soft, "gmail_inbox_soft").otherwise("default")


def summarize_reputation(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, rep_max, rep_sources, rep_threats, malicious_count) over the malicious verdicts of each mail."""
    bad = F.col("malicious")
    return verdicts.groupBy(key).agg(
        F.coalesce(F.max(F.when(bad, F.col("score"))), F.lit(0.0)).alias("rep_max"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(bad, F.col("sources")))))).alias("rep_sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(bad, F.col("threat_types")))))).alias("rep_threats"),
        F.count_if(bad).alias("malicious_count"),
    )


def decide_email(scores: DataFrame, text_override: float = OVERRIDE, repute: bool = False) -> DataFrame:
    """Adds trust_path, fused, threshold, forced_by and is_phishing to rows of scores and signs.

    Reads p_text, p_url, p_meta, text_used, trusted_sender, crypto_verified, inbox_soft, outlook_internal,
    strong_link, links_elsewhere, rep_max, rep_sources. With ``repute`` the link score is first lifted by reputation.
    """
    s = scores.withColumn("p_url", apply_reputation(F.col("p_url"), F.col("rep_max"))) if repute else scores
    s = s.withColumn("trust_path", trust_path(F.col("trusted_sender"), F.col("crypto_verified"), F.col("inbox_soft"), F.col("outlook_internal")))
    s = s.join(F.broadcast(dims.trust_paths(s.sparkSession)), "trust_path")  # five rows
    fused = fuse(F.col("p_text"), F.col("p_url"), F.col("p_meta"), F.col("text_used"), F.col("text_factor"))
    gsb = F.coalesce(F.array_contains("rep_sources", "google_safe_browsing"), F.lit(False))
    signs = {
        "confident_text": F.col("text_used") & (F.col("p_text") >= text_override),
        "confident_sender": F.col("p_meta") >= OVERRIDE,
        "confirmed_link": (F.col("p_url") >= OVERRIDE) & ((F.col("rep_max") > 0) | F.col("strong_link")),
        "safe_browsing": gsb,
        "links_elsewhere": F.col("links_elsewhere") & (F.col("p_text") >= LINK_TEXT_MIN),
    }
    holds = F.array_compact(F.array(*[F.when(c, k) for k, c in signs.items()]))
    s = s.withColumn("fused", fused).withColumn("forced_by", F.filter("forcing", lambda k: F.array_contains(holds, k)))
    return s.withColumn("is_phishing", (F.col("fused") >= F.col("threshold")) | (F.size("forced_by") > 0)).drop("forcing", "text_factor")


def feature_bonus(flags: Column) -> Column:
    risk = F.create_map(*[F.lit(x) for k, v in dims.FEATURE_RISK.items() for x in (k, v)])
    total = F.aggregate(flags, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(risk, f), F.lit(0.0)))
    login = F.array_contains(flags, "contains_form") & F.array_contains(flags, "contains_password_field")
    return F.least(F.lit(BONUS_MAX), total + F.when(login, 0.10).otherwise(0.0))


def dropper_techniques(flags: Column) -> Column:
    return F.array_sort(F.array_intersect(flags, dims.words(dims.DROPPERS)))


def url_confirmed(rep_max: Column, rule_score: Column) -> Column:
    return (rep_max > 0) | (rule_score >= URL_RULE_MIN)


def decide_attachment(rows: DataFrame, text_override: float = OVERRIDE) -> DataFrame:
    """Adds feature_bonus, dropper, fused, threshold, trust_path and is_phishing; reads p_text, p_url, flags, parent_trusted, rep_max, rep_sources, url_rule_score."""
    s = rows.withColumn("feature_bonus", feature_bonus(F.col("flags"))).withColumn("dropper", dropper_techniques(F.col("flags")))
    gsb = F.coalesce(F.array_contains("rep_sources", "google_safe_browsing"), F.lit(False))
    soft = F.col("parent_trusted") & ~gsb & (F.size("dropper") == 0)
    fused = F.when(soft, ATTACHMENT_TEXT * 0.5 * F.col("p_text")).otherwise(0.5 * F.col("p_text")) + 0.5 * F.col("p_url") + F.col("feature_bonus")
    forced = ~soft & (gsb | (F.size("dropper") > 0) | (F.col("p_text") >= text_override) | ((F.col("p_url") >= OVERRIDE) & url_confirmed(F.col("rep_max"), F.col("url_rule_score"))))
    s = s.withColumn("fused", F.least(F.lit(1.0), fused)).withColumn("threshold", F.when(soft, ATTACHMENT_TRUSTED).otherwise(ATTACHMENT))
    s = s.withColumn("trust_path", F.when(soft, "parent_trusted").otherwise("default")).withColumn("high_conf", forced)
    return s.withColumn("is_phishing", (F.col("fused") >= F.col("threshold")) | F.col("high_conf"))
