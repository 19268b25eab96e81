"""The library's front: analyse mail and attachments, explain, and redact, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshline.functions import dims, headers, text, urls
from threshline.operators import fusion, links, model, reputation
from threshline.sources import files


def resolve(requests: DataFrame) -> DataFrame:
    """Body and From of requests: the raw mail's, else what the client sent.

    Reads parsed body and headers (or null), raw_text, sender_email, sender_name.
    """
    made = F.when(F.col("sender_email").isNotNull(), F.concat(F.coalesce(F.concat(F.lit('"'), F.replace("sender_name", F.lit('"'), F.lit("")), F.lit('" ')), F.lit("")), F.lit("<"), F.col("sender_email"), F.lit(">")))
    return requests.withColumn("body", F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("raw_text"), F.lit(""))).withColumn("from_header", F.coalesce(F.nullif(F.col("from_header"), F.lit("")), made, F.lit("")))


def within_size(requests: DataFrame, column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Requests to judge, and those refused because the column is missing or too large."""
    ok = F.coalesce(F.octet_length(column) <= most, F.lit(False))
    return requests.where(ok), requests.where(~ok).withColumn("reason", F.when(F.col(column).isNull(), "unsized").otherwise("too large"))


def text_scores(mail: DataFrame, fitted: PipelineModel, temperature: float = 1.0, key: str = "mail_id") -> DataFrame:
    """(key, p_text) of the text model over subject and body, normalised as in training."""
    d = mail.select(key, text.raw_text(F.col("body"), F.col("subject")).alias("raw"), "subject")
    d = d.select(key, text.normalize_text(text.model_text(F.col("subject"), F.col("raw"))).alias("text"))
    return model.text_agent(d, fitted, temperature).select(key, "p_text")


def analyse(mail: DataFrame, link_rows: DataFrame, verdicts: DataFrame | None = None, trusted: DataFrame | None = None, scores: DataFrame | None = None, blocklist: DataFrame | None = None, text_model: PipelineModel | None = None) -> DataFrame:
    """A verdict row for each mail.

    ``mail`` has mail_id, body, from_header, reply_to, auth_header, subject, inbox_soft, outlook_internal;
    ``link_rows`` mail_id, grp, pos, url; ``verdicts`` url, malicious, score, sources, threat_types;
    ``scores`` mail_id, p_text (0 where missing), or ``text_model`` a model of ``operators.model.fit_text`` that scores the mail here.
    """
    key = "mail_id"
    spark = mail.sparkSession
    ranked = links.rank_links(link_rows)
    auth = headers.auth_delta(headers.auth_verdict(mail), blocklist)
    brand = headers.impersonations(mail, dims.brands(spark))
    fwd = headers.forward_parts(F.col("body"), F.col("subject"))
    none = F.array().cast("array<string>")
    d = mail.join(auth.drop("aligned"), key).join(brand, key, "left").join(links.judged_links(ranked), key, "left")
    own = F.coalesce("links", F.array().cast("array<struct<rank:int,url:string,host:string,org:string,cloud:boolean,well_known:boolean,rule_score:double,strong:boolean>>"))
    d = d.withColumn("links", own).withColumn("own", urls.org_domain(F.coalesce("from_domain", F.lit(""))))
    d = d.withColumns(links.link_signs(F.col("links"), F.coalesce("body", F.lit("")), F.col("own"))).drop("links", "own")
    if verdicts is not None:
        rep = fusion.summarize_reputation(ranked.join(verdicts, "url"), key)
        d = d.join(rep, key, "left")
    else:
        d = d.withColumns({"rep_max": F.lit(0.0), "rep_sources": none})
    if scores is None and text_model is not None:
        scores = text_scores(mail, text_model)
    d = d.join(scores.select(key, "p_text"), key, "left") if scores is not None else d.withColumn("p_text", F.lit(0.0))
    allow = trusted.select("domain") if trusted is not None else dims.table(spark, "domain", dims.TRUSTED_SEED)
    d = d.join(links.listed_hosts(auth, allow, "from_domain").withColumn("allowed", F.lit(True)), "from_domain", "left")
    fake = F.col("brand").isNotNull()
    plain = ~fwd["detected"] & ~fake
    meta = headers.metadata_score(F.col("from_header"), F.col("reply_to"), F.col("auth_header"), fake) + F.col("score_delta")
    meta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), meta))
    meta = F.when(fake, F.greatest(meta, F.lit(fusion.IMPERSONATION_META))).otherwise(meta)
    trusted_sender = F.col("crypto_verified") & plain & F.coalesce("allowed", F.lit(False))
    d = d.withColumns({
        "trusted_sender": trusted_sender, "crypto_verified": F.col("crypto_verified") & plain, "inbox_soft": F.coalesce("inbox_soft", F.lit(False)) & plain, "outlook_internal": F.coalesce("outlook_internal", F.lit(False)),
        "text_used": F.size(F.filter(F.split(F.trim("body"), r"\s+"), lambda w: w != "")) >= 3, "p_text": F.coalesce("p_text", F.lit(0.0)),
        "links_elsewhere": links.links_elsewhere(F.col("cloud"), F.col("aligned"), F.col("other")), "rep_max": F.coalesce("rep_max", F.lit(0.0)), "rep_sources": F.coalesce("rep_sources", none),
        "p_meta": F.when(trusted_sender, F.least(meta, F.lit(fusion.TRUSTED_META))).otherwise(meta),
    })
    out = fusion.decide_email(d, repute=True)
    return out.select(key, "p_text", "p_url", "p_meta", "fused", "threshold", "trust_path", "forced_by", "is_phishing", F.when(F.col("is_phishing"), "phishing").otherwise("safe").alias("verdict"), "brand", "reasons", "rep_sources")


def analyse_attachments(attachments: DataFrame, verdicts: DataFrame | None = None, text_model: PipelineModel | None = None) -> DataFrame:
    """A verdict row for each attachment (id, filename, content, mime, parent_trusted), with the members of archives that explain it.

    ``verdicts`` are reputation answers for addresses, as in ``analyse``; ``text_model`` scores the extracted text.
    Every distinct address is judged once.
    """
    key = "id"
    d = files.analyse(attachments)
    found = d.select(key, F.explode("extracted_urls").alias("url")).distinct()
    worst = found.join(links.url_facts(found).select("url", "rule_score"), "url").groupBy(key).agg(F.max("rule_score").alias("url_rule_score"))
    none = F.array().cast("array<string>")
    d = d.join(worst, key, "left").withColumn("url_rule_score", F.coalesce("url_rule_score", F.lit(0.0)))
    d = d.withColumn("p_url", F.greatest(F.lit(0.05), F.col("url_rule_score")))
    if verdicts is not None:
        met = found.join(verdicts, "url")
        bad = met.where("malicious").groupBy(key).agg(F.collect_set("url").alias("bad_urls"))
        d = d.join(fusion.summarize_reputation(met, key), key, "left").join(bad, key, "left")
        d = d.withColumns({"rep_max": F.coalesce("rep_max", F.lit(0.0)), "rep_sources": F.coalesce("rep_sources", none), "bad_urls": F.coalesce("bad_urls", none)})
    else:
        d = d.withColumns({"rep_max": F.lit(0.0), "rep_sources": none, "bad_urls": none})
    if text_model is not None:
        scored = d.where(F.trim("extracted_text") != "").select(key, text.normalize_text(F.col("extracted_text")).alias("text"))
        d = d.join(model.text_agent(scored, text_model).select(key, "p_text"), key, "left").withColumn("p_text", F.coalesce("p_text", F.lit(0.0)))
    else:
        d = d.withColumn("p_text", F.lit(0.0))
    d = d.withColumns({"p_url": fusion.apply_reputation(F.col("p_url"), F.col("rep_max")), "flags": F.col("notable_features"), "suspicious_files": files.archive_report(F.col("names"), F.col("inner"), F.col("bad_urls"))})
    return fusion.decide_attachment(d).drop("flags", "names", "inner", "bad_urls")


def explain(rows: DataFrame, fitted: PipelineModel, key: str, text_col: str = "text") -> DataFrame:
    return model.explain(rows, fitted, key, text_col)


def redact(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumn(text_col, text.redact(F.col(text_col)))


def check_urls(link_rows: DataFrame, **lists: DataFrame) -> DataFrame:
    return reputation.cascade(link_rows, **lists)
