"""Scan history: totals, days, tokens, sources, exports, reports and their deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshline.functions.text import csv_cell, redact
from threshline.sources.stores import folder_bytes

MOST = 500
SOURCES = "gmail gmail-attachment gmail-auto outlook file attachment paste unknown".split()
CAUTIONS = "contains_macros encrypted_archive encrypted_document contains_qr_code contains_password_field".split()


def history_row(scans: DataFrame) -> DataFrame:
    """Scans as history rows: subjects and senders cut at 120, the newest 500 kept."""
    d = scans.withColumn("subject", F.left(F.coalesce("subject", F.lit("")), F.lit(120))).withColumn("sender", F.left(F.coalesce("sender", F.lit("")), F.lit(120)))
    return d.orderBy(F.desc("ts"), "id").limit(MOST)


def totals(scans: DataFrame) -> DataFrame:
    """Counts, rounded percentages (half up) and the mean score."""
    ph = F.count_if(F.col("verdict") == "phishing")
    d = scans.agg(F.count("*").alias("total"), ph.alias("phishing"), F.avg(F.coalesce("score", F.lit(0.0))).alias("avg_score"), F.min("ts").alias("first_scan"), F.max("ts").alias("last_scan"))
    pct = lambda c: F.coalesce(F.round(F.try_divide(100.0 * c, F.col("total"))), F.lit(0.0)).cast("int")
    d = d.withColumn("safe", F.col("total") - F.col("phishing"))
    return d.withColumns({"phishing_pct": pct(F.col("phishing")), "safe_pct": pct(F.col("safe")), "avg_score": F.coalesce("avg_score", F.lit(0.0))})


def daily(scans: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """The last days with their counts, zeros included; days are the session time zone's."""
    axis = scans.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    n = scans.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("verdict") == "phishing").alias("phishing"), F.count_if(F.col("verdict") == "safe").alias("safe"))
    return axis.join(n, "day", "left").select("day", F.coalesce("phishing", F.lit(0)).alias("phishing"), F.coalesce("safe", F.lit(0)).alias("safe"))


def top_tokens(scans: DataFrame, stopwords: list[str], n: int = 12) -> DataFrame:
    """The tokens of phishing scans with the largest summed weight."""
    t = scans.where("verdict = 'phishing'").select(F.explode("tokens").alias("t")).select(F.lower(F.coalesce("t.token", F.lit(""))).alias("token"), F.abs(F.coalesce("t.weight", F.lit(0.0))).alias("w"))
    t = t.where((F.length("token") >= 3) & ~F.col("token").rlike("^[0-9]+(?:px|em|pt|%)?$") & ~F.col("token").isin(stopwords))
    return t.groupBy("token").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "token").limit(n)


def by_source(scans: DataFrame) -> DataFrame:
    """Counts by source, zeros for the known ones."""
    known = scans.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    n = scans.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    return known.join(n, "source", "full").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def stats_rows(scans: DataFrame, *keys: str) -> DataFrame:
    """Rows to share: no subject, sender or text; scores clamped, enums checked."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))))
    lang = F.when(F.col("lang").rlike("^[a-z]{2,3}$"), F.col("lang"))
    return scans.select(
        *keys, F.date_format("ts", "yyyy-MM-dd").alias("day"), F.left(F.coalesce("source", F.lit("unknown")), F.lit(30)).alias("source"), F.when(F.col("verdict") == "phishing", "phishing").otherwise("safe").alias("verdict"), unit("score").alias("score"),
        F.coalesce("trusted", F.lit(False)).alias("trusted"), F.when(F.col("label").isin("correct", "wrong"), F.col("label")).alias("label"), lang.alias("lang"),
    )


def csv_rows(scans: DataFrame) -> DataFrame:
    """History as text cells that no spreadsheet runs; write with ``df.write.csv``."""
    return scans.select(*[csv_cell(F.col(c).cast("string")).alias(c) for c in scans.columns if not c.startswith("_")])


def is_caution(flags: Column, phishing: Column) -> Column:
    return ~phishing & F.arrays_overlap(flags, F.array(*[F.lit(c) for c in CAUTIONS]))


def newest(rows: DataFrame, n: int, key: str = "id", order: str = "ts", since: Column | None = None) -> DataFrame:
    """The newest n rows, of those after ``since``."""
    d = rows.where(F.col(order) >= since) if since is not None else rows
    return d.orderBy(F.desc(order), key).limit(n)


def valid_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused reports; refused ones carry the reason."""
    reason = F.when(~F.col("kind").isin("false_positive", "false_negative", "bug", "stats", "language") | F.col("kind").isNull(), "kind").when(F.length(F.coalesce("text", F.lit(""))) > 20_000, "text").when(~F.coalesce(F.col("fused_score"), F.lit(0.0)).between(0, 1), "fused_score")
    d = reports.withColumn("reason", reason)
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL")


def store_reports(reports: DataFrame, path: str, most_bytes: int | None = None) -> bool:
    """Append redacted reports to monthly JSON folders; refused once the store has reached its size."""
    if most_bytes is not None and folder_bytes(reports.sparkSession, path) >= most_bytes:
        return False
    d = reports.withColumn("text", redact(F.col("text"))).withColumn("month", F.date_format("received", "yyyy-MM"))
    d.write.mode("append").partitionBy("month").json(path)
    return True


def without_reports(reports: DataFrame, references: DataFrame) -> DataFrame:
    """Reports but for the given references; write them to a new folder and swap."""
    return reports.join(references, "reference", "left_anti")


def verdict_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("endpoint", "verdict", "trust_path").agg(F.count("*").alias("n"))


def one_line(report: DataFrame) -> DataFrame:
    return report.select("reference", F.concat_ws(" · ", "kind", "verdict", F.format_string("%.2f", F.col("fused_score").cast("double"))).alias("line"))
