"""Evaluation of runs: confusion counts, intervals, samples and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The 95% interval of k of n, clamped; null for none."""
    p = F.try_divide(k.cast("double"), n)
    d, c = 1 + z * z / n, p + z * z / (2 * n)
    r = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), (c - r) / d)), F.when(ok, F.least(F.lit(1.0), (c + r) / d))


def share_text(k: Column, n: Column) -> Column:
    """"p% (k/n, 95% CI a to b)", or n/a."""
    lo, hi = wilson(k, n)
    pct = lambda x: F.concat(F.format_string("%.1f", 100 * x), F.lit("%"))
    return F.when(n == 0, "n/a").otherwise(F.concat(pct(F.try_divide(k.cast("double"), n)), F.lit(" ("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(", 95% CI "), pct(lo), F.lit(" to "), pct(hi), F.lit(")")))


def confusion_by_language(run: DataFrame) -> DataFrame:
    """tp, fn, fp, tn per language and over all ("all"); rows with an error are left out."""
    flagged, bad = F.col("verdict") == "phishing", F.col("label") == "phishing"
    counts = [F.count_if(bad & flagged).alias("tp"), F.count_if(bad & ~flagged).alias("fn"), F.count_if(~bad & flagged).alias("fp"), F.count_if(~bad & ~flagged).alias("tn")]
    d = run.where("error IS NULL")
    g = d.rollup("lang").agg(F.grouping("lang").alias("g"), *counts)
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("lang", F.lit("und"))).alias("lang"), "tp", "fn", "fp", "tn").where("tp + fn + fp + tn > 0")


def with_intervals(groups: DataFrame) -> DataFrame:
    fa, ph = (F.col("fp"), F.col("fp") + F.col("tn")), (F.col("tp"), F.col("tp") + F.col("fn"))
    (a, b), (c, d) = wilson(*fa), wilson(*ph)
    return groups.withColumns({"false_alarm_lo": a, "false_alarm_hi": b, "caught_lo": c, "caught_hi": d, "small": (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")) < 30})


def report(run: DataFrame) -> DataFrame:
    """The report's lines in order: all first, then languages."""
    g = confusion_by_language(run)
    return g.select("lang", share_text(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarms"), share_text(F.col("tp"), F.col("tp") + F.col("fn")).alias("caught")).orderBy(F.col("lang") != "all", "lang")


def error_counts(run: DataFrame) -> DataFrame:
    return run.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")


def error_name(status: Column, detail: Column, kind: Column) -> Column:
    return F.when(status.isNull(), kind).otherwise(F.concat(F.lit("HTTP "), status.cast("string"), F.when(F.coalesce(detail, F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), F.left(detail, F.lit(80))))))


def wrong_rows(run: DataFrame) -> DataFrame:
    """False alarms and misses, by kind."""
    kind = F.when((F.col("label") == "legit") & (F.col("verdict") == "phishing"), "false_alarm").when((F.col("label") == "phishing") & (F.col("verdict") == "safe"), "missed")
    return run.withColumn("kind", kind).where("kind IS NOT NULL")


def error_profile(run: DataFrame) -> DataFrame:
    """Mean scores of each kind of wrong verdict, and how many one check alone decided."""
    return wrong_rows(run).groupBy("kind").agg(F.count("*").alias("n"), F.avg("p_text").alias("text"), F.avg("p_url").alias("url"), F.avg("p_meta").alias("metadata"), F.count_if("override").alias("forced"))


def error_paths(run: DataFrame) -> DataFrame:
    return wrong_rows(run).groupBy("kind", F.coalesce("trust_path", F.lit("?")).alias("trust_path")).agg(F.count("*").alias("n"))


def show_errors(run: DataFrame, mail: DataFrame) -> DataFrame:
    """Wrong verdicts with their sender and subject."""
    return wrong_rows(run).select("id", "kind", "score").join(mail.select("id", "sender", "subject"), "id", "left")


def fixed_sample(mail: DataFrame, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """The n smallest ids of each label: the same rows on every run."""
    d = mail.select("label", "id").distinct()
    d = d.join(excluded, "id", "left_anti") if excluded is not None else d
    return d.withColumn("at", F.row_number().over(W.partitionBy("label").orderBy("id"))).where(F.col("at") <= n).drop("at")


def kept(mail: DataFrame, since: Column | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Mail from a date on; undated mail goes only if there is one."""
    d = mail.where(F.col("sent_on") >= since) if since is not None else mail
    return d.join(excluded, "id", "left_anti") if excluded is not None else d


def ids_in(lines: DataFrame) -> DataFrame:
    """Ids of a text file: one a line, # starts a comment."""
    return lines.select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("id")).where("id != ''").distinct()


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids in both runs whose verdict differs."""
    b, a = before.where("error IS NULL").select("id", F.col("verdict").alias("before")), after.where("error IS NULL").select("id", F.col("verdict").alias("after"))
    return b.join(a, "id").where("before != after")


def enrich(run: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """Fill a column where it is missing, by id."""
    has = column in run.columns
    d = run.join(facts.select("id", F.col(column).alias("_new")), "id", "left")
    return d.withColumn(column, F.coalesce(F.col(column), F.col("_new")) if has else F.col("_new")).drop("_new")


def registration_date(answer: Column) -> Column:
    """The first registration event of a registry's JSON answer, as a date."""
    events = F.from_json(answer, "events array<struct<eventAction:string,eventDate:string>>")["events"]
    first = F.try_element_at(F.filter(events, lambda e: e["eventAction"] == "registration"), F.lit(1))["eventDate"]
    return F.to_date(F.left(first, F.lit(10)))


def domain_age_days(registered: Column, sent: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(sent, registered))


def confusion(reviewed: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of reviewed verdicts ("correct" or "wrong"); a rate without rows is null."""
    ph, ok = F.col("verdict") == "phishing", F.col("label") == "correct"
    d = reviewed.where(F.col("label").isin("correct", "wrong"))
    g = d.groupBy(*keys) if keys else d
    g = g.agg(F.count("*").alias("reviewed"), F.count_if(ph & ok).alias("tp"), F.count_if(ph & ~ok).alias("fp"), F.count_if(~ph & ok).alias("tn"), F.count_if(~ph & ~ok).alias("fn"))
    return g.withColumns({
        "accuracy": F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("reviewed")), "precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "false_positive_rate": F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")),
    })


def export(run: DataFrame) -> DataFrame:
    """The published columns of a run, by id."""
    return run.select("id", "label", "verdict", "score", "lang", "trust_path", "override", "error").orderBy("id")


def latency(requests: DataFrame) -> DataFrame:
    return requests.agg(F.percentile_approx("ms", 0.5).alias("p50"), F.percentile_approx("ms", 0.95).alias("p95"), F.count("*").alias("n"))
