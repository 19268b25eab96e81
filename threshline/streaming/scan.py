"""Streams: once-only scanning, expiring results, daily quotas and rates.

Each function takes and returns streaming (or batch) DataFrames; state lives in
Spark's state store, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threshline.operators.ordered import fold_sorted

PER_PASS = 10


def mail_stream(spark: SparkSession, path: str, schema, per_pass: int = PER_PASS, fmt: str = "parquet") -> DataFrame:
    """New files of a folder, a bounded number each pass."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_pass).load(path)


def once_each(stream: DataFrame, key: str, time: str = "ts", keep: str = "1 day") -> DataFrame:
    """Each key once within the watermark's span."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def rate_counts(stream: DataFrame, key: str, time: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests of a key in each window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding_counts(stream: DataFrame, key: str, time: str = "ts", window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, window, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def quota_stream(requests: DataFrame, limit: int, buffer: int) -> DataFrame:
    """All-or-nothing admission of requests (ts, id, n) against a daily budget; a day's use is its state."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        said = []
        for n in rows["n"]:
            ok = used + n <= limit - buffer
            used += n if ok else 0
            said.append(bool(ok))
        state.update((int(used),))
        yield pd.DataFrame({"day": [key[0]] * len(rows), "id": rows["id"], "admitted": said})

    daily = requests.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return daily.groupBy("day").applyInPandasWithState(admit, "day string, id long, admitted boolean", "used long", "append", GroupStateTimeout.NoTimeout)


def remembered(requests: DataFrame, ttl_seconds: Callable[[pd.DataFrame], pd.Series] | int = 86_400) -> DataFrame:
    """(id, key, hit): whether an answer for the key still holds when a request comes; a miss stores it anew."""

    def look(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1.0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        spans = ttl_seconds(rows) if callable(ttl_seconds) else pd.Series([ttl_seconds] * len(rows), index=rows.index)
        hits = []
        for ts, span in zip(rows["ts"], spans, strict=True):
            now = pd.Timestamp(ts).timestamp()
            hits.append(now < until)
            if not hits[-1]:
                until = now + span
        state.update((float(until),))
        yield pd.DataFrame({"id": rows["id"], "key": [key[0]] * len(rows), "hit": hits})

    return requests.groupBy("key").applyInPandasWithState(look, "id long, key string, hit boolean", "until double", "append", GroupStateTimeout.NoTimeout)


def ttl_hits(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """(key, id, hit), the batch form: a request hits if one before it, that itself missed, is younger than the time to live."""

    def step(since: float | None, row: tuple) -> tuple[float, bool]:
        hit = since is not None and row[1] < since + ttl_seconds * 1_000_000
        return (since if hit else row[1]), hit

    rows = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"))
    return fold_sorted(rows, "key", ["at", "id"], lambda: None, step, "hit", "boolean", ["key", "id"])


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table in memory; for tests and catch-up runs."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def scan_into(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score each micro-batch and append it; lists that ``score`` reads are read anew each time."""

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
