import pandas as pd
import pytest
from pyspark.sql import functions as F

from threshline.operators import reputation
from threshline.streaming import scan


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("events")
    for part in range(3):
        rows = [(i + part * 40, f"k{i % 7}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=9 * (i + part * 40)), 1 + i % 3) for i in range(40)]
        pd.DataFrame(rows, columns=["id", "key", "ts", "n"]).to_parquet(out / f"p{part}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(out)


SCHEMA = "id long, key string, ts timestamp, n long"


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder)


def test_once_each(spark, folder, tmp_path):
    s = scan.once_each(scan.mail_stream(spark, folder, SCHEMA), "key", keep="3 days")
    assert sorted(r.key for r in scan.run_available(s, "once", str(tmp_path / "c")).collect()) == [f"k{i}" for i in range(7)]


def test_rates_equal_the_batch(spark, folder, tmp_path):
    s = scan.rate_counts(scan.mail_stream(spark, folder, SCHEMA), "key", window="1 hour", late="0 seconds")
    got = {(r.start, r.key): r.n for r in scan.run_available(s, "rates", str(tmp_path / "c"), "update").collect()}
    want = batch(spark, folder).groupBy(F.window("ts", "1 hour").start.alias("start"), "key").count().collect()
    assert got == {(r.start, r.key): r["count"] for r in want}


def test_quota_equals_the_batch(spark, folder, tmp_path):
    s = scan.quota_stream(scan.mail_stream(spark, folder, SCHEMA, per_pass=10), 60, 10)
    got = {r.id: r.admitted for r in scan.run_available(s, "quota", str(tmp_path / "c")).collect()}
    assert got == {r.id: r.admitted for r in reputation.admit_quota(batch(spark, folder), 60, 10).collect()}


def test_remembered_equals_the_batch(spark, folder, tmp_path):
    s = scan.remembered(scan.mail_stream(spark, folder, SCHEMA), 7200)
    got = {r.id: r.hit for r in scan.run_available(s, "seen", str(tmp_path / "c")).collect()}
    want = {r.id: r.hit for r in scan.ttl_hits(batch(spark, folder), 7200).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_scores_are_appended_once(spark, folder, tmp_path):
    score = lambda d: d.select("id", (F.col("n") > 1).alias("bad"))
    for _ in range(2):
        scan.scan_into(scan.mail_stream(spark, folder, SCHEMA), score, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
