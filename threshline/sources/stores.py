"""Tables that services keep: result rows by id, feeds, and keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.functions import urls


def last_by_id(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The last row of each id."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, the last of each id; later files and lines win."""
    d = spark.read.schema(schema).json(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return last_by_id(d, "_at").drop("_at")


def load_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A feed of verified addresses (JSON array, gzip or not) as its (url) and (host) tables."""
    d = spark.read.option("multiLine", "true").schema("url string").json(path).where("url IS NOT NULL")
    feed = d.select(F.trim("url").alias("url")).distinct()
    return feed, feed.select(urls.link_host(F.col("url")).alias("host")).where("host != ''").distinct()


def upsert(cache: DataFrame, fresh: DataFrame, key: str = "url", order: str = "stored_at") -> DataFrame:
    """The cache with fresh rows over old ones."""
    return last_by_id(cache.unionByName(fresh), order, key)


def answer_key(*fields: Column) -> Column:
    """A request's key: the hash of its fields as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, through Spark's own file systems; 0 where it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
