"""Shared folder, written intermediate tables and connected components.

Lineage is cut with Parquet tables in the folder that ``spark.checkpoint.dir``
names (all executors and the driver share it), never with local checkpoints.
The tables are deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(spark: SparkSession, path: str) -> None:
    if re.match(r"(?:file:)?/", path):
        shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)
        return
    try:
        drop_path(spark, path)
    except Exception:  # the session, and with it the way to that store, ended first
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/threshline/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_end, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


_SMALLER, _LARGER = zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()


def pack(text: str) -> bytes:
    """A text's bytes, compressed for a shuffle."""
    return _SMALLER.compress(text.encode("utf-8", "surrogatepass"))


def unpack_bytes(data: bytes) -> bytes:
    return _LARGER.decompress(data)


def unpack(data: bytes) -> str:
    return unpack_bytes(data).decode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def blocks(xs: Column) -> Column:
    """An array cut into about as many blocks as each has elements."""

    def cut(own: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own))).cast("int"))
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(own, at, width))

    return let(xs, cut)


def running_sums(xs: Column) -> Column:
    """For each of the longs the sum of those before it; by blocks, so that cost grows with m times the root of m."""
    total = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(parts: Column) -> Column:
        def within(totals: Column) -> Column:
            def each(block: Column, k: Column) -> Column:
                return let(total(F.slice(totals, 1, k)), lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, 1, i))))

            return F.flatten(F.transform(parts, each))

        return let(F.transform(parts, total), within)

    return let(blocks(xs), of)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: long) as (u, root), root being the smallest node.

    Alternating large-star and small-star rounds: each is one aggregation and
    one join, and their number is logarithmic in the longest chain. Each round
    is written to the shared folder; nothing but a count and a checksum comes to
    the driver. Nodes without edges, and the roots themselves, have no row.
    """
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least).distinct()
        was, now = now, materialize(small, "edges")
        release(was)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))
