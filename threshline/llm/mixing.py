"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is hashed into blocks of documents. A source's target gives it
whole passes over its blocks and, for the rest, blocks in a permuted order; the
block at the edge is taken by a fraction of each of its documents. The drawn
block copies are the source's quota. A binary tree splits the quotas exactly
among the output shards: at each node the quota tokens of all sources are
dealt in random order, half to each child, so that the split is
multivariate-hypergeometric and sums are kept. Each shard then gets disjoint
runs of the permuted blocks, and orders its documents locally by a hash.

DataFrame operations only. Windows run over the block table (sources times
``blocks`` times passes), never over documents; the document table is only
scanned, aggregated with partial sums and joined to the small block table.

Cases: a null text has size 0 and takes 0; a null source is a source, last in
order; a null id is an ordinary document; repeated rows count each; an empty
table gives an empty mix; if every text is empty, targets are 0; columns
beyond id, source and text (or size) are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from threshline.llm.common import WORD, materialize

#: Weights by position of the source in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, capped, the excess reshared by weight.

    The fixed point is target = least(cap * size, level * weight); the level is
    the one at which the targets sum to the share of all sizes.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("w"))
    by = W.orderBy("ratio", "k")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    onward = by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    src = src.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(every)["level"]
    return src.withColumn("level", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(sid, slot, shard) from (sid, quota): slots 1..quota of each source, dealt to 2^levels shards by the tree."""
    token = quotas.where("quota > 0").select("sid", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("token"), F.lit(0).alias("node"))
    for level in range(levels):
        draw = W.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "sid", "token"), "sid", "token")
        rank, n = F.row_number().over(draw), F.count("*").over(W.partitionBy("node"))
        token = token.withColumn("right", (rank * 2 > n + 1).cast("int")).select("sid", "token", (F.col("node") * 2 + F.col("right")).alias("node"))
    slot = F.row_number().over(W.partitionBy("sid").orderBy("node", "token"))
    return token.select("sid", slot.alias("slot"), F.col("node").alias("shard"))


def mix_sources(sizes: DataFrame, targets: DataFrame, blocks: int = 64, levels: int = 4, seed: int = 11) -> DataFrame:
    """The rows of ``sizes`` (id, source, size) with source_size, target, taken and ``placements`` (copy, shard, order_key, words).

    ``targets`` is a table of sources. The result does not depend on
    partitioning: all draws are hashes of ids.
    """
    ranked = targets.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    rows = sizes.alias("d").join(ranked.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.sid", "s.source_size", "s.target")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(blocks)))
    block = rows.groupBy("sid", "block").agg(F.sum("size").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = W.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "block"), "block")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    block = block.withColumn("full", full).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rest = F.col("target") - F.col("full") * F.col("source_size") - F.col("before")
    part = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest / F.col("n")))).otherwise(0.0)
    block = block.withColumn("part", part).select("sid", "block", "full", "part")
    copies = F.col("full") + (F.col("part") > 0).cast("int")
    copy = block.select("sid", "block", "full", "part", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))).alias("copy"))
    slot = F.row_number().over(W.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 2), "sid", "block", "copy"), "block", "copy"))
    copy = copy.withColumn("slot", slot)
    quota = copy.groupBy("sid").agg(F.count("*").alias("quota"))
    dealt = copy.join(split_quotas(quota, levels, seed + 3), ["sid", "slot"])
    plan = dealt.groupBy("sid", "block").agg(F.first("full").alias("full"), F.first("part").alias("part"), F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("copies"))
    plan = materialize(plan, "mix-plan")
    unit = F.pmod(F.xxhash64(F.lit(seed + 4), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    edge = F.when(F.col("part") >= 1, F.col("size")).otherwise(F.least("size", F.floor(F.col("size") * F.col("part") + unit))).cast("long")
    out = rows.join(plan, ["sid", "block"], "left").withColumn("edge", edge)
    placed = F.transform(
        "copies",
        lambda c: F.struct(c["copy"].alias("copy"), c["shard"].alias("shard"), F.xxhash64(F.lit(seed + 5), c["shard"], c["copy"], F.col("id")).alias("order_key"), F.when(c["copy"] < F.col("full"), F.col("size")).otherwise(F.col("edge")).alias("words")),
    )
    taken = F.coalesce(F.col("full") * F.col("size") + F.when(F.col("part") > 0, F.col("edge")).otherwise(0), F.lit(0)).cast("long")
    return out.select(*sizes.columns, "source_size", "target", taken.alias("taken"), F.filter(F.coalesce(placed, F.array().cast("array<struct<copy:int,shard:int,order_key:bigint,words:bigint>>")), lambda p: p["words"] > 0).alias("placements"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """Size the documents (one scan, written once) and mix them to the default targets."""
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes), "mix-targets")
    return mix_sources(sizes, targets, **options)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "placements")

