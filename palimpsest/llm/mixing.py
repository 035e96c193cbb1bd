"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by weight, but at most `cap` times its own words; what a capped
source leaves is shared again by weight (water-filling). Within a source every document expects
target / source_size copies. Documents are laid out by size, the prefix sum of expected copies is taken
along that order, one random offset is added for each source, and a document is emitted once for each
integer boundary that its interval crosses. Laying out by size keeps the words taken within about one
document of the target.

Ranks within a source come from one range shuffle of (source, size, tie) and offsets of its partitions,
so a source with a third of all rows is spread over many tasks.

Defined results: null or empty text has size 0 and still takes part (its copies count no words); a null
source is a source of its own; repeated rows and repeated ids are rows of their own; an empty table gives
an empty result; further columns of the input are ignored by `plan_mix` and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small, stage, words

WEIGHTS = (5, 2, 1)
CAP = 3


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: one row (source, source_size) a source. Adds target: the source's share of all sizes.

    The windows without a partition run over one row a source, after aggregation.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_cap = Window.orderBy("at_cap", F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("at_cap", F.col("source_size") * cap / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(by_cap))
    fits = F.when(F.col("level") <= F.col("at_cap"), F.struct("place", "level"))
    rows = rows.withColumn("first", F.min(fits).over(everything))
    target = F.when(F.col("place") < F.col("first.place"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for each source and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_mix(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """key, size, source_size, target, copies and taken for every row of docs (columns key, text, source)."""
    n = partitions(docs.sparkSession)
    tie = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    sized = stage(docs.select(F.col(key).alias("key"), "source", text_size(F.col("text")).alias("size"), tie.alias("tie")), "mix-sizes")
    laid = sized.repartitionByRange(n, F.col("source").asc_nulls_last(), "size", "tie", "key")
    laid = stage(laid.withColumn("part", F.spark_partition_id()), "mix-ranges")

    parts = laid.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    parts = small(stage(parts.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source"), "mix-targets"))

    inside = Window.partitionBy("part", "source").orderBy("size", "tie", "key")
    ranked = laid.withColumn("nth", F.row_number().over(inside))
    ranked = ranked.join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rank, rate = (F.col("nth") + F.col("ahead")).cast("double"), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    start = offset(F.col("source"), seed)
    crossed = F.floor(start + rank * rate) - F.floor(start + (rank - 1) * rate)
    ranked = ranked.withColumn("copies", F.least(crossed, F.lit(cap)).cast("long"))
    return ranked.select(F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """The mixed documents: every row of docs as often as the plan says, columns unchanged.

    A row is known by its key and a hash of all its columns, so what is taken depends on the rows alone, not on how they lie in
    files; of rows that are equal in every column, the copies of all are taken of one.
    """
    columns = docs.columns
    row = F.concat_ws("/", F.col(key).cast("string"), F.xxhash64(*columns).cast("string"))
    kept = stage(docs.withColumn("__row", row), "mix-rows")
    copies = plan_mix(kept, "__row", weights, cap, seed).groupBy(F.col("__row").alias("__taken")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__equal"))
    copies = stage(copies.where("__copies > 0"), "mix-plan")
    once = small(copies.where("__equal = 1").drop("__equal"))
    several = small(copies.where("__equal > 1").drop("__equal"))
    same = F.col("__row") == F.col("__taken")
    out = kept.join(once, same).unionByName(kept.join(several, same).dropDuplicates(["__row"]))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*columns)
