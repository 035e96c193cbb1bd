"""Retrieval quality, reports and operational figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import bounded


def fraction(gold: Column, got: Column) -> Column:
    """Share of gold that was got; 1 without gold. Repeated gold counts as often as it is there."""
    hit = F.size(F.filter(gold, lambda g: F.array_contains(got, g)))
    return F.when(F.size(gold) == 0, F.lit(1.0)).otherwise(hit / F.size(gold))


def any_hit(gold: Column, got: Column) -> Column:
    return F.when(F.arrays_overlap(gold, got), 1.0).otherwise(0.0)


def text_recall(gold: Column, got: Column) -> Column:
    """Share of gold texts that contain, or are contained in, a text that was got (trimmed, lower case)."""
    bare = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    hit = F.size(F.filter(bare(gold), lambda g: F.exists(bare(got), lambda r: F.contains(g, r) | F.contains(r, g))))
    return F.when(F.size(gold) == 0, F.lit(1.0)).otherwise(hit / F.size(gold))


def first_sessions(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, sessions): the first k different sessions of ranked hits (query_id, session, rank)."""
    first = hits.groupBy("query_id", "session").agg(F.min("rank").alias("rank"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "session"))).where(F.col("nth") <= k)
    return first.groupBy("query_id").agg(F.array_sort(F.collect_list("session")).alias("sessions"))


def family_rates(outcomes: DataFrame) -> DataFrame:
    """Pass rates by family. outcomes: family, expected, found, forbidden (arrays)."""
    ok = F.when(F.col("family") == "negative", F.size("found") == 0).when(F.col("family") == "acl", ~F.arrays_overlap("found", "forbidden")).otherwise(F.arrays_overlap("found", "expected"))
    return outcomes.withColumn("ok", ok).groupBy("family").agg(F.count(F.lit(1)).alias("asked"), F.count_if("ok").alias("passed"))


#: Parts into which a group is cut before exact quantiles are taken.
PARTS = 64


def latency(rows: DataFrame, ms: str, *keys: str) -> DataFrame:
    """Mean, quantiles (element floor(q * (n - 1)) of the sorted values) and maximum of each group.

    Approximate cut points split a group into `PARTS` parts, counts say in which part a quantile lies and at which place, and
    only those parts are sorted. So quantiles are exact and no task sorts a whole group.
    """
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = rows.select(*keys, ms, F.to_json(F.struct(*keys)).alias("group"))  # null keys are a group too
    known = rows.where(F.col(ms).isNotNull())
    shares = F.array(*(F.lit(k / PARTS) for k in range(1, PARTS)))
    cuts = known.groupBy("group").agg(F.percentile_approx(ms, shares, 4 * PARTS).alias("cuts"))  # one short row a group
    part = F.size(F.filter("cuts", lambda c: c < F.col(ms)))
    placed = known.select("group", ms).join(bounded(cuts), "group").withColumn("part", part).drop("cuts")
    counts = placed.groupBy("group", "part").count()
    group = Window.partitionBy("group")
    before = F.coalesce(F.sum("count").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).withColumn("n", F.sum("count").over(group))
    at = F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.lit(q) * (F.col("n") - 1)).alias("place")) for name, q in wanted.items()))
    here = counts.withColumn("w", F.explode(at)).where((F.col("w.place") >= F.col("before")) & (F.col("w.place") < F.col("before") + F.col("count")))
    here = here.groupBy("group", "part", "before").agg(F.collect_list("w").alias("w"))  # three at most a group
    nth = F.row_number().over(Window.partitionBy("group", "part").orderBy(ms)) - 1
    picked = placed.join(bounded(here), ["group", "part"]).withColumn("place", F.col("before") + nth).withColumn("w", F.explode("w")).where("place = w.place")
    quantiles = picked.groupBy("group").agg(*(F.max(F.when(F.col("w.name") == name, F.col(ms))).alias(name) for name in wanted))
    return rows.groupBy("group", *keys).agg(F.round(F.avg(ms), 6).alias("mean"), F.max(ms).alias("max")).join(quantiles, "group", "left").select(*keys, "mean", *wanted, "max")


def report(rows: DataFrame, metric: str, variant: str, category: str) -> DataFrame:
    """Mean of a metric by variant and by (variant, category); the category is null in totals."""
    return rows.rollup(variant, category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(metric), 6).alias("mean"), F.grouping(variant).alias("g")).where("g = 0").drop("g")


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type").pivot("status", ["pending", "running", "done", "dead"]).count().na.fill(0)


def retry_at(attempts: Column, failed_at: Column, limit: int = 5) -> Column:
    """When a failed job runs again; null once it is dead."""
    wait = F.least(F.pow(F.lit(2.0), attempts + 1), F.lit(300.0))
    return F.when(attempts + 1 < limit, failed_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)")))


def hit_split(results: DataFrame) -> DataFrame:
    """Score figures of hits and misses (score, is_hit)."""
    return results.groupBy("is_hit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
