"""Connected components of a link table by alternating large-star and small-star steps.

Every round is two aggregations and joins, staged in the shared folder; the number of rounds grows with the
logarithm of the number of nodes. The least neighbours are staged before they are joined, so the links of a hub are
read as they lie (or split as a skewed key) and never meet in one task. No link or label comes to the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Links each node's larger (large) or smaller neighbours and itself to their least one."""
    a, b = F.col("a"), F.col("b")
    near = links.unionByName(links.select(b.alias("a"), a.alias("b"))) if large else links
    least = stage(near.groupBy("a").agg(F.min(F.least("a", "b")).alias("least")), "components-least")
    moved = near.join(small(least), "a")
    if large:
        out = moved.where(b > a).select(b.alias("a"), F.col("least").alias("b"))
    else:
        out = moved.select(b.alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: two columns a, b of one orderable type. Returns (node, root): every linked node and the least node it reaches.

    Self-links, repeated links and nulls are ignored; no links give an empty result.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stage(ordered, name), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b", "b").distinct().toDF("node", "root"))
        seen = mark
        now = stage(_star(_star(now, large=True), large=False), name)
