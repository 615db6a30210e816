"""Connected components of an edge table by alternating large-star and small-star steps, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Each node sends its larger (large) or smaller (small) neighbours, and itself, to the least node among them and itself.

    The least is an aggregate with map-side combining, joined back, so that a hub's edges may be split over tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that has an edge and is not the least of its component; edges (u, v) in any order, repeats and loops allowed."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # One edge from each node, none of whose targets has one itself: stars already.
        if seen[0] == seen[2] and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return now.withColumnRenamed("v", "root")
        if state == seen:
            return now.withColumnRenamed("v", "root")
        state = seen
        now = materialise(_star(_star(now, True), False), "edges")
