"""Connected components of an edge table by alternating large and small stars. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Links each node's neighbours (large: those above it; small: those below) to its smallest one."""
    if large:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        up = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
        out = up.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (two columns of one orderable type); component is its smallest node.

    Nodes without an edge to another don't appear. Nulls, loops and repeated edges are dropped. Each round is
    written to the shared folder; minima are combined before they move, and joins on a hub are split by AQE.
    An edge count and a hash sum that no longer change end the rounds; only these two numbers reach the driver.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull()).filter("u > v").distinct())
    mark = None
    for _ in range(max_rounds):
        now = materialise(_star(_star(now, large=True), large=False))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = seen
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
