"""Connected components of a graph of 64-bit nodes.

Alternating stars: every node hands its larger, then its smaller neighbours to the
least node it knows, until nothing changes. Each pass is an aggregation, combined
before the shuffle, and a join back, so a node with very many neighbours is never
gathered; each pass's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlight.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes of (u, v)."""
    now = settle(edges.filter("u <> v").select("u", "v").distinct())
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        now = settle(_small_star(_large_star(now)))
    # Now every edge leads from a node to its root.
    ends = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum, by which two sets of edges are compared."""
    mark = F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).filter("u <> v").distinct()
