"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (pre-aggregated before the shuffle) joined
back to the edges, so neither a node with millions of neighbours nor a large
component ever meets in one task; the number of steps grows with the logarithm
of the longest path, not with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of its neighbourhood."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``: component is the least node
    that can be reached.  Self loops and repeated edges are harmless, nodes
    with a null end are ignored, no edges give no rows.
    """
    now = stash(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct())
    seen = None
    while True:
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (total["n"], total["s"]) == seen or not total["n"]:
            break
        seen = (total["n"], total["s"])
        now = stash(_small_star(_large_star(now).distinct()).distinct(), now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
