"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is an aggregate with partial sums and a join whose skewed keys can be split, so a hub with
any number of edges stays distributed. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = both.where("b > a") if large else both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = sides.join(least, "a")
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.where("m < a").select("a", F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre, and no centre on anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs")))
    found = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    return found.where("hangs > 1 or hangs = 1 and least = 0").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node of each component) for every node that has an edge, as a stashed table.

    ``edges`` has the columns ``a`` and ``b`` of one numeric type; loops and repeats do no harm.
    """
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star(now):
        new = stash(_star(_star(now, True), False), "edges")
        unstash(now)
        now = new
    out = stash(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    unstash(now)
    return out
