"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _are_stars(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end, which is no upper end itself."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up")).unionByName(edges.select(F.col("lo").alias("u"), F.lit(0).alias("up")))
    seen = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that isn't its component's smallest node.

    Each round links the neighbours of a node to the smallest node around it, first those above the node, then those
    below; the edges end as stars around the smallest nodes after few rounds, whatever the shape. Minima are summed up
    before the shuffle and joined back by node, so that Spark can split a hub's edges. Each round is written to the
    shared folder, in place of the one before. Self-loops and null ends count for nothing.
    """
    some = edges.where(F.col("a") != F.col("b"))
    kept = Tables()
    now = kept.keep(some.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _are_stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        new = Tables()
        now = new.keep(small.where("hi != lo").distinct(), "edges")
        kept.release()
        kept = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
