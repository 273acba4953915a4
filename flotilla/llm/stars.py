"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import landed


def _least(arcs: DataFrame) -> DataFrame:
    """For each node, the least of it and its neighbours; written out, so that joins with it can split a hot node."""
    return landed(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def _edges(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _are_stars(edges: DataFrame) -> bool:
    """Has every node that isn't the least of its component one edge, to a node that is?"""
    ends = edges.select(F.col("b").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select(F.col("a").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge that isn't a loop.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    Rows may repeat; a null end joins nothing; no edges give no rows.
    """
    now = landed(edges.where(F.col(left) != F.col(right)).select(*_edges(left, right)).distinct(), "edges")
    while not _are_stars(now):
        arcs = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = landed(arcs.join(_least(arcs), "u").where("v > u").select(*_edges("v", "m")).distinct(), "large")
        arcs = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = _least(arcs)
        small = arcs.join(least, "u").select(*_edges("v", "m")).union(least.select(*_edges("u", "m")))
        now = landed(small.where("a <> b").distinct(), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
