"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.session import materialize

#: Fewer edges than this are kept in one partition, as adaptive execution would merge them, but without the shuffle before it.
SMALL = 100_000


def _together(df: DataFrame, small: bool) -> DataFrame:
    """``df`` in one partition where that is small, else as it is."""
    return df.coalesce(1) if small else df


def _star(edges: DataFrame, small: bool = False) -> DataFrame:
    """Each node ``u`` of ``edges`` (u, v) with its neighbours and the least of them and itself, ``m``."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    found = _together(edges.join(least, F.col("u") == F.col("node")), small)
    return found.select("u", "v", F.least("u", "least").alias("m"))


def large_star(edges: DataFrame, small: bool = False) -> DataFrame:
    """Larger neighbours of each node move to its least neighbour."""
    both = _together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), small)
    return _star(both, small).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, small: bool = False) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. ``edges`` go from larger to smaller."""
    star = _star(edges, small)
    moved = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))
    return _together(moved.filter("u <> v"), small).distinct()


def _are_stars(edges: DataFrame, small: bool = False) -> bool:
    """Whether every node has one smaller neighbour, or is one: then nothing moves any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = _together(ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))), small)
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return sums.filter("up > 1 or up = 1 and root = 1").isEmpty()


def components(edges: DataFrame, label: str = "star") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for each node of the undirected ``edges`` (a, b) of longs.

    Null ends and loops are left out; nodes without an edge have no row. Each round is stored, so that a lost
    executor costs no more than a round; the rounds end when only stars are left. A node with very
    many neighbours is aggregated before it is shuffled, and its join is split. A round adds no edges, so a small graph
    stays small: its rounds are a task each, without a shuffle.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    small = now.count() < SMALL
    now = _together(now, small)
    while True:
        now = _together(materialize(small_star(large_star(now, small), small), label), small)
        if _are_stars(now, small):
            break
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return _together(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least), small)
