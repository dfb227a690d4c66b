"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written


def _stars(e: DataFrame, n: int) -> DataFrame:
    """A large star, then a small one, of n edges (a, b) with a > b.

    Large: each node's larger neighbours go to its least neighbour. A node of very many neighbours is
    joined by broadcast. Small: each node and its smaller neighbours go to the least of these; edges
    lie by their larger end, which has few.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    larger = join_counted(both.filter("b > a"), least, "a", "n", 2 * n).filter("b <> m")
    large = larger.select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _done(e: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("n"), F.lit(1).alias("m")))
    return ends.groupBy("v").agg(F.sum("n").alias("n"), F.max("m").alias("m")).filter("n > 1 or n = 1 and m = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of edges (a, b) but the smallest of its component, with that smallest node.

    Every round writes its edges to the shared folder. Stars need a number of rounds that grows with
    the logarithm of the longest chain; neighbours of a node are never gathered, only their minimum.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _done(now):
        now = written(_stars(now, now.count()), "edges")
    return now
