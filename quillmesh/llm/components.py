"""Connected components by alternating star contractions, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.join(least, "a").where(F.col("b") > F.col("a"))
    return out.select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and the neighbours below it are tied to the least of them; edges run from small to large."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    ties = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return ties.union(own).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b), a < b: rows (root, node) for every node that is not its component's least.

    Node groups of any size spread: neighbours meet in partial minima and in joins that Spark can split.
    A round exchanges two numbers with the driver; when they repeat, every node hangs on its root.
    """
    now, mark = stored(edges.select("a", "b").distinct()), None
    while True:
        after = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if after == mark or not after[0]:
            return now.select(F.col("a").alias("root"), F.col("b").alias("node"))
        mark = after
        now = stored(_small_star(_large_star(now)))
