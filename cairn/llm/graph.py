"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations and joins over the edges; nothing comes to the driver but whether any node
doesn't point to its root yet. The rounds needed grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low.select("a", F.col("low").alias("b"))).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node points to a root, and to one only; a root points nowhere."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out")))).alias("e"))
    node = ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.count(F.lit(1)).alias("all"))
    return node.where((F.col("out") > 1) | (F.col("out") == 1) & (F.col("all") > 1)).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of the edges (a, b); loops and repeats don't matter, a null end makes no edge."""
    work = Work(edges.sparkSession, "components")
    edges = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_done(edges):
        edges = work.write(_small(_large(edges)), "edges", drop=["edges"])
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
