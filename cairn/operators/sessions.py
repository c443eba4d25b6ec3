"""Session and cache simulation, clusters and samples.

Positions over a whole table come from written ranges (`numbering`), so that no task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered


def every_kth(rows: DataFrame, key: str, k: int) -> DataFrame:
    return numbered(rows, key).where(F.pmod("_r", F.lit(k)) == 0).drop("_r")


def cache_hits(plays: DataFrame) -> DataFrame:
    """plays (session, pos, cid, size) with hit: whether the session had the address before."""
    w = W.partitionBy("session", "cid").orderBy("pos")
    return plays.withColumn("hit", F.row_number().over(w) > 1)


def session_bytes(plays: DataFrame) -> DataFrame:
    """Bytes of each session without a cache, and with one: first occurrences only."""
    first = plays.groupBy("session", "cid").agg(F.sum("size").alias("naive"), F.min_by("size", "pos").alias("net"))
    return first.groupBy("session").agg(F.sum("naive").alias("naive"), F.sum("net").alias("net"))


def savings_curve(plays: DataFrame) -> DataFrame:
    """Over all sessions, bytes up to each position with and without a cache, and the share saved."""
    w = W.partitionBy("session").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    run = cache_hits(plays).select("pos", F.sum("size").over(w).alias("naive"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("size"))).over(w).alias("net"))
    out = run.groupBy("pos").agg(F.sum("naive").alias("naive"), F.sum("net").alias("net"))
    return out.withColumn("saved", F.round(1 - F.col("net") / F.col("naive"), 6))


def clusters(rows: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).where(F.col("n") >= least)


def affinity_sessions(rows: DataFrame, cluster: str, item: str, length: int) -> DataFrame:
    """cluster, pos and item: members in order, then the next rows in browse order that aren't members, up to length.

    The walk starts after the cluster's last member that plays and goes around the end. Candidates are the next
    rows by place; as many more are taken as the cluster has members, for those may lie among them.
    """
    all_ = numbered(rows, item)
    n = rows.count()
    member = all_.withColumn("_k", F.row_number().over(W.partitionBy(cluster).orderBy(item)) - 1)
    sizes = member.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    playing = member.where(F.col("_k") < length)
    members = playing.select(F.col(cluster).alias("cluster"), F.col("_k").cast("long").alias("pos"), item)
    last = playing.groupBy(cluster).agg(F.max("_r").alias("_from")).join(sizes, cluster).where(F.col("_size") < length)
    # Places are looked up by equality; there are at most `length` plus the cluster's own size of them.
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(length) + F.col("_size"), F.lit(n - 1)))
    if n < 2:
        return members
    walk = last.select(F.col(cluster).alias("cluster"), "_size", F.explode(steps).alias("_step"), "_from").withColumn("_at", (F.col("_from") + F.col("_step")) % n)
    near = walk.join(all_, F.col("_at") == F.col("_r")).where(F.col("cluster") != F.col(cluster))
    near = near.withColumn("pos", F.col("_size") + F.row_number().over(W.partitionBy("cluster").orderBy("_step")) - 1).where(F.col("pos") < length)
    return members.unionByName(near.select("cluster", "pos", item))


def seeds_first(seeds: DataFrame, found: DataFrame, key: str, most: int) -> DataFrame:
    """Seeds, then what was found, each once, up to a number."""
    both = seeds.select(key, F.lit(0).alias("rank_")).union(found.select(key, F.lit(1).alias("rank_")))
    return both.groupBy(key).agg(F.min("rank_").alias("rank_")).orderBy("rank_", key).limit(most)


def shuffled(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """A seeded sample without replacement, in a seeded order."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)


def place_of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The place (from 0) of wanted keys in the order of the keys."""
    return numbered(rows.select(key), key, name="place").join(wanted.select(key), key)
