"""Spans of bytes or positions: merging, complements, greedy selection, prefix sums."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import KEY_ROWS, running


def merge_spans(spans: DataFrame, by: str, end: str | None = None) -> DataFrame:
    """Spans (start, stop) of each key joined where they overlap or touch, held within [0, end], empty ones dropped."""
    lo, hi = F.greatest(F.col("start"), F.lit(0)), F.col("stop") if end is None else F.least(F.col("stop"), F.col(end))
    held = spans.select(by, lo.alias("start"), hi.alias("stop")).where("stop > start")
    w = W.partitionBy(by).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.coalesce(F.col("_before"), F.lit(-1)), 1).otherwise(0)).over(w)
    return held.withColumn("_before", before).withColumn("_island", island).groupBy(by, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def complement(merged: DataFrame, files: DataFrame, by: str, size: str) -> DataFrame:
    """What the merged spans of each file leave, in order, with the gap that follows: start, stop, zeros."""
    rows = merged.unionByName(files.select(by, F.col(size).alias("start"), F.col(size).alias("stop")))
    left = rows.withColumn("_from", F.coalesce(F.lag("stop").over(W.partitionBy(by).orderBy("start", "stop")), F.lit(0)))
    return left.select(by, F.col("_from").alias("start"), F.col("start").alias("stop"), (F.col("stop") - F.col("start")).alias("zeros")).where("stop > start OR zeros > 0")


def greedy(spans: DataFrame, by: str) -> DataFrame:
    """Spans that start at or after the end of the last one kept, in order of start, then stop.

    What is kept depends on what was kept: Spark deals and sorts the spans by key, and a task reads them as a stream
    that remembers one end.
    """
    kind = spans.schema[by].dataType.simpleString()
    typed = spans.select(by, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))

    def keep(batches):
        key, end = object(), 0
        for batch in batches:
            mask = []
            for k, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    key, end = k, 0
                taken = start is not None and start >= end
                if taken:
                    end = start if stop is None else stop  # a span without end takes no room
                mask.append(taken)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return typed.repartition(by).sortWithinPartitions(by, "start", "stop").mapInArrow(keep, f"{by} {kind}, start long, stop long")


def prefix_offsets(rows: DataFrame, by: str, order: list[str], size: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """Where each piece starts when pieces lie one after the other."""
    return running(rows, [by], order, {"offset": ("sum", F.col(size))}, before=True, key_rows=key_rows).withColumn("offset", F.coalesce("offset", F.lit(0)))


def sequential_runs(reads: DataFrame, by: str, order: list[str]) -> DataFrame:
    """reads (first, last) with whether each goes on from the one before, and its run."""
    w = W.partitionBy(by).orderBy(*order)
    on = F.coalesce(F.col("first") <= F.lag("last").over(w) + 1, F.lit(False))
    return reads.withColumn("sequential", on).withColumn("run", F.sum(F.when(F.col("sequential"), 0).otherwise(1)).over(w))
