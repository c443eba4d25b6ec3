"""Bake plans: which samples stream, and whether that pays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes that streaming must save at least.
GATE = 131072


def match_dumps(slots: DataFrame, dumps: DataFrame) -> DataFrame:
    """Slots whose decoded dump is there, isn't empty and has the slot's length."""
    return slots.join(dumps.select("module", "slot", F.col("length").alias("_dump")), ["module", "slot"]).where((F.col("_dump") > 0) & (F.col("_dump") == F.col("length"))).drop("_dump")


def slots_of_offsets(offsets: DataFrame, slots: DataFrame) -> DataFrame:
    """module, offset and slot: of slots with one offset the last counts; offsets of no slot are dropped."""
    last = slots.groupBy("module", "offset").agg(F.max("slot").alias("slot"))
    return offsets.join(last, ["module", "offset"])


def covered(slots: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Slots that may stream: raw ones, and compressed ones that some checkpoint needs."""
    needed = checkpoints.select("module", F.explode("samples").alias("slot")).distinct().withColumn("_need", F.lit(True))
    return slots.join(needed, ["module", "slot"], "left").where(~F.col("compressed") | F.coalesce("_need", F.lit(False))).drop("_need")


def prune(checkpoints: DataFrame, streamed: DataFrame) -> DataFrame:
    """Checkpoints with streamed samples only; those left without any go."""
    have = streamed.groupBy("module").agg(F.collect_set("slot").alias("_have"))
    out = checkpoints.join(have, "module").withColumn("samples", F.array_sort(F.array_intersect("samples", "_have")))
    return out.where(F.size("samples") > 0).drop("_have")


def saving_gate(modules: DataFrame, gate: int = GATE) -> DataFrame:
    """modules (size, warm, compressed) with whether compressed samples must stay resident after all."""
    return modules.withColumn("resident", (F.col("size") - F.col("warm") < gate) & F.col("compressed"))


def global_slots(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Slots numbered over all groups of a module, from 1."""
    return rows.withColumn("slot", F.row_number().over(W.partitionBy(by).orderBy(*order)))
