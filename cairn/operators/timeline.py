"""As-of lookups, checkpoints and playback timelines.

A key's rows (module, channel) are a timeline of its own; lookups and running values go along it by `scans.running`,
which cuts a timeline of very many rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import KEY_ROWS, running


def asof(points: DataFrame, facts: DataFrame, by: str, at: str, on: str, values: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """Each point with the values of its key's latest fact at or before it (null if there is none).

    Both sides go through one shuffle by key and one sort; of facts at one place the last by value counts.
    """
    fact = facts.select(F.col(by).alias("_by"), F.col(on).cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_p"))
    point = points.select(F.col(by).alias("_by"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(facts.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.struct("*").alias("_p"))
    both = running(fact.unionByName(point), ["_by"], ["_at", "_side", "_v"], {"_found": ("last", F.col("_v"))}, key_rows=key_rows).where("_side = 1")
    return both.select("_p.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def checkpoint_sets(triggers: DataFrame) -> DataFrame:
    """module, order and the sorted distinct samples; triggers has module, order, sample."""
    return triggers.groupBy("module", "order").agg(F.array_sort(F.collect_set("sample")).alias("samples"))


def indexed(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints with their place (from 0), the place of the last, and the next one's samples."""
    w = W.partitionBy("module").orderBy("order")
    return checkpoints.withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead("samples").over(w)).withColumn("prev_order", F.lag("order").over(w))


def required_at(points: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """points (module, x, ...) with what must be there at x: the samples of the floor checkpoint and the next.

    Before the first checkpoint it is the first one's; a module without checkpoints needs nothing.
    """
    c = indexed(checkpoints).select("module", "order", F.array_sort(F.array_union("samples", F.coalesce("next", F.array().cast("array<long>")))).alias("need"))
    first = checkpoints.groupBy("module").agg(F.min_by("samples", "order").alias("_first"))
    found = asof(points, c, "module", "x", "order", ["need"]).join(first, "module", "left")
    return found.withColumn("need", F.coalesce("need", F.array_sort("_first"), F.array().cast("array<long>"))).drop("_first")


def playable_seconds(checkpoints: DataFrame, resident: DataFrame, starts: DataFrame, durations: DataFrame) -> DataFrame:
    """Seconds up to which each module plays: the start of its first checkpoint whose samples (with the next's) aren't all there."""
    c = indexed(checkpoints).select("module", "order", F.array_union("samples", F.coalesce("next", F.array().cast("array<long>"))).alias("need"))
    have = resident.groupBy("module").agg(F.collect_set("sample").alias("have"))
    fails = c.join(have, "module", "left").where(F.size(F.array_except("need", F.coalesce("have", F.array().cast("array<long>")))) > 0)
    bad = fails.groupBy("module").agg(F.min("order").alias("x"))
    at = asof(bad, starts, "module", "x", "order", ["seconds"]).select("module", F.coalesce("seconds", F.lit(0.0)).alias("edge"))
    return durations.join(at, "module", "left").select("module", F.coalesce("edge", "duration").alias("seconds"))


def strided(rows: DataFrame, by: str, order: list[str], most: int = 512) -> DataFrame:
    """Every s-th row of a key so that about `most` stay."""
    w = W.partitionBy(by)
    stride = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) / most))
    return rows.withColumn("_s", stride).withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).where("_n % _s = 0").drop("_s", "_n")


def order_seconds(rows: DataFrame, speed: int = 6, tempo: int = 125, pattern_rows: int = 64, key_rows: int = KEY_ROWS) -> DataFrame:
    """rows (module, order, speed, tempo; null: as before) with the seconds at which each order starts."""
    sets = rows.select("module", "order", F.col("speed").alias("_s"), F.col("tempo").alias("_t"))
    carried = running(sets, ["module"], ["order"], {"speed": ("last", F.col("_s")), "tempo": ("last", F.col("_t"))}, key_rows=key_rows)
    carried = carried.select("module", "order", F.coalesce("speed", F.lit(speed)).alias("speed"), F.coalesce("tempo", F.lit(tempo)).alias("tempo"))
    length = F.col("speed") * 2.5 / F.col("tempo") * pattern_rows
    return running(carried, ["module"], ["order"], {"seconds": ("sum", length)}, before=True, key_rows=key_rows).withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def latch_forward(rows: DataFrame, by: str, order: list[str], value: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """The last value that isn't null, up to each row of a key."""
    return running(rows, [by], order, {"latched": ("last", F.col(value))}, key_rows=key_rows)


def held_notes(events: DataFrame, before: Column) -> DataFrame:
    """Channels that still hold a note: the last event before a place is a note. events has channel, at, note (null: off)."""
    last = events.where(F.col("at") < before).groupBy("channel").agg(F.max_by(F.struct("note", "at"), F.struct("at", "seq")).alias("e"))
    return last.where(F.col("e.note").isNotNull()).select("channel", "e.note", "e.at")


def need_key(orders: Column, playhead: Column) -> Column:
    """How soon a sample is needed: distance to its next order, far off once all have passed, last of all without any."""
    ahead = F.array_min(F.filter(orders, lambda o: o >= playhead)) - playhead
    passed = F.lit(1_000_000_000) + playhead - F.array_max(orders)
    return F.coalesce(ahead, passed, F.lit((1 << 63) - 1)).cast("long")


def orders_for_slot(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("module", "order", F.explode("samples").alias("slot")).groupBy("module", "slot").agg(F.array_sort(F.collect_set("order")).alias("orders"))


def stream_order(slots: DataFrame, checkpoints: DataFrame, playhead: Column) -> DataFrame:
    """Slots in the order of delivery: those required at the start, then by need, ties by slot."""
    start = required_at(slots.select("module", F.lit(0).alias("x")).distinct(), checkpoints).select("module", "need")
    rows = slots.join(orders_for_slot(checkpoints), ["module", "slot"], "left").join(start, "module", "left")
    key = F.when(F.array_contains("need", F.col("slot")), F.lit(-1).cast("long")).otherwise(need_key(F.col("orders"), playhead))
    rows = rows.withColumn("need_key", key)
    return rows.select("module", "slot", "need_key", F.row_number().over(W.partitionBy("module").orderBy("need_key", "slot")).alias("place"))


def deliveries(slots: DataFrame, checkpoints: DataFrame, playhead: Column) -> DataFrame:
    """module, place, kind and slot of what a player is sent: the skeleton, its samples in the order of delivery, and the end."""
    ordered = stream_order(slots, checkpoints, playhead).select("module", F.col("place").cast("long").alias("place"), F.lit("sample").alias("kind"), "slot")
    ends = ordered.groupBy("module").agg(F.max("place").alias("last"))
    none = F.lit(None).cast(ordered.schema["slot"].dataType).alias("slot")
    first = ends.select("module", F.lit(0).cast("long").alias("place"), F.lit("skeleton").alias("kind"), none)
    return first.unionByName(ordered).unionByName(ends.select("module", (F.col("last") + 1).alias("place"), F.lit("complete").alias("kind"), none))
