"""Seek tables from pattern events: when each order starts, and which samples a start there needs.

One pass of windows for each module's timeline; nothing is replayed for each checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Checkpoints of a module, at most.
CHECKPOINTS = 512


def order_starts(events: DataFrame, key: str = "source") -> DataFrame:
    """key, place, order and seconds. Speed and tempo count from their row on, for all that follows."""
    places = events.select(key, "place", "order", "rows", "speed0", "tempo0").distinct()
    grid = places.where("rows > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    sets = events.where("row IS NOT NULL").groupBy(key, "place", "row").agg(last("speed"), last("tempo"))
    w = W.partitionBy(key).orderBy("place", "row").rowsBetween(W.unboundedPreceding, 0)
    rows = grid.join(sets, [key, "place", "row"], "left")
    speed, tempo = (F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"{c}0")) for c in ("speed", "tempo"))
    length = rows.withColumn("_s", speed * 2.5 / tempo).groupBy(key, "place").agg(F.sum("_s").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return places.join(length, [key, "place"], "left").select(key, "place", "order", before.alias("seconds"))


def triggers(events: DataFrame, key: str = "source") -> DataFrame:
    """Events that start or end a note, with the sample: the named one or the channel's last."""
    w = W.partitionBy(key, "channel").orderBy("place", "row", "seq").rowsBetween(W.unboundedPreceding, 0)
    latched = events.where("channel IS NOT NULL").withColumn("sample", F.last("sample", ignorenulls=True).over(w))
    return latched.where(F.col("off") | (F.col("note") & F.col("sample").isNotNull())).select(key, "place", "row", "seq", "channel", "sample", "off")


def checkpoints(events: DataFrame, offsets: DataFrame, key: str = "source", most: int = CHECKPOINTS) -> DataFrame:
    """key, order and the sorted offsets that must be there to start at that order and play to the next checkpoint.

    offsets has key, sample (from 0) and offset. A note held on a channel from before counts as well as all that start within.
    """
    of_key = W.partitionBy(key)
    in_channel = W.partitionBy(key, "channel").orderBy("place", "row", "seq")
    # All windows and groups are of the key's rows: they are dealt by key once, and no step joins them with one another.
    rows = events.withColumn("_sample", F.last("sample", ignorenulls=True).over(in_channel.rowsBetween(W.unboundedPreceding, 0)))
    in_order = of_key.orderBy("place", "order")
    places, end = F.max("_n").over(of_key), F.max("place").over(of_key)
    rows = rows.withColumn("_n", F.dense_rank().over(in_order)).withColumns({"_places": places, "_end": end})
    stride = F.greatest(F.lit(1), F.ceil(F.col("_places") / most)).cast("int")
    act = F.coalesce(F.col("channel").isNotNull() & (F.col("off") | (F.col("note") & F.col("_sample").isNotNull())), F.lit(False))
    at = F.floor(F.col("place") / F.col("_stride"))
    rows = rows.withColumn("_stride", stride).select(
        key, "place", "row", "seq", "_stride", "_end", at.alias("_i"), act.alias("_act"), F.when(act, F.col("channel")).alias("channel"), F.when(act & ~F.col("off"), F.col("_sample")).alias("_sample"),
        F.when(F.col("place") % F.col("_stride") == 0, F.col("order")).alias("_order"),
    ).where(F.col("_act") | F.col("_order").isNotNull())
    # The last act of each channel in each span: what it leaves sounding goes to the following points until the channel's next act.
    # Points are multiples of the stride: a note goes to those it reaches by their ordinals, and meets no others.
    after = F.lead("_i").over(in_channel)
    last = F.col("_act") & F.col("_sample").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("_i")))
    until = F.when(last, F.coalesce("_after", F.floor(F.col("_end") / F.col("_stride")))).otherwise(F.col("_i"))
    reached = rows.withColumn("_after", after).select(key, "_sample", "_order", "_i", F.explode(F.sequence("_i", until)).alias("_to"))
    # Only points that are there have an order.
    points = reached.groupBy(key, "_to").agg(F.collect_set("_sample").alias("_samples"), F.collect_set(F.when(F.col("_to") == F.col("_i"), F.col("_order"))).alias("_orders")).where(F.size("_orders") > 0)
    held = offsets.where(F.col("sample").isNotNull() & F.col("offset").isNotNull()).groupBy(key).agg(F.collect_set(F.struct("sample", "offset")).alias("_held"))
    needed = F.transform(F.filter("_held", lambda x: F.array_contains("_samples", x["sample"])), lambda x: x["offset"])
    found = points.join(held, key, "left").select(key, F.explode("_orders").alias("order"), F.array_sort(F.array_distinct(needed)).alias("offsets"))
    return found.select(key, "order", F.coalesce("offsets", F.array().cast("array<bigint>")).alias("offsets"))


def first_segment(events: DataFrame, offsets: DataFrame, key: str = "source") -> DataFrame:
    """key and the sorted offsets of all samples that the first played order starts."""
    acts = triggers(events, key).where((F.col("place") == 0) & ~F.col("off")).join(offsets, [key, "sample"])
    return acts.groupBy(key).agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def in_rows(events: DataFrame, key: str, item: str) -> DataFrame:
    """items of each key in order of row, those of one row as they came (seq)."""
    return events.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "seq", item))), lambda x: x[item]).alias("items"))


def means(points: DataFrame, key: str, value: str, weighted: str) -> DataFrame:
    """Mean of a value over a key's points, their number, and the ratio of two sums."""
    return points.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("points"), F.round(F.sum(weighted) / F.sum(value), 6).alias("ratio"))
