"""Running values of cut timelines against windows over whole ones."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import intervals, timeline
from cairn.operators.scans import running


def _events(spark, n, keys=5):
    """Key 0 has about half of the rows; some keys, places and values are null."""
    h = F.abs(F.xxhash64("id"))
    key = F.when(h % 2 == 0, 0).when(h % 101 == 1, None).otherwise(h % keys)
    return spark.range(n).select("id", key.alias("k"), F.when(h % 97 != 3, F.floor(F.col("id") / 3)).alias("t"), F.when(h % 3 == 0, h % 1000 - 500).alias("v"), F.lit("x").alias("_at"))


@pytest.mark.parametrize("before", [False, True])
def test_split_equals_window(spark, before):
    rows = _events(spark, 30_000)
    values = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("v"))}
    got = running(rows, ["k"], ["t", "id"], values, before=before, key_rows=1000, range_rows=700)
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    want = rows.withColumns({"s": F.sum("v").over(w), "hi": F.max("v").over(w), "lo": F.min("v").over(w), "l": F.last("v", ignorenulls=True).over(w)})
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 30_000


def test_one_module_of_many_events_runs_in_many_tasks(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.lit(1).alias("module"), F.col("id").alias("order"), F.when(F.col("id") % 1000 == 0, F.col("id") % 7 + 1).alias("speed"), F.when(F.col("id") % 1700 == 5, F.col("id") % 90 + 60).alias("tempo"))
    got = running(rows, ["module"], ["order"], {"latched": ("last", F.col("speed"))}, key_rows=n // 4, range_rows=n // 20).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= n // 4
    out = got.agg(F.count(F.lit(1)), F.sum((F.col("latched") == F.floor(F.col("order") / 1000) * 1000 % 7 + 1).cast("long"))).first()
    assert tuple(out) == (n, n)


def test_cut_timelines_give_the_rows_of_whole_ones(spark):
    points = spark.range(4000).select(F.lit("m").alias("module"), (F.col("id") * 1.7).alias("x"), "id")
    facts = spark.range(1000).select(F.lit("m").alias("module"), (F.col("id") * 7).alias("order"), F.col("id").alias("value"))
    one, many = (timeline.asof(points, facts, "module", "x", "order", ["value"], key_rows=k) for k in (100_000, 50))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and many.count() == 4000
    rows = spark.range(3000).select((F.col("id") % 2).alias("module"), F.col("id").alias("order"), F.when(F.col("id") % 50 == 7, 4).alias("speed"), F.when(F.col("id") % 70 == 9, 150).alias("tempo"), F.lit(3).alias("n"))
    one, many = (timeline.order_seconds(rows, key_rows=k).select("module", "order", "speed", "tempo", F.round("seconds", 4).alias("seconds")) for k in (100_000, 50))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0
    one, many = (intervals.prefix_offsets(rows, "module", ["order"], "n", key_rows=k) for k in (100_000, 50))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_greedy_keeps_going_after_a_span_without_end(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 6, None), (1, 7, 9), (1, 8, 10), (2, None, 3), (2, 1, 2)], "k int, start long, stop long")
    got = sorted(intervals.greedy(rows, "k").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 0, 5), (1, 6, None), (1, 7, 9), (2, 1, 2)]
