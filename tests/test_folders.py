"""Written tables leave no shuffle files behind, and the session's settings as they were."""

import os

from pyspark.sql import functions as F

from cairn.operators import fts
from cairn.sources import folders


def shuffle_files(spark) -> set[str]:
    """Names of the shuffle files that lie on the disks of the session."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_writes_leave_no_shuffle_files(spark):
    spark.conf.unset(folders.CLEANUP)
    rows = spark.range(1000).select("id", F.concat(F.lit("a"), (F.col("id") % 50).cast("string"), F.lit(" b")).alias("text"))
    setting, before = spark.conf.get(folders.CLEANUP, None), shuffle_files(spark)
    made = folders.written(rows.groupBy("text").count(), "counts")
    folder = folders.work_folder(spark, "index")
    fts.write_index(rows, {"text": F.col("text")}, folder)
    assert not shuffle_files(spark) - before and spark.conf.get(folders.CLEANUP, None) == setting
    assert made.count() == 50 and fts.open_index(spark, folder).rows == 1000
    assert {(r["term"], r["rows"]) for r in fts.vocabulary(fts.open_index(spark, folder)).collect()} == {("b", 1000)} | {(f"a{i}", 20) for i in range(50)}


def test_a_written_plan_can_be_run_again(spark):
    """Shuffles of one plan that went with a write are made anew by the next."""
    counts = spark.range(300).groupBy((F.col("id") % 7).alias("k")).count()
    a, b = folders.written(counts, "a"), folders.written(counts, "b")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == sorted(map(tuple, counts.collect()))


def test_postings_by_ranges_of_terms_are_whole(spark):
    """Slices of terms part them: each posting is there once, whatever the first characters, also where there are none."""
    words = ["a", "aa", "b", "ß", "zz", "é", "漢字", "9", "𝒳"]
    rows = spark.range(90).select("id", F.concat_ws(" ", F.lit("a"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int"))).alias("text"))
    folder, empty = folders.work_folder(spark, "index"), folders.work_folder(spark, "index")
    fts.write_index(rows, {"text": F.col("text")}, folder)
    found = fts.open_index(spark, folder).postings
    tests = fts._slices(found, F.lit(1))
    assert 1 < len(tests) <= fts.SLICES and found.count() == sum(found.where(t).count() for t in tests) == 170
    fts.write_index(rows.limit(0), {"text": F.col("text")}, empty)
    assert fts.open_index(spark, empty).postings.count() == 0
