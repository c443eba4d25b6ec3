"""Places over whole tables lose no row, whatever the partitions are and whatever adaptive execution does."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import catalog, sessions
from cairn.operators.numbering import numbered
from cairn.sources import folders


@pytest.fixture(params=[(1, "true"), (200, "true"), (7, "false")])
def conf(spark, request):
    parts, adaptive = request.param
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(spark, n):
    return spark.range(n).select(F.concat(F.lit("s"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(n)).cast("string"), 8, "0")).alias("source"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"), F.lit("x").alias("_at"))


def test_numbers_without_gaps(spark, conf):
    n = 400_000
    got = numbered(_rows(spark, n), "source", name="r")
    assert got.columns == ["source", "payload", "_at", "r"]
    out = got.agg(F.count("payload").alias("n"), F.count_distinct("r").alias("d"), F.min("r").alias("a"), F.max("r").alias("b"), F.sum((F.concat(F.lit("s"), F.lpad(F.col("r").cast("string"), 8, "0")) == F.col("source")).cast("int")).alias("right")).first()
    assert tuple(out) == (n, n, 0, n - 1, n)


def test_new_sources_are_all_inserted(spark, conf):
    rows = _rows(spark, 40_000)
    known = rows.where(F.substring("source", -1, 1) < "8").withColumn("id", F.row_number().over(W.orderBy("source")).cast("long"))
    out = catalog.insert_new(known, rows.withColumn("id", F.lit(0).cast("long")))
    assert out.agg(F.count("payload"), F.count_distinct("id"), F.max("id")).first()[:] == (40_000, 40_000, 40_000)
    empty = catalog.insert_new(known.limit(0), rows.withColumn("id", F.lit(0).cast("long")))
    assert empty.agg(F.count("payload"), F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (40_000, 40_000, 1, 40_000)


def test_every_kth_row_with_its_columns(spark, conf):
    out = sessions.every_kth(_rows(spark, 40_001), "source", 7)
    assert (out.count(), out.where("payload is null").count()) == (5715, 0)


def test_shared_folders_follow_the_default_file_system(spark):
    """A folder without scheme is the default file system's; it is never guessed to be local."""
    h = spark._jsc.hadoopConfiguration()
    before = h.get("fs.defaultFS")
    h.set("fs.viewfs.mounttable.other.link./shared", "file:/tmp")
    h.set("fs.defaultFS", "viewfs://other/")
    try:
        assert folders.qualified(spark, "/shared/x") == "viewfs://other/shared/x"
    finally:
        h.set("fs.defaultFS", before) if before else h.unset("fs.defaultFS")
    assert folders.qualified(spark, "/tmp/x") == "file:///tmp/x"
