"""The module catalogue: browsing, lookup, precomputed aggregates and ingest decisions, over DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import nocase
from .numbering import numbered

#: Columns of a result row, and of a module's details.
HIT = ("id", "title", "format", "duration", "channels", "size_bytes", "root_cid")
DETAIL = (*HIT, "filename", "source", "num_samples", "instruments", "comment", "ingested_at")
PAGE, PAGE_MOST = 100, 500
COUNTS = "array<struct<format string, count bigint>>"


def list_modules(modules: DataFrame, sort: str = "latest", fmt: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of result rows; unknown sorts mean latest. Every order is total by id, so pages don't overlap.

    The limit is held between 1 and 500. Sort and limit together are a top-k: each task keeps limit + offset rows.
    """
    limit = max(1, min(PAGE_MOST, PAGE if limit is None else limit))
    offset = max(0, offset or 0)
    rows = modules if fmt is None else modules.where(F.col("format") == fmt)
    order = {"title": [nocase(F.col("title")).asc_nulls_first(), F.col("id")], "random": [F.rand()]}.get(sort, [F.col("ingested_at").desc(), F.col("id").desc()])
    return rows.orderBy(*order).offset(offset).limit(limit).select(*HIT)


def get_module(modules: DataFrame, module_id: int) -> DataFrame:
    return with_defaults(modules.where(F.col("id") == module_id).select(*DETAIL))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Nulls of text become empty, those of numbers zero."""
    zero = {"string": "", "double": 0.0, "bigint": 0, "int": 0}
    return rows.select(*(F.coalesce(F.col(c), F.lit(zero[t]).cast(t)).alias(c) if t in zero else F.col(c) for c, t in rows.dtypes))


def format_counts(modules: DataFrame) -> DataFrame:
    return modules.groupBy("format").agg(F.count(F.lit(1)).alias("count"))


def bounded_count(rows: DataFrame, limit: int) -> DataFrame:
    """How many rows there are, but no more than limit + 1: the scan stops there."""
    return rows.select(F.lit(1).alias("one")).limit(limit + 1).agg(F.count("one").alias("n"))


def meta_table(modules: DataFrame) -> DataFrame:
    return meta_of_counts(format_counts(modules))


def meta_of_counts(counts: DataFrame) -> DataFrame:
    """key and value of what is precomputed: total, and format_counts as JSON, largest first."""
    counts = counts.agg(F.sum("count").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "format", "count"))).alias("c"))
    listed = F.to_json(F.transform("c", lambda x: F.struct(x["format"].alias("format"), x["count"].alias("count"))))
    pairs = F.array(F.struct(F.lit("total").alias("key"), F.coalesce(F.col("total"), F.lit(0)).cast("string").alias("value")), F.struct(F.lit("format_counts").alias("key"), listed.alias("value")))
    return counts.select(F.explode(pairs).alias("p")).select("p.key", "p.value")


def read_format_counts(meta: DataFrame) -> DataFrame:
    """format and count from the table; none where the JSON is bad."""
    return meta.where("key = 'format_counts'").select(F.explode(F.from_json("value", COUNTS)).alias("f")).select("f.format", "f.count")


def upsert_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with changed keys replaced."""
    return meta.join(changes, "key", "left_anti").unionByName(changes)


def new_sources(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose source isn't catalogued yet; a source that comes twice counts once (the first by its order)."""
    return candidates.join(known.select("source"), "source", "left_anti").dropDuplicates(["source"])


def rebake(known: DataFrame, baked: DataFrame) -> DataFrame:
    """Each known module after a new bake: outcome unchanged, repointed or untouched, with its root and blocks."""
    new = baked.select("source", F.col("root_cid").alias("new_root"), F.col("num_blocks").alias("new_blocks"))
    outcome = F.when(F.col("new_root").isNull(), "untouched").when(F.col("new_root") == F.col("root_cid"), "unchanged").otherwise("repointed")
    changed = outcome == "repointed"
    return known.join(new, "source", "left").select(
        "id", "source", outcome.alias("outcome"), F.when(changed, F.col("new_root")).otherwise(F.col("root_cid")).alias("root_cid"), F.when(changed, F.col("new_blocks")).otherwise(F.col("num_blocks")).alias("num_blocks")
    )


def insert_new(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalogue with rows of new sources, numbered on from the largest id in order of source.

    Numbers come from written ranges of the sources, so ids have no gaps at any number of partitions.
    """
    fresh = new_sources(rows.drop("id"), catalog)
    last = catalog.agg(F.max("id")).first()[0] or 0
    return catalog.unionByName(numbered(fresh, "source", name="_n").withColumn("id", F.lit(last) + F.col("_n") + 1).drop("_n"))


def get_source(modules: DataFrame, source: str) -> DataFrame:
    """id and root of a source's module."""
    return modules.where(F.col("source") == source).select("id", "root_cid")


def camel_names(rows: DataFrame) -> DataFrame:
    """rows with names such as rootCid for root_cid."""
    return rows.toDF(*(re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), c) for c in rows.columns))
