"""JSON documents and line streams as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_pinset(rows: DataFrame, value: str) -> DataFrame:
    """Adds cid and kind, a row for each pin: a map of address to kind, or a list whose kinds are 0."""
    typed = F.map_entries(F.from_json(value, "map<string,int>"))
    legacy = F.transform(F.from_json(value, "array<string>"), lambda c: F.struct(c.alias("key"), F.lit(0).alias("value")))
    pins = F.when(F.trim(value).startswith("["), legacy).otherwise(typed)
    return rows.withColumn("_pin", F.explode(pins)).withColumn("cid", F.col("_pin.key")).withColumn("kind", F.col("_pin.value")).drop("_pin", value)


def last_field(lines: DataFrame, key: str, order: str, line: str, field: str) -> DataFrame:
    """The field of each stream's last line that is an object with it; other lines are skipped."""
    value = F.get_json_object(line, f"$.{field}")
    return lines.withColumn("value", value).where(F.col("value").isNotNull()).groupBy(key).agg(F.max_by("value", order).alias("value"))


def first_of_kind(lines: DataFrame, key: str, order: str, line: str, kind_field: str, kind: str, field: str) -> DataFrame:
    """The field of each stream's first line of a kind."""
    rows = lines.where(F.get_json_object(line, f"$.{kind_field}") == kind)
    return rows.groupBy(key).agg(F.min_by(F.get_json_object(line, f"$.{field}"), order).alias("value"))
