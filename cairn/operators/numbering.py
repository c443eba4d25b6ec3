"""Places of rows in the order of a whole table, without a task that sorts everything.

Rows are range-partitioned, sorted inside each partition and written once, each with the number of its range and its
place in it. Everything later reads what was written: counts of ranges and places of rows can't come from two
different exchanges, whatever adaptive execution joins or prunes. Ranges are as many as there are partitions, so
their running sums are a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.folders import written

#: monotonically_increasing_id counts the rows of a partition in its lower bits.
_ROW_BITS = 33


def ranged(rows: DataFrame, *order: str | Column, at: str = "_at", parts: int | None = None) -> DataFrame:
    """rows, written in ranges of the order, with `at`: the range's number, and in the lower 33 bits the place inside it.

    There are `parts` ranges, or as many as Spark makes of their bytes. Rows that are equal in the order lie in one range; give an order without many of them.
    """
    sorted_ = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    return written(sorted_.withColumn(at, F.monotonically_increasing_id()), "ranges")


def range_of(at: str = "_at") -> Column:
    return F.shiftright(F.col(at), _ROW_BITS)


def place_in_range(at: str = "_at") -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def numbered(rows: DataFrame, *order: str | Column, name: str = "_r") -> DataFrame:
    """rows with their place (from 0, without gaps) in the order."""
    at, part, before = (unused(rows, c) for c in ("_at", "_part", "_before"))
    table = ranged(rows, *order, at=at).withColumn(part, range_of(at))
    counts = table.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    heads = counts.withColumn(before, F.coalesce(F.sum(before).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    # A row for each written range.
    return table.join(F.broadcast(heads), part).withColumn(name, F.col(before) + place_in_range(at)).drop(at, part, before)


def unused(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = f"_{name}"
    return name
