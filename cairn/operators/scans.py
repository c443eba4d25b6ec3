"""Running values along a key's rows, where one key may hold more rows than a task should.

Keys of few rows are scanned by a window. The rows of a key beyond `KEY_ROWS` are cut into ranges of its order (written, so that
each row has its range for good), every range is scanned by a window of its own, and what a range hands on (its sum, its greatest or least or
last value) is added up from range to range, a row for each range and key, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import place_in_range, range_of, ranged, unused

#: Rows of a key that one task scans, and rows of a range where a key has more.
KEY_ROWS, RANGE_ROWS = 4_000_000, 500_000

#: What is carried: the aggregate of a window or a range, and how a carried value and one inside the range make one.
_KINDS = {
    "sum": (F.sum, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))),
    "max": (F.max, lambda x, y: F.greatest(x, y)),
    "min": (F.min, lambda x, y: F.least(x, y)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda x, y: F.coalesce(y, x)),
}


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool = False, key_rows: int = KEY_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with a column for each of values: the sum, max, min or last value that isn't null, up to each row of its key, or up to the one before it.

    values has (kind, expression) by name. Null keys are one key. Rows that are equal in the order follow one another in any order.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > key_rows)
    found = sizes.select(F.count(F.lit(1)), F.sum("_rows")).first()
    if not found[0]:
        return _scanned(rows, by, order, values, before)
    hot = sizes.select(*(F.col(c).alias(f"_hot_{c}") for c in by))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_hot_{c}"))
    few = _scanned(rows.join(hot, same, "left_anti"), by, order, values, before)
    return few.unionByName(_split(rows.join(hot, same, "left_semi"), by, order, values, before, -(-found[1] // range_rows)))


def _frame(w, before: bool):
    return w.rowsBetween(W.unboundedPreceding, -1 if before else 0)


def _scanned(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool) -> DataFrame:
    w = _frame(W.partitionBy(*by).orderBy(*order), before)
    return rows.withColumns({name: _KINDS[kind][0](value).over(w) for name, (kind, value) in values.items()})


def _split(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool, parts: int) -> DataFrame:
    at, part = unused(rows, "_at"), unused(rows, "_part")
    held = {f"_value_{i}": value for i, (_, value) in enumerate(values.values())}
    table = ranged(rows.withColumns(held), *by, *order, at=at, parts=parts).withColumn(part, range_of(at)).withColumn(at, place_in_range(at))
    kinds = {f"_value_{i}": kind for i, (kind, _) in enumerate(values.values())}
    # Each range alone, in as many tasks.
    own = _frame(W.partitionBy(part, *by).orderBy(at), before)
    inside = table.repartitionByRange(parts, part).withColumns({f"{v}_in": _KINDS[k][0](v).over(own) for v, k in kinds.items()})
    # What ranges hand on, a row for each range and key.
    whole = {"last": lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct(at, v)))[v]}
    totals = table.groupBy(part, *by).agg(*(whole.get(k, _KINDS[k][0])(v).alias(f"{v}_all") for v, k in kinds.items()))
    earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    handed = totals.select(F.col(part).alias("_in_part"), *(F.col(c).alias(f"_in_{c}") for c in by), *(_KINDS[k][0](f"{v}_all").over(earlier).alias(f"{v}_before") for v, k in kinds.items()))
    same = F.col(part) == F.col("_in_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_in_{c}"))
    out = inside.join(handed, same)
    return out.select(*rows.columns, *(_KINDS[kinds[v]][1](F.col(f"{v}_before"), F.col(f"{v}_in")).alias(name) for name, v in zip(values, held, strict=True)))
