"""Numeric arrays: differences, similarity, best lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _square(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x * x)


def doubles(array: Column) -> Column:
    return F.transform(array, lambda x: x.cast("double"))


def similarity(ref: Column, test: Column) -> Column:
    """1 minus the RMS of the difference over that of the reference, at least 0, over the shorter length.

    0 without values; two silent arrays are alike, and a silent reference is unlike anything else.
    """
    n = F.least(F.size(ref), F.size(test))
    a, b = F.slice(ref, F.lit(1), n), F.slice(test, F.lit(1), n)
    base, gap = _square(a), _square(F.zip_with(a, b, lambda x, y: x - y))
    ratio = F.greatest(F.lit(0.0), 1 - F.sqrt(gap / F.nullif(n, F.lit(0))) / F.sqrt(F.nullif(base, F.lit(0.0)) / n))
    return F.when(n == 0, 0.0).when(base == 0, F.when(gap == 0, 1.0).otherwise(0.0)).otherwise(ratio)


def largest_gap(ref: Column, test: Column) -> Column:
    n = F.least(F.size(ref), F.size(test))
    return F.array_max(F.zip_with(F.slice(ref, F.lit(1), n), F.slice(test, F.lit(1), n), lambda x, y: F.abs(x - y)))


def best_lag(pairs: DataFrame, key: str, ref: str, test: str, most: int) -> DataFrame:
    """key, lag and similarity of the best shift of test against ref; of equal ones the least shift."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    each = pairs.select(key, F.col(ref), F.col(test), lags)
    lag = F.col("lag")
    a = F.when(lag >= 0, F.col(ref)).otherwise(F.slice(ref, 1 - lag, F.greatest(F.size(ref) + lag, F.lit(0))))
    b = F.when(lag <= 0, F.col(test)).otherwise(F.slice(test, lag + 1, F.greatest(F.size(test) - lag, F.lit(0))))
    scored = each.select(key, lag, F.round(similarity(a, b), 6).alias("s"))
    return scored.groupBy(key).agg(F.max_by(F.struct("lag", "s"), F.struct("s", -F.abs(lag), -lag)).alias("m")).select(key, "m.lag", F.col("m.s").alias("similarity"))


def bit_equal(a: Column, b: Column) -> Column:
    """Whether two arrays of numbers are the same, value by value; arrays of other lengths aren't."""
    return (F.size(a) == F.size(b)) & ~F.exists(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)
