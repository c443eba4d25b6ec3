"""Edits of ordered lists (arrays), counted from 0; places beyond the list change nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def insert_at(items: Column, at: int, value: Column) -> Column:
    return F.concat(F.slice(items, 1, at) if at else F.slice(items, 1, 0), F.array(value), F.slice(items, at + 1, F.greatest(F.size(items), F.lit(1))))


def remove_at(items: Column, at: int) -> Column:
    return F.concat(F.slice(items, 1, at), F.slice(items, at + 2, F.greatest(F.size(items), F.lit(1))))


def swap(items: Column, a: int, b: int) -> Column:
    other = lambda x, i: F.when(i == a, F.get(items, F.lit(b))).when(i == b, F.get(items, F.lit(a))).otherwise(x)
    return F.when(F.size(items) > max(a, b), F.transform(items, other)).otherwise(items)


def index_after_remove(index: Column, removed: Column, size: Column) -> Column:
    """Where the current place is after one item went, -1 in an empty list."""
    moved = F.when(removed < index, index - 1).otherwise(index)
    return F.when(size <= 1, -1).otherwise(F.least(moved, size - 2))
