"""Rows of a query against those of its SQL."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
