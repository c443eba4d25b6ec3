"""Clustering by differences against plain rounds over everything."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import clustering, queries
from tests.compare import same

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, dims=64, count=16, rounds=3):
    """Lloyd's rounds with Python's integers, every vector against every centroid."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:count]
    cents = [q for _, q in first]
    if not cents:
        return []
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        owner = [min((d2(q, c), k) for k, c in enumerate(cents)) for _, q in kept]
        if step == rounds:
            break
        for k in range(len(cents)):
            mine = [q for (_, q), (_, o) in zip(kept, owner, strict=True) if o == k]
            if mine:
                cents[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    per = {}
    for d, k in owner:
        per[k] = per.get(k, 0) + d
    total = sum(per.values())
    return [(i, k, d, per[k], total, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, owner, strict=True)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def vectors(n, seed=0, dims=64):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [[float(np.float32(x + r.gauss(0, 0.2))) for x in r.choice(middles)] for _ in range(n)]


def test_equals_sql(spark, sf, duck):
    same(queries.op11_clusters(spark, sf), duck, queries.OP11_SQL)


def test_odd_vectors(spark):
    """Nulls, other lengths, NaN and infinity go; equal rows, equal ids, no ids, a third of all rows equal, clashing columns."""
    good = vectors(60, 1)
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (7, good[8]), (None, good[3]), (None, good[4])] + [(1000 + i, good[0]) for i in range(35)]
    odd = [(80, None), (81, []), (82, good[1][:63]), (83, [*good[1], 0.0]), (84, [float("nan"), *good[1][1:]]), (85, [float("inf"), *good[1][1:]]), (86, [None, *good[1][1:]]), (87, [0.0] * 64), (88, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows + odd], "vec_id long, embedding array<float>, owner string, n int, q array<int>").repartition(5)
    got = clustering.clustered(df)
    assert got.columns == COLUMNS
    assert ordered(got.collect()) == ordered(plain(rows + odd))


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17])
def test_few_vectors(spark, n):
    rows = list(enumerate(vectors(n, 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ordered(clustering.clustered(df).collect()) == ordered(plain(rows))


def test_large_components_stay_exact(spark):
    """Beyond what doubles hold exactly; a component beyond the bound is held there."""
    r = random.Random(3)
    rows = [(i, [r.uniform(-2e6, 2e6) for _ in range(64)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ordered(clustering.clustered(df).collect()) == ordered(plain(rows))
    far = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    one = clustering.delta_lloyd(far, count=1, rounds=1)
    assert [r["distance"] for r in one.members.collect()] == [64 * (2**27) ** 2] * 2


def test_only_what_changed_is_compared(monkeypatch):
    """A vector whose owner stays is compared with changed centroids alone."""
    q = np.array(vectors(200, 4)) * 64
    q = q.astype(np.int64)
    cents = q[:16].copy()
    owner, dist = clustering.nearest(q, np.full(200, -1), np.zeros(200, np.int64), cents, np.ones(16, bool))
    cents[3] += 5
    changed = np.arange(16) == 3
    seen = []
    whole = clustering.distances
    monkeypatch.setattr(clustering, "distances", lambda a, c: seen.append((len(a), len(c))) or whole(a, c))
    after, d = clustering.nearest(q, owner, dist, cents, changed)
    moved = int((owner == 3).sum())
    assert seen == [(moved, 16), (200 - moved, 1)]
    full = whole(q, cents)
    assert after.tolist() == full.argmin(1).tolist() and d.tolist() == full.min(1).tolist()


def test_rounds_end_when_nothing_changes(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(40)]
    found = clustering.delta_lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), count=2, rounds=50, dims=4)
    assert found.compared < 5
    assert found.members.agg(F.sum("distance")).first()[0] in (0, 40 * 4 * 32 * 32)
