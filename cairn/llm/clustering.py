"""Centroid clustering by Lloyd's rounds that move differences only, in exact integers.

Vectors become integers once and are written; then every round writes each vector with its owner and its distance to it.
A round compares a vector with the centroids that changed since the round before, and with all of them only where its own
owner did: any other centroid was no nearer then and has not moved. Vectors that change owner are added to the new one and
taken from the old one inside the task; a task sends these signed sums, a row for each centroid it touched, beside
its vectors in the same files. They are folded into the written global sums, of which centroids follow by exact
division. Vectors are never shuffled, a centroid's vectors never meet in one task, and what comes to the driver is one row for
each centroid and component. If no centroid changes, the rounds that are left would change nothing and are not run.

Defined cases: a vector that is null, of another length, or with a null or non-finite component isn't kept; components are
held within +-sqrt(2**60 / dims), so that every distance fits a long; sums over vectors that don't are the largest long; a null vec_id counts as
an empty text in the order of the first centroids, equal ids go on by their components; with fewer vectors than centroids there are as many
centroids as vectors; of equal centroids the first has the vectors; repeated rows are vectors of their own; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors that are compared at once.
CHUNK_ROWS = 4096
MOST = 2**63 - 1


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id and q, the components as floor(scale * x), of the vectors that are kept."""
    most = math.isqrt(2**60 // dims)

    def cut(batches):
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            batch = batch.filter(right)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
            ok = np.isfinite(x).all(1)
            q = np.floor(np.clip(x[ok] * scale, -most, most)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * dims), pa.array(q.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), lists], names=["vec_id", "q"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col(column).cast("array<double>").alias("v")).mapInArrow(cut, f"vec_id {kind}, q array<int>")


def first_centroids(kept: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the least hashes of seed and id, in that order: a top-k, so each task sends `count` rows at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.orderBy(digest, "q").limit(count).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of q to rows of centroids."""
    if not len(q) or not len(centroids):
        return np.zeros((len(q), len(centroids)), np.int64)
    top = max(int(np.abs(q).max()), int(np.abs(centroids).max()))
    if 4 * q.shape[1] * top * top < 2**53:  # no product or sum needs more bits than a double has
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)


def nearest(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after a round in which the marked centroids changed; ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    stale = (owner < 0) | changed[owner]
    if stale.any():
        d = distances(q[stale], centroids)
        owner[stale] = d.argmin(1)
        distance[stale] = d[np.arange(len(d)), owner[stale]]
    numbers, rest = np.flatnonzero(changed), np.flatnonzero(~stale)
    if len(numbers) and len(rest):
        d = distances(q[rest], centroids[numbers])
        at = d.argmin(1)
        best, number = d[np.arange(len(d)), at], numbers[at]
        better = (best < distance[rest]) | ((best == distance[rest]) & (number < owner[rest]))
        owner[rest[better]], distance[rest[better]] = number[better], best[better]
    return owner, distance


def _assign(centroids: np.ndarray, changed: np.ndarray, kind: str):
    """The work of a task in one round: vectors (n null) with owner and distance, and at the end its signed sums (n set)."""
    count, dims = centroids.shape

    def rows(columns, n: int) -> pa.RecordBatch:
        fields = [("vec_id", columns[0].type if columns[0] is not None else None), ("q", pa.list_(pa.int32())), ("owner", pa.int32()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    def work(batches):
        sums, n, id_type = np.zeros((count, dims), np.int64), np.zeros(count, np.int64), None
        touched = np.zeros(count, bool)
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, len(batch), CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                q = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                before, was = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                owner, distance = nearest(q, before, was, centroids, changed)
                for sign, side in ((1, owner), (-1, before)):
                    moved = (owner != before) & (side >= 0)
                    for c in np.unique(side[moved]).tolist():
                        mine = moved & (side == c)
                        sums[c] += sign * q[mine].sum(0)
                        n[c] += sign * int(mine.sum())
                        touched[c] = True
                yield rows([part.column(0), part.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), None, None], len(part))
        at = np.flatnonzero(touched)
        if len(at):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dims), pa.array(sums[at].reshape(-1)))
            yield rows([pa.nulls(len(at), id_type), None, pa.array(at.astype(np.int32)), None, lists, pa.array(n[at])], len(at))

    return work, f"vec_id {kind}, q array<int>, owner int, distance long, sums array<long>, n long"


@dataclass
class Clusters:
    """members: vec_id, cluster and distance of each kept vector (a written table); centroids in the order of their numbers; compared: rounds that were run."""

    members: DataFrame
    centroids: list[list[int]]
    compared: int


def delta_lloyd(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> Clusters:
    """Clusters of the kept vectors after so many rounds and one more assignment."""
    work = Work(vectors.sparkSession, "clusters")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = work.write(integer_vectors(vectors, dims, scale), "vectors")
    centroids = first_centroids(kept, count, seed)
    if not len(centroids):
        return Clusters(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], 0)
    state, changed, totals = kept.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")}), np.ones(len(centroids), bool), None
    for k in range(rounds + 1):
        task, schema = _assign(centroids, changed, kind)
        made = work.write(state.mapInArrow(task, schema), f"round-{k}", drop=["vectors", f"round-{k - 1}"])
        state = made.where("n is null").select("vec_id", "q", "owner", "distance")
        if k == rounds:
            break
        # Signed sums by centroid and component (the count at -1), folded into what is written of the rounds before.
        moved = made.where("n is not null").select("owner", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x")).select("owner", F.col("at") - 1, F.col("x").cast("decimal(38,0)").alias("x"))
        moved = moved.toDF("cluster", "at", "x")
        both = moved if totals is None else totals.unionByName(moved)
        totals = work.write(both.groupBy("cluster", "at").agg(F.sum("x").alias("x")), f"sums-{k}", drop=[f"sums-{k - 1}"])
        sums = {(r["cluster"], r["at"]): int(r["x"]) for r in totals.collect()}  # a number for each centroid and component
        new = centroids.copy()
        for c in range(len(centroids)):
            if n := sums.get((c, -1), 0):
                new[c] = [sums[c, i] // n for i in range(dims)]
        changed, centroids = (new != centroids).any(1), new
        if not changed.any():
            break
    return Clusters(state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids.tolist(), k + 1)


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = delta_lloyd(vectors, **options)
    spark = vectors.sparkSession
    per = found.members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid
    total = sum(int(r["d"]) for r in per)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    facts = [(r["cluster"], min(MOST, int(r["d"])), min(MOST, total), digest[r["cluster"]]) for r in per]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.members.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
