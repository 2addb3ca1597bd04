"""Centroid clustering of vectors: equal-average equal-variance search, exact in integers.

Centroids are sorted by the sum of their components. A vector starts at the centroid with the
nearest sum and scans outward. For sums S, deviations V (``sqrt(d * sum of squares - S ** 2)``)
and d components, ``d * distance >= (S - S') ** 2 + (V - V') ** 2``: once the sums alone leave no
room, nothing further out can be nearer, and a centroid whose sum and deviation together leave
none is passed over. What is left is compared by its exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FAR = 1 << 62


class Centroids:
    """Integer centroids, numbered by their row, in the order of their sums."""

    def __init__(self, rows: np.ndarray) -> None:
        self.dimensions = rows.shape[1]
        sums = rows.sum(axis=1)
        self.number = np.lexsort((np.arange(len(rows)), sums))
        self.rows, self.sums = rows[self.number], sums[self.number]
        self.spread = self._spread(self.rows, self.sums)

    def _spread(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        squares = np.einsum("ij,ij->i", rows, rows)
        return np.sqrt((self.dimensions * squares - sums * sums).astype(np.float64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid's number and squared distance; how many distances were computed.

        Of equally near centroids, the smallest number.
        """
        n, k, d = len(vectors), len(self.rows), self.dimensions
        sums = vectors.sum(axis=1)
        spread = self._spread(vectors, sums)
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        best = np.full(n, FAR // d, dtype=np.int64)
        number = np.full(n, k, dtype=np.int64)
        active, computed = np.arange(n), 0
        while len(active):
            lo, hi = below[active], above[active]
            gap_lo = np.where(lo >= 0, sums[active] - self.sums[lo], FAR)
            gap_hi = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[active], FAR)
            down = gap_lo <= gap_hi
            at, gap = np.where(down, lo, hi), np.minimum(gap_lo, gap_hi)
            room = d * best[active]
            open_ = gap < FAR
            square = np.where(open_, gap, 0) ** 2
            open_ &= square <= room
            below[active[open_ & down]] -= 1
            above[active[open_ & ~down]] += 1
            active, at, square, room = active[open_], at[open_], square[open_], room[open_]
            one, two = spread[active], self.spread[at]
            # Roots are rounded; the difference counts for a little less than it is.
            apart = np.maximum(np.abs(one - two) - 1e-12 * (one + two) - 1e-9, 0)
            tried = apart * apart <= (room - square).astype(np.float64) * (1 + 1e-12)
            rows, at = active[tried], at[tried]
            gone = vectors[rows] - self.rows[at]
            distance = np.einsum("ij,ij->i", gone, gone)
            computed += len(rows)
            name = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (name < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], name[better]
        return number, best, computed


def largest_component(dimensions: int) -> int:
    """Up to this, all distances and deviations fit in 64 bits."""
    return (1 << 30) // dimensions


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) and max(int(values.max()), -int(values.min())) > largest_component(dimensions):
        raise ValueError(f"a component times the scale is over {largest_component(dimensions)}")
    return values.reshape(-1, dimensions)


def integer_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int
) -> DataFrame:
    """``(id, v)`` of the vectors with so many components, all finite: floor(scale * component)."""
    double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).alias("id"), double.alias("v"))
        .where((F.size("v") == dimensions) & finite)
        .select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; only their sums, already added up by task, are collected."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        sums, count = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), d)
            number = search.nearest(rows)[0]
            order = np.argsort(number, kind="stable")
            found, start = np.unique(number[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(rows[order], start, axis=0)
                count += np.bincount(number, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]),
             pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = (
        parts.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
        .groupBy("cluster", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
    moved = centroids.copy()
    for r in total.toLocalIterator():
        moved[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return moved


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    dimensions: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    Kept are vectors with exactly ``dimensions`` components, none null, NaN or infinite. Each
    component becomes floor(scale * component); a component beyond ``largest_component`` is an
    error. Centroids start as the kept vectors whose ``<seed>:<id>`` has the smallest SHA-256
    (fewer vectors give fewer centroids; a null id comes last; rows that repeat an id are ordered
    by their components). Each of ``rounds`` rounds assigns all vectors to their nearest centroid
    and moves each centroid to the floor of its vectors' mean; one without vectors stays. Ties go
    to the smaller number. Repeated rows count, and are returned, once each. An empty table, or
    one without kept vectors, gives no rows.

    Every row is read in each round; tasks add up their vectors by centroid first, so a cluster
    that holds most rows is as cheap as any. The driver holds ``clusters * dimensions`` numbers.
    """
    kept = stored(integer_vectors(vectors, id_col, vector_col, dimensions, scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(name.alias("hash"), "v").orderBy(
        F.col("hash").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            number, distance, _ = search.nearest(_matrix(batch.column(1), dimensions))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()), pa.array(distance)],
                ["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    assigned = stored(
        kept.select("id", "v").mapInArrow(run, f"id {kind}, cluster int, distance long"), "assigned")
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
               for c, row in enumerate(centroids.tolist())]
    names = kept.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(
        F.sum("distance").alias("d")).toLocalIterator()}
    whole = kept.sparkSession.createDataFrame(
        list(inertia.items()), "cluster int, cluster_inertia long")
    about = names.join(whole, "cluster")  # a row for each centroid
    return assigned.join(F.broadcast(about), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia",
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")
