"""Centroid clustering in exact integers, with a LAESA table of distances to fixed pivots.

The distance of every vector to a few pivots is computed once and written beside the vector. In a round the driver knows
each centroid's distance to the same pivots, and |d(x, p) - d(c, p)| <= d(x, c) for each pivot p: the largest difference bounds
every centroid of a vector from below without touching its components. The centroid of least bound gets the exact distance first, and of
the others only those whose bound does not exceed it. All sums are of integers, so the order and number of tasks change nothing.

A round is one pass over the written table: each task returns its sums per cluster (one row of limbs), Spark adds them up, and the driver
holds k centroids and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import exact
from .common import ship

K, ROUNDS, SEED, SCALE, WIDTH = 8, 10, 3, 1024, 64
PIVOTS = 16
#: Pivots are chosen among so many vectors of least hash.
PIVOT_SAMPLE = 1024
#: Vectors that are compared at once.
BLOCK = 4096
#: Distances to pivots are doubles; bounds give way by this much of their size, so that rounding never drops a centroid.
SLACK = 1e-9
STORED = "vec_id bigint, embedding array<double>, pivot_distances array<double>"
FOUND = "vec_id bigint, cluster int, distance bigint, exact_distances int"


def _roots(values: np.ndarray) -> np.ndarray:
    """Square roots as doubles; of numbers beyond all doubles, the largest double (which keeps differences bounds)."""
    if values.dtype != object:
        return np.sqrt(values.astype(np.float64))
    most = int(np.finfo(np.float64).max)
    return np.array([math.sqrt(v) if v < 1 << 100 else float(min(math.isqrt(v), most)) for v in map(int, values)])


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of each vector to each pivot, as doubles."""
    vectors, pivots = exact.alike(vectors, pivots, terms=max(1, vectors.shape[1]))
    return np.stack([_roots(exact.squares(vectors, p)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def choose_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Places of pivots: each has the largest sum of distances to those before it."""
    chosen: list[int] = []
    total = np.zeros(len(vectors))
    while len(vectors) and len(chosen) < min(count, len(vectors)):
        total[chosen] = -1.0
        chosen.append(int(total.argmax()))
        total += pivot_distances(vectors, vectors[chosen[-1:]])[:, 0]
    return np.array(chosen, dtype=np.int64)


def assign(
    vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroids_to_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, number of exact distances) of each vector; ties to the smaller number."""
    vectors, centroids = exact.alike(vectors, centroids, terms=max(1, vectors.shape[1]))
    k, n = len(centroids), len(vectors)
    low = np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        np.maximum(low, np.abs(to_pivots[:, p, None] - centroids_to_pivots[None, :, p]), out=low)
    slack = SLACK * (1.0 + max(to_pivots.max(initial=0.0), centroids_to_pivots.max(initial=0.0)))
    first = low.argmin(1)
    best = exact.squares(vectors, centroids[first])
    cluster, computed = first.copy(), np.ones(n, dtype=np.int32)
    for c in range(k):
        rows = np.flatnonzero((first != c) & (low[:, c] <= _roots(best) * (1 + SLACK) + slack))
        if len(rows):
            distance = exact.squares(vectors[rows], centroids[c])
            computed[rows] += 1
            nearer = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
            best[rows[nearer]], cluster[rows[nearer]] = distance[nearer], c
    return cluster, best, computed


def _kept(batches: Iterator[pa.RecordBatch], width: int, scale: int, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sound vectors with their floors (as doubles, which hold them exactly) and distances to the pivots."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            at, matrix = exact.sound_matrix(pa.concat_arrays([part.column(1)]), width)
            whole = exact.floors(matrix, scale)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), _lists(whole.astype(np.float64)), _lists(pivot_distances(whole, pivots))],
                names=["vec_id", "embedding", "pivot_distances"],
            )


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel(), pa.float64()))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            values = [pa.concat_arrays([part.column(i)]).flatten().to_numpy() for i in (1, 2)]
            yield part.column(0), exact.floors(values[0].reshape(-1, width), 1), values[1].reshape(-1, pivots)


class Centroids:
    """What a task needs of a round: the centroids and their distances to the pivots. At most k * (width + pivots) numbers."""

    def __init__(self, centroids: list[list[int]], pivots: np.ndarray):
        self.rows = np.array(centroids, dtype=object)
        self.to_pivots = pivot_distances(self.rows, pivots)


def _sums(now: Centroids, width: int, pivots: int):
    """Per task and cluster, limbs of: the components' sums, the number of vectors, the sum of distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width + 2) for _ in now.rows]
        for _, vectors, to_pivots in _blocks(batches, width, pivots):
            cluster, best, _ = assign(vectors, to_pivots, now.rows, now.to_pivots)
            for c in np.unique(cluster):
                own = cluster == c
                # Sums of a block stay exact: components below 2^27 times 4,096 rows.
                spread = (int((best[own] >> 31).sum()) << 31) + int((best[own] & ((1 << 31) - 1)).sum())
                parts = [*vectors[own].sum(0), int(own.sum()), spread]
                total[c] = [a + int(b) for a, b in zip(total[c], parts, strict=True)]
        rows = [(c, place, part) for c, sums in enumerate(total) if sums[width] for place, part in enumerate(exact.limbs(np.array(sums, dtype=object)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["cluster", "place", "sums"],
        )

    return run


def _round(stored: DataFrame, centroids: list[list[int]], pivots: np.ndarray, width: int) -> dict[int, list[int]]:
    """Of each non-empty cluster: the sums of the components, the number of vectors, the sum of squared distances."""
    parts = stored.mapInArrow(_sums(Centroids(centroids, pivots), width, len(pivots)), "cluster int, place int, sums array<bigint>")
    added = parts.groupBy("cluster", "place").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 2)]).alias("sums"))
    found: dict[int, dict[int, list[int]]] = {}
    for row in added.collect():  # k clusters of a few limbs
        found.setdefault(row.cluster, {})[row.place] = row.sums
    return {c: exact.from_limbs(limbs, width + 2) for c, limbs in found.items()}


def _finish(now: Centroids, width: int, pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, to_pivots in _blocks(batches, width, pivots):
            cluster, best, computed = assign(vectors, to_pivots, now.rows, now.to_pivots)
            distance = pa.array([d if d <= exact.MOST else None for d in map(int, best)], pa.int64()) if best.dtype == object else pa.array(best)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), distance, pa.array(computed)], names=["vec_id", "cluster", "distance", "exact_distances"])

    return run


def _least(stored: DataFrame, seed: int, count: int) -> list[list[float]]:
    """Vectors of the `count` smallest sha256 of '<seed>:<vec_id>'; of rows with one id the least vector comes first."""
    named = stored.where("vec_id IS NOT NULL").withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [r.embedding for r in named.orderBy("_hash", "embedding").limit(count).select("embedding").collect()]


def cluster(
    vectors: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
    width: int = WIDTH,
    pivots: int = PIVOTS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, exact_distances of each kept vector.

    Vectors of exactly `width` components, none null or non-finite, are kept, each component as floor(scale * x).
    The k centroids start as the vectors of smallest sha256 of '<seed>:<vec_id>'. Ties of distance go to the smaller number,
    an empty cluster keeps its centroid. `exact_distances` counts the centroids whose distance was computed in the last assignment.

    A row with a null id is a vector, but no centroid starts from it. Each repeated row is a vector of its own; of rows with one id the one
    with the least components starts first. Fewer than k named vectors give fewer centroids; none (or an empty table) gives no row.
    Distances and sums are exact at any size; one that does not fit a long is returned as null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    none = np.zeros((0, width), dtype=np.int64)
    quantized = plain.mapInArrow(lambda b: _kept(b, width, scale, none), STORED)
    # A bounded sample: pivots change the speed, never a result.
    sample = exact.floors(np.array(_least(quantized, seed, max(PIVOT_SAMPLE, k))).reshape(-1, width), 1)
    if not len(sample):
        return _empty(spark)
    fixed = sample[choose_pivots(sample, pivots)]
    stored = materialize(plain.mapInArrow(lambda b: _kept(b, width, scale, fixed), STORED), "pivot-table")
    centroids = [[int(x) for x in v] for v in sample[:k]]
    for _ in range(rounds):
        for c, sums in _round(stored, centroids, fixed, width).items():
            centroids[c] = [s // sums[width] for s in sums[:width]]
    last = {c: sums[width + 1] for c, sums in _round(stored, centroids, fixed, width).items()}
    fit = lambda n: n if n <= exact.MOST else None
    rows = [
        (c, fit(last.get(c, 0)), fit(sum(last.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids)
    ]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = stored.mapInArrow(_finish(Centroids(centroids, fixed), width, len(fixed)), FOUND)
    # k rows.
    joined = found.join(F.broadcast(about), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_distances")


def _empty(spark: SparkSession) -> DataFrame:
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, exact_distances int"
    return spark.createDataFrame([], schema)
