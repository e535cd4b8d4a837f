"""Clustering with pivots and hard negatives against plain computation with Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayslice.llm import exact, laesa, threshold

SCHEMA = "vec_id bigint, embedding array<double>, label int, cell int, rank int, width string, cluster string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, 2, "w", "c", 3) for i, v, x in rows], SCHEMA).repartition(4)


def vectors(n=400, width=64, seed=5, size=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        v = centres[i % 5] + 0.4 * rng.normal(size=width)
        rows.append((i, [float(np.float32(size * x)) for x in v / np.linalg.norm(v)], i % 3))
    same = rows[7][1]
    rows += [(1000 + i, same, 1) for i in range(60)]  # a common vector
    rows += [(2000, None, 1), (None, same, 2), (2100, [math.nan] * width, 1), (2200, [math.inf] * width, 1), (2300, [], 0), (2400, [1.0] * 3, 0)]
    rows += [(2500, [0.0] * width, 1), (2600, [None] + same[1:], 1), (2700, same, None)]
    return rows


def sound(v, width=None):
    return v and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k=8, rounds=10, width=64, scale=1024):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v, _ in rows if sound(v, width)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((gap(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        place = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), p in zip(kept, place, strict=True) if p == c]
            if own:
                centroids[c] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    last = [nearest(v) for _, v in kept]
    long = lambda n: n if n < 1 << 63 else None
    out = []
    for (i, _), (d, c) in zip(kept, last, strict=True):
        name = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        out.append((i, c, long(d), long(sum(x for x, n in last if n == c)), long(sum(x for x, _ in last)), name))
    return sorted(out, key=str)


def clusters(df, **kw):
    cols = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in laesa.cluster(df, **kw).select(*cols).collect()), key=str)


# Components of the largest size make distances that no long holds.
@pytest.mark.parametrize("size", [1.0, 3e7, 1e30])
def test_clusters_equal_plain_rounds(spark, size):
    rows = vectors(120, size=size)
    assert clusters(frame(spark, rows), rounds=4) == plain_clusters(rows, rounds=4)


def test_clusters_repeated_rows_and_few(spark):
    rows = vectors(30)[:3] * 2 + [(5, [0.5] * 64, 1), (None, [0.1] * 64, 1)]
    assert clusters(frame(spark, rows), rounds=3) == plain_clusters(rows, rounds=3)
    assert laesa.cluster(frame(spark, rows).limit(0)).count() == 0
    assert laesa.cluster(frame(spark, [(1, [1.0], 1), (2, None, 1)])).count() == 0


def test_pivots_avoid_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-9000, 9000, size=(8, 64))
    points = centres[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, size=(3000, 64))
    pivots = points[laesa.choose_pivots(points[:200])]
    cluster, best, computed = laesa.assign(points, laesa.pivot_distances(points, pivots), centres, laesa.pivot_distances(centres, pivots))
    every = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all()
    assert computed.mean() < 2


def test_equal_distances_take_the_smaller_number():
    points, centres = np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [-1, 0]])
    cluster, _, _ = laesa.assign(points, laesa.pivot_distances(points, points), centres, laesa.pivot_distances(centres, points))
    assert cluster.tolist() == [0, 0]


def test_limbs_and_longs_keep_numbers_and_order():
    numbers = [0, 1, -1, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63), 1 << 63, 1 << 90, -(1 << 200), 5 << 500]
    parts = exact.limbs(np.array(numbers, dtype=object))
    assert exact.from_limbs(dict(enumerate(parts)), len(numbers)) == numbers
    small, wide = (x.to_pylist() for x in exact.longs(np.array(numbers, dtype=object)))
    assert [exact.value_of(s, w) for s, w in zip(small, wide, strict=True)] == numbers
    order = sorted(range(len(numbers)), key=lambda i: (-small[i], wide[i] is None, [-b for b in wide[i] or b""]))
    assert [numbers[i] for i in order] == sorted(numbers, reverse=True)


def plain_negatives(rows, scale=256):
    kept = list(dict.fromkeys((i, tuple(math.floor(scale * x) for x in v), x) for i, v, x in rows if i is not None and x is not None and sound(v)))
    long = lambda n: n if -(1 << 63) < n < 1 << 63 else None
    out = []
    for i, a, label in kept:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, y) for j, b, y in kept if len(b) == len(a))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fit = [(t, m) for t, m, y in scored if y != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r + 1, m, long(-s), long(-t)) for r, (t, m) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "size"), [(8192, 1.0), (60, 1.0), (60, 1e12)])
def test_negatives_equal_all_products(spark, monkeypatch, shard, size):
    monkeypatch.setattr(threshold, "SHARD_VECTORS", shard)
    monkeypatch.setattr(threshold, "SHARD_ANCHORS", 3)
    monkeypatch.setattr(threshold, "CELLS", 4)
    rows = vectors(300, width=8, size=size)
    rows += [rows[100], (200, rows[201][1], 1), (3000, [-x for x in rows[0][1]], 0), (3100, [0.0] * 8, 2)]
    got = threshold.mine(frame(spark, rows), anchors=F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows)


def test_negatives_of_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.5], 1), (100, [0.5, 0.5], 2), (3, [0.9, 0.5], 1), (4, [0.4, 0.4], 2)]
    ask = F.col("vec_id") % 100 == 0
    assert sorted((tuple(r) for r in threshold.mine(frame(spark, rows), ask).collect()), key=str) == plain_negatives(rows)
    assert threshold.mine(frame(spark, rows).limit(0), ask).count() == 0
    assert threshold.mine(frame(spark, [(0, [1.0], 1)]), ask).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(3)
    points = rng.integers(-20, 20, size=(4000, 12))
    points[:40] *= 30
    lists = threshold.Lists(np.arange(4000), points)
    ids, scores = threshold.top(lists, points[0], 5, 0)
    products = points @ points[0]
    products[0] = -(1 << 60)
    assert scores.tolist() == np.sort(products)[::-1][:5].tolist()
    assert lists.read < 3000
