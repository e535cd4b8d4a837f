"""M-tree search against all inner products."""

from __future__ import annotations

import numpy as np
import pytest

from dayslice.llm import mtree

SCHEMA = "vec_id bigint, embedding array<double>, label int, score double, rank int, shard string"


def rows_of(n=700, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    out = []
    for i in range(n):
        v = centres[i % 5] + 0.2 * rng.normal(size=width)
        out.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    same = out[7][1]
    out += [(1000 + i, same) for i in range(120)]  # a common vector
    out += [(2000, None), (None, same), (2020, [float("nan")] * width), (2040, [float("inf")] * width), (2060, []), (2080, [1.0] * 3), (2100, [0.0] * width)]
    out += [(40, out[40][1]), (2001, [None] + same[1:])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 3, "s") for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("size", [1e4, 1e5, 1e7, 1e30])
def test_large_components_are_exact(spark, monkeypatch, size):
    """Products beyond doubles and beyond 64 bits; a score that no long holds comes back as null, in its right place."""
    monkeypatch.setattr(mtree, "SHARD_VECTORS", 128)
    rows = [(i, None if v is None else [None if x is None else x * size for x in v]) for i, v in rows_of(300)]
    got = [tuple(r) for r in mtree.top_k(frame(spark, rows)).collect()]
    want = [(*r[:3], r[3] if abs(r[3]) < 1 << 63 else None) for r in brute(rows, 20)]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute(rows, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            sound[i] = tuple(int(np.floor(64 * x)) for x in v)
    out = []
    for q, a in sound.items():
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in sound.items() if j != q and len(b) == len(a))
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 64])
def test_search_equals_all_products(spark, monkeypatch, shard):
    monkeypatch.setattr(mtree, "SHARD_VECTORS", shard)
    monkeypatch.setattr(mtree, "SHARD_QUERIES", 10)
    rows = rows_of()
    got = sorted(tuple(r) for r in mtree.top_k(frame(spark, rows)).collect())
    assert got == brute(rows, 20)


def test_few_vectors_and_none(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.25, 0.5]), (20, [-1.0, 2.0])]
    assert sorted(tuple(r) for r in mtree.top_k(frame(spark, rows)).collect()) == brute(rows, 20)
    assert mtree.top_k(frame(spark, rows).limit(0)).count() == 0
    assert mtree.top_k(frame(spark, [(0, [1.0])])).count() == 0


def test_bounds_avoid_products():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, size=(40, 6))
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.integers(-4, 5, size=(4000, 6))).astype(np.int64)
    tree = mtree.Tree(np.arange(4000), vectors)
    row, place, score = tree.search(np.arange(60), vectors[:60], 5)
    products = vectors[:60] @ vectors.T
    products[np.arange(60), np.arange(60)] = -(1 << 40)
    assert (np.sort(score.reshape(60, 5)) == np.sort(-np.sort(-products, axis=1)[:, :5])).all()
    assert tree.computed < 0.5 * 60 * 4000
