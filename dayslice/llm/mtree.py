"""Exact search of the k highest integer inner products with M-trees searched best first.

Inner products are turned into distances: every vector x gets one more coordinate sqrt(M - |x|^2), M the largest
squared norm, a query a zero there; then d(q, x)^2 = |q|^2 + M - 2 q.x, and the nearest vectors are those with the highest products.

Vectors are dealt by a hash of their id into shards of some thousand, so one common vector or label fills no shard.
Each shard builds its own tree: leaf pages with a routing vector and a covering radius, and in each entry the distance to it;
above them inner nodes of the same kind. A block of queries goes down together: the node with the best bound is next,
the triangle inequality with the stored distances drops nodes and entries before any product is computed, and what is
left is scored in integers. Every query keeps its k best; the shards' lists are merged by a rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exact
from .common import ship

K = 20
SCALE = 64
SHARD_VECTORS = 8192
SHARD_QUERIES = 65_536
PAGE = 128
FANOUT = 16
#: Queries that go down a tree together.
BLOCK = 128
#: Distances are doubles; bounds give way by this much, so that rounding never drops a result. Components above `exact.SMALL`
#: are scaled to at most 1 for the bounds and scored as integers of any size.
SLACK = 1e-6
#: Below every score.
NONE = -(1 << 62)
FOUND = "query_id bigint, vec_id bigint, score bigint, wide binary"


class Node:
    """A page of entries: vectors of a leaf, or nodes. `far` are the entries' distances to the routing vector."""

    def __init__(self, router, radius, far, members=None, children=None):
        self.router, self.radius, self.far, self.members, self.children = router, radius, far, members, children


def _farthest(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of routing vectors: each is farthest from those before it."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _distances(points: np.ndarray, router: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - router) ** 2).sum(1))


def build(points: np.ndarray, members: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> Node:
    """Bulk load: entries go to the nearest of a few routing vectors, level by level, down to pages."""
    own = points[members]
    router = own.mean(0)
    far = _distances(own, router)
    if len(members) <= page:
        return Node(router, float(far.max(initial=0)), far, members=members)
    seeds = own[_farthest(own, fanout)]
    if len(seeds) == 1:
        groups = np.arange(len(members)) // page  # all equal
    else:
        groups = ((own[:, None, :] - seeds[None]) ** 2).sum(2).argmin(1)
    children = [build(points, members[groups == g], page, fanout) for g in np.unique(groups)]
    radius = float(far.max(initial=0))
    return Node(router, radius, np.array([float(_distances(c.router[None], router)[0]) for c in children]), children=children)


class Tree:
    """One shard's M-tree over integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT, unit: int = 1):
        """`unit` is 1 for components up to `exact.SMALL`; above it the largest component of vectors and queries, which are then Python integers."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.unit = ids[order], vectors[order], unit
        norms = (self.vectors**2).sum(1)
        self.most = int(norms.max()) if len(norms) else 0
        # The difference is an exact integer, so a small root has small errors too.
        self.points = np.concatenate([self._scaled(self.vectors, unit), np.sqrt(self._scaled(self.most - norms, unit * unit))[:, None]], axis=1)
        self.root = build(self.points, np.arange(len(ids)), page, fanout) if len(ids) else None
        self.computed = 0

    @staticmethod
    def _scaled(values: np.ndarray, unit: int) -> np.ndarray:
        """Integers over `unit` as doubles."""
        if values.dtype != object:
            return values.astype(np.float64) / unit
        return np.array([v / unit for v in values.ravel()], dtype=np.float64).reshape(values.shape)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, place of the vector, score) of the k best of each query, its own id left out."""
        n, wide = len(queries), 1 << max(1, len(self.ids)).bit_length()
        square = self.unit * self.unit
        base = self._scaled((queries**2).sum(1) + self.most, square)
        extended = np.concatenate([self._scaled(queries, self.unit), np.zeros((n, 1))], axis=1)
        # A score and a place as one number: the higher score first, of equal ones the smaller place, so the smaller id.
        wide_numbers = queries.dtype == object
        none = -(self.unit**2 * (wide << 12) * max(1, queries.shape[1])) if wide_numbers else NONE
        best = np.full((n, k), none, dtype=queries.dtype)
        # A query needs what is nearer than its k-th best so far; equal scores may still win by their id.
        reach = np.full(n, np.inf)
        serial, heap = 0, []
        if self.root is not None:
            heap.append((0.0, 0, self.root, np.arange(n), _distances(extended, self.root.router)))
        while heap:
            _, _, node, rows, to_router = heapq.heappop(heap)
            needed = to_router - node.radius <= reach[rows] + SLACK
            rows, to_router = rows[needed], to_router[needed]
            if not len(rows):
                continue
            # |d(q, router) - d(entry, router)| bounds d(q, entry) from below.
            low = np.abs(to_router[:, None] - node.far[None, :])
            if node.children is not None:
                for i, child in enumerate(node.children):
                    may = low[:, i] - child.radius <= reach[rows] + SLACK
                    if may.any():
                        distance = _distances(extended[rows[may]], child.router)
                        near = distance - child.radius <= reach[rows[may]] + SLACK
                        if near.any():
                            serial += 1
                            bound = float((distance - child.radius)[near].min())
                            heapq.heappush(heap, (bound, serial, child, rows[may][near], distance[near]))
                continue
            members = node.members[(low <= reach[rows][:, None] + SLACK).any(0)]
            if not len(members):
                continue
            # Doubles hold integers of this size exactly.
            if wide_numbers:
                product = queries[rows] @ self.vectors[members].T
            else:
                product = (queries[rows].astype(np.float64) @ self.vectors[members].astype(np.float64).T).astype(np.int64)
            self.computed += product.size
            keys = product * wide - members[None, :]
            keys[query_ids[rows][:, None] == self.ids[members][None, :]] = none
            better = (keys > best[rows, k - 1][:, None]).any(1)
            rows = rows[better]
            if len(rows):
                every = np.concatenate([best[rows], keys[better]], axis=1)
                highest = np.sort(every, axis=1) if wide_numbers else np.partition(every, every.shape[1] - k, axis=1)
                best[rows] = -np.sort(-highest[:, -k:], axis=1)
                worst = best[rows, k - 1]
                score = self._scaled(-(-worst // wide), square)
                reach[rows] = np.where(worst > none, np.sqrt(np.maximum(base[rows] - 2.0 * score, 0)), np.inf)
        row, rank = np.nonzero(best > none)
        key = best[row, rank]
        return row, -key % wide, -(-key // wide)


def _search_shard(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64"), "wide": pd.Series(dtype=object)})
        if not len(vectors) or not len(queries):
            return empty
        out = []
        own, asked = (exact.floors(np.stack(x["vector"].to_numpy()), 1) for x in (vectors, queries))
        ids = vectors["vec_id"].to_numpy(dtype=np.int64)
        asked_ids = queries["vec_id"].to_numpy(dtype=np.int64)
        largest = max(int(np.abs(x).max(initial=0)) for x in (own, asked))
        unit = 1 if largest <= exact.SMALL else largest
        if unit > 1:
            own, asked = own.astype(object), asked.astype(object)
        tree = Tree(ids, own, unit=unit)
        # Queries that lie together go down together.
        near = len(asked) * FANOUT * own.shape[1] < 1 << 26
        plain = tree.points[:, :-1]
        groups = np.argmin(((Tree._scaled(asked, unit)[:, None, :] - plain[_farthest(plain, FANOUT)][None]) ** 2).sum(2), axis=1) if near else np.zeros(len(asked))
        order = np.argsort(groups, kind="stable")
        for start in range(0, len(order), BLOCK):
            part = order[start : start + BLOCK]
            row, place, score = tree.search(asked_ids[part], asked[part], k)
            small, wide = exact.longs(score)
            place = np.asarray(place, dtype=np.int64)
            out.append(pd.DataFrame({"query_id": asked_ids[part][row], "vec_id": tree.ids[place], "score": small.to_numpy(zero_copy_only=False), "wide": wide.to_pylist()}))
        return pd.concat(out) if out else empty

    return search


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), taken and returned as a double; null where a component is null, NaN or infinite.

    From 2^53 on every double is an integer. A product beyond all doubles counts as the largest of its sign.
    """
    numbers = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = float(np.finfo(np.float64).max)
    bounded = lambda x: F.greatest(F.least(x * float(scale), F.lit(largest)), F.lit(-largest))
    # Plus zero, so that no -0.0 makes two rows of one vector.
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    return F.when(sound, F.transform(numbers, lambda x: whole(bounded(x)) + 0.0))


def top_k(
    vectors: DataFrame,
    queries: Column | None = None,
    k: int = K,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row, ties to the smaller id.

    `queries` marks the rows that are asked (default: ids divisible by 20). A query's own id is no candidate.
    Rows with a null id or vector, or with a null or non-finite component, take no part; nor do
    vectors without components. Vectors of another length than the query's are no candidates. A repeated row
    is one candidate. Fewer than k candidates give fewer ranks, an empty table none. Scores are exact at any size of the components,
    and one that does not fit a long is returned as null in its place. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    plain = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), quantized(F.col(embedding)).alias("vector"))
    sound = plain.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).distinct()
    sound = sound.withColumn("width", F.size("vector"))
    asked = sound.where(F.col("vec_id") % 20 == 0 if queries is None else queries)
    rows, wanted = sound.count(), asked.count()
    shards, parts = max(1, -(-rows // SHARD_VECTORS)), max(1, -(-wanted // SHARD_QUERIES))
    # Each query visits every shard; each shard is copied once for each part of the queries.
    left = sound.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("bigint"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    )
    keys = ("shard", "part", "width")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_shard(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(*exact.by_value(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("wide").isNull(), F.col("score")).alias("score"))
