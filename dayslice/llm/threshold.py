"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Candidates lie in shards. A shard keeps, for each dimension, its vectors in the order of that component. An anchor reads
the list of every dimension from the end its own sign prefers; whatever appears is scored at once by random access, in integers. After
depth t no unseen vector can score more than the anchor's product with the t-th components (the threshold), so the anchor stops as soon as
the threshold is strictly below what each of its windows still needs: its k-th score, or the window's lower end.

First the positives: shards hold one label, and an anchor visits those of its own. Their lists are merged into the best
few, which give the score windows. Then the negatives: vectors are dealt to the nearest of a few routing vectors, cells cut into shards, and an
anchor travels only to cells whose box of components reaches its lowest window. The shards' lists are merged by a rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import exact
from .common import ship

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative: LOW * positive <= BASE * negative <= HIGH * positive.
LOW, HIGH, BASE = 30, 90, 100
SHARD_VECTORS = 8192
SHARD_ANCHORS = 16_384
#: Routing vectors, the rows of least hash: a bounded sample. Cells only decide which shards can be left out.
CELLS = 64
#: Rows read of each list in the first step; each step doubles the depth.
DEPTH = 64
STORED = "vec_id bigint, label string, width int, embedding array<double>, cell int"
#: `asker` names an anchor's row, `nth` one of its positives.
PAIRS = "asker bigint, vec_id bigint, score bigint, wide binary"
HITS = "asker bigint, nth int, vec_id bigint, score bigint, wide binary"


class Lists:
    """One shard's vectors, and for each dimension their places in ascending order of the component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.order, self.ids, self.vectors = order, ids[order], vectors[order]
        self.sorted = np.argsort(self.vectors, axis=0, kind="stable").T.copy() if len(ids) else np.zeros((vectors.shape[1], 0), np.int64)
        self.read = 0

    def steps(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(new places, their scores, threshold of what is still unseen) after each deepening, until all is seen.

        The anchor and the vectors are of one kind, as `exact.alike` gives them.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, dtype=bool)
        start, depth = 0, DEPTH
        while start < n:
            end = min(n, depth)
            now = np.zeros(n, dtype=bool)
            now[self.sorted[up, n - end : n - start]] = True
            now[self.sorted[down, start:end]] = True
            if not len(up) and not len(down):
                now[start:end] = True  # an anchor of zeros: every score is zero
            fresh = np.flatnonzero(now & ~seen)
            seen |= now
            self.read += len(fresh)
            last = np.zeros_like(anchor)
            last[up] = self.vectors[self.sorted[up, n - end], up]
            last[down] = self.vectors[self.sorted[down, end - 1], down]
            yield fresh, exact.products(self.vectors[fresh], anchor), int((last * anchor).sum())
            start, depth = end, depth * 2


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), dtype=np.int64)
    return ids[order[:k]], scores[order[:k]]


def top(lists: Lists, anchor: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best products with the anchor, `skip` left out."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, lists.vectors.dtype)
    for fresh, found, threshold in lists.steps(anchor):
        own = lists.ids[fresh] != skip if skip is not None else np.ones(len(fresh), bool)
        ids, scores = _best(np.concatenate([ids, lists.ids[fresh[own]]]), np.concatenate([scores, found[own]]), k)
        if len(ids) == k and threshold < scores[-1]:
            break
    return ids, scores


def windows(lists: Lists, anchor: np.ndarray, able: np.ndarray, bounds: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best able vectors with a score inside each of the bounds (ends included)."""
    kept = [(np.zeros(0, np.int64), np.zeros(0, lists.vectors.dtype))] * len(bounds)
    for fresh, found, threshold in lists.steps(anchor):
        good = able[fresh]
        ids, scores = lists.ids[fresh[good]], found[good]
        needed = []
        for i, (low, high) in enumerate(bounds):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                kept[i] = _best(np.concatenate([kept[i][0], ids[inside]]), np.concatenate([kept[i][1], scores[inside]]), k)
            if low <= high:
                needed.append(int(kept[i][1][-1]) if len(kept[i][0]) == k else low)
        if all(threshold < need for need in needed):
            break
    return kept


def score_window(positive: int, low: int = LOW, high: int = HIGH, base: int = BASE) -> tuple[int, int]:
    """Least and greatest integer score n with low * positive <= base * n <= high * positive."""
    return -(-low * positive // base), high * positive // base


def _kept(batches: Iterator[pa.RecordBatch], scale: int, routers: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sound rows with their floors and the nearest routing vector of their width; `routers` by width."""
    for batch in batches:
        part = pa.concat_arrays([batch.column(2)])
        widths = np.diff(part.offsets.to_numpy())
        for width in np.unique(widths[widths > 0]).tolist():
            at, matrix = exact.sound_matrix(part, width)
            for start in range(0, len(at), 1024):
                rows, whole = pa.array(at[start : start + 1024]), exact.floors(matrix[start : start + 1024], scale)
                points, near = whole.astype(np.float64), routers.get(width)
                cell = np.zeros(len(points), np.int32)
                if near is not None:
                    with np.errstate(over="ignore", invalid="ignore"):
                        gaps = (near * near).sum(1)[None, :] - 2.0 * (points @ near.T)
                    cell = np.nan_to_num(gaps, nan=np.inf).argmin(1).astype(np.int32)
                ends = pa.array(np.arange(len(points) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(points), width, np.int32)), pa.ListArray.from_arrays(ends, pa.array(points.ravel())), pa.array(cell)],
                    names=["vec_id", "label", "width", "embedding", "cell"],
                )


def _width(part: pa.Table) -> int:
    return int(part.column("width")[0].as_py())


def _matrix(part: pa.Table) -> np.ndarray:
    values = pa.concat_arrays(part.column("embedding").chunks).flatten()
    return exact.floors(values.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), 1)


def _scored(found: list[tuple[list, np.ndarray, np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """Rows (values of the first columns, ids, scores) as a table of those columns, vec_id, score and wide."""
    schema = pa.schema([*zip(names, kinds, strict=True), ("vec_id", pa.int64()), ("score", pa.int64()), ("wide", pa.binary())])
    tables = []
    for values, ids, scores in found:
        if len(ids):
            same = [pa.array([v] * len(ids), kind) for v, kind in zip(values, kinds, strict=True)]
            tables.append(pa.table([*same, pa.array(ids, pa.int64()), *exact.longs(scores)], schema=schema))
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _positives(k: int):
    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            vectors, anchors = exact.alike(_matrix(own), _matrix(asked), terms=_width(own))
            lists = Lists(own.column("vec_id").to_numpy(), vectors)
            for asker, own_id, anchor in zip(asked.column("asker").to_pylist(), asked.column("vec_id").to_pylist(), anchors, strict=True):
                found.append(([asker], *top(lists, anchor, k, own_id)))
        return _scored(found, ["asker"], [pa.int64()])

    return run


def _negatives(k: int, window: tuple[int, int, int]):
    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            vectors, anchors = exact.alike(_matrix(own), _matrix(asked), terms=_width(own))
            lists = Lists(own.column("vec_id").to_numpy(), vectors)
            numbers: dict[str, int] = {}
            kinds = np.array([numbers.setdefault(x, len(numbers)) for x in own.column("label").to_pylist()])[lists.order]
            for row, anchor in zip(asked.select(["asker", "label", "positives"]).to_pylist(), anchors, strict=True):
                bounds = [score_window(exact.value_of(p["score"], p["wide"]), *window) for p in row["positives"]]
                kept = windows(lists, anchor, kinds != numbers.get(row["label"], -1), bounds, k)
                found += [([row["asker"], nth], ids, scores) for nth, (ids, scores) in enumerate(kept)]
        return _scored(found, ["asker", "nth"], [pa.int64(), pa.int32()])

    return run


def _reached(boxes: dict[int, list[tuple[int, list[float], list[float]]]], window: tuple[int, int, int]):
    """Of each anchor, the cells with a vector that may reach its lowest window: the threshold before anything is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for i, row in enumerate(batch.select(["embedding", "width", "positives"]).to_pylist()):
                anchor = exact.floors(np.array(row["embedding"]), 1)
                bounds = [score_window(exact.value_of(p["score"], p["wide"]), *window) for p in row["positives"]]
                least = [low for low, high in bounds if low <= high]
                for cell, low, high in boxes.get(row["width"], []) if least else []:
                    a, b = exact.alike(anchor, exact.floors(np.array([low, high]), 1), terms=row["width"])
                    if int(np.where(a > 0, a * b[1], a * b[0]).sum()) >= min(least):
                        at.append(i)
                        cells.append(cell)
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the least and greatest components of each cell."""
    least: dict[tuple[int, int], np.ndarray] = {}
    most: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        widths, cells = table.column("width").to_numpy(), table.column("cell").to_numpy()
        for width, cell in np.unique(np.stack([widths, cells]), axis=1).T.tolist():
            part = table.filter(pa.array((widths == width) & (cells == cell)))
            points = pa.concat_arrays(part.column("embedding").chunks).flatten().to_numpy().reshape(-1, width)
            key = (width, cell)
            least[key] = np.minimum(least.get(key, np.inf), points.min(0))
            most[key] = np.maximum(most.get(key, -np.inf), points.max(0))
    rows = [(w, c, i, a, b) for w, c in least for i, (a, b) in enumerate(zip(least[w, c].tolist(), most[w, c].tolist(), strict=True))]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["width", "cell", "place", "low", "high"])


def _parts(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    return counts.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("count") / F.lit(most))).cast("int").alias("parts"))


def _part(of: str, parts: Column, seed: int = 7) -> Column:
    return F.pmod(F.xxhash64(F.col(of), F.lit(seed)), parts.cast("bigint")).cast("int")


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
    window: tuple[int, int, int] = (LOW, HIGH, BASE),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives of each anchor and positive.

    `anchors` marks the rows that ask, by vec_id and label. Each component counts as floor(scale * x); a score is the integer inner product with
    the anchor. Its positives are the best other rows of its label; negatives are the best rows of other labels whose
    score lies in the window (low, high, base) of the positive's score. Ties go to the smaller vec_id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors without components. Vectors
    of another length than the anchor's are no candidates. A repeated row (id, label and vector alike) counts once; one id on
    several labels or vectors counts as several candidates, and each anchor row asks with its own label and vector and is no positive of its own id.
    No positive, or no score in a window, gives no row; so does an empty table. Scores are exact at any size, and one that
    does not fit a long is returned as null in its place. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    size = F.size("embedding")
    # Widths of few rows are one cell; of the others the rows of least hash route.
    large = [r.width for r in plain.groupBy(size.alias("width")).count().where((F.col("count") > SHARD_VECTORS) & (F.col("width") > 0)).collect()]
    near: dict[int, np.ndarray] = {}
    for width in large:
        least = plain.where(size == width).mapInArrow(lambda b: _kept(b, scale, {}), STORED).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(CELLS)
        near[width] = np.unique(np.array([r.embedding for r in least.select("embedding").collect()]).reshape(-1, width), axis=0)
    near = {width: rows for width, rows in near.items() if len(rows)}
    stored = plain.mapInArrow(lambda b: _kept(b, scale, near), STORED).distinct()
    stored = materialize(stored.withColumn("asker", F.xxhash64("vec_id", "label", "embedding")), "negative-candidates")
    asked = stored.where(anchors)

    def shards(keys: list[str], right: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
        """`run` on each shard of candidates with the anchors that visit it; groups of one key are cut by hashes of ids."""
        own = _parts(stored.groupBy(*keys).count(), keys, SHARD_VECTORS)
        asking = _parts(right.groupBy(*keys).count(), keys, SHARD_ANCHORS).withColumnRenamed("parts", "blocks")
        sizes = own.join(asking, keys)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = stored.join(sizes, keys).withColumn("part", _part("vec_id", F.col("parts"))).withColumn("block", every("blocks"))
        y = right.join(sizes, keys).withColumn("block", _part("asker", F.col("blocks"), 11)).withColumn("part", every("parts"))
        group, base = [*keys, "part", "block"], ["vec_id", "label", "width", "embedding"]
        # New names of the same columns: both sides come from one table.
        x = x.select(*(F.col(c).alias(c) for c in dict.fromkeys([*group, *base])))
        y = y.select(*(F.col(c).alias(c) for c in dict.fromkeys([*group, *base, *columns])))
        return x.groupBy(*group).cogroup(y.groupBy(*group)).applyInArrow(run, schema)

    found = shards(["label", "width"], asked, ["asker"], _positives(positives), PAIRS)
    place = F.row_number().over(Window.partitionBy("asker").orderBy(*exact.by_value(), "vec_id"))
    ranked = found.withColumn("nth", place - 1).where(F.col("nth") < positives)
    listed = ranked.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "wide"))).alias("positives"))
    asking = materialize(asked.drop("cell").join(listed, "asker"), "anchors")

    limits = stored.where(F.col("width").isin(list(near))).mapInArrow(_box, "width int, cell int, place int, low double, high double")
    boxes: dict[int, list] = {}
    sides = limits.groupBy("width", "cell", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sides = sides.groupBy("width", "cell").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("sides"))
    for row in sides.collect():  # at most CELLS for each width of many rows
        boxes.setdefault(row.width, []).append((row.cell, [x.low for x in row.sides], [x.high for x in row.sides]))
    inside = asking.where(F.col("width").isin(list(boxes))).mapInArrow(_reached(boxes, window), f"{asking._jdf.schema().toDDL()}, cell int")
    targets = inside.union(asking.where(~F.col("width").isin(list(boxes))).withColumn("cell", F.lit(0)))
    hits = shards(["width", "cell"], targets, ["asker", "positives"], _negatives(negatives, window), HITS)
    rank = F.row_number().over(Window.partitionBy("asker", "nth").orderBy(*exact.by_value(), "vec_id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = best.join(asking.select("asker", F.col("vec_id").alias("anchor_id"), "positives"), "asker")
    positive = F.col("positives")[F.col("nth")]
    plainly = lambda score, wide: F.when(wide.isNull(), score)
    return named.select(
        "anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        plainly(positive["score"], positive["wide"]).alias("positive_score"), plainly(F.col("score"), F.col("wide")).alias("negative_score"),
    )
