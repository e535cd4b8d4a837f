"""Near-duplicates by SimHash: 64-bit fingerprints, a binary trie self-join, connected components.

Texts never move: they are fingerprinted where they are read, and only (id, fingerprint) rows travel.
Equal fingerprints are one node. Two fingerprints with at most `budget` differing bits agree on at least
`parts - budget` of `parts` bit ranges, so distinct fingerprints are dealt by every choice of that many
ranges; in each group a binary trie is joined with itself: pairs of nodes go down together, differing bits
add up, and a pair over the budget is dropped with all below it. A group keeps one link for each fingerprint
that it joins to others, not all pairs. A fingerprint has at most sum(C(64, i), i <= budget)
neighbours, 2,080 for two bits, so the work of a group then grows with its distinct fingerprints and not with their
square. A larger budget needs more ranges, C(parts, budget) copies of each distinct fingerprint, and loses that bound
within one very large group of slightly different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ship, whole_text

BITS = 64
WORDS = 3
BUDGET = 2
SEED = 42
#: Bit ranges that distinct fingerprints are dealt by.
PARTS = 4
#: Fingerprints whose tries are joined at once; a larger group is held whole.
BUFFER_ROWS = 1 << 20
#: Pairs of trie nodes that are held at once.
FRONTIER = 1 << 20
#: Bytes of shingle bits that are counted at once.
SLICE_SHINGLES = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the shingles of a text: a bit is set if more than half of all shingle hashes have it.

    A-Z count as a-z, words end at ASCII white space, repeated shingles count each time. A text with fewer
    words is one shingle; a text without words has fingerprint zero.
    """
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.array([len(w) + 1 for w in found])) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(found)) - 1 :]
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, count, SLICE_SHINGLES):
        spans = zip(starts[i : min(count, i + SLICE_SHINGLES)].tolist(), last[i : i + SLICE_SHINGLES].tolist(), strict=True)
        total += set_bits(np.array([digest(line[a:b], seed) for a, b in spans], dtype="<u8"))
    return majority(total, count)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, count: int) -> int:
    """The fingerprint: bits set in more than half of `count` hashes."""
    return int(np.packbits((2 * total > count).astype(np.uint8), bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of shingles that are hashed already; of none, zero."""
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), SLICE_SHINGLES):
        total += set_bits(hashes[i : i + SLICE_SHINGLES].astype("<u8", copy=False))
    return majority(total, len(hashes))


def fingerprints(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """Fingerprint of a binary column as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            numbers = np.array([fingerprint(t, words, seed) for t in part], dtype=np.uint64)
            yield pd.Series(numbers.view(np.int64))

    return each(text)


def ranges(parts: int = PARTS) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of `parts` ranges that cover all bits."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def trie_links(values: np.ndarray, budget: int, start: np.ndarray, end: np.ndarray, bit: int = BITS - 1) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of `trie_pairs` at once, for small groups."""
    found = list(trie_pairs(values, budget, start, end, bit))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))


def trie_roots(values: np.ndarray, budget: int, start: np.ndarray, end: np.ndarray, bit: int = BITS - 1) -> np.ndarray:
    """Least member of each value's component over the pairs of `trie_pairs`.

    Each piece of pairs is folded into the components so far and dropped, so memory follows the number of values and not that of
    their pairs: a family of n values that are all alike has n * n / 2 of these.
    """
    label = np.arange(len(values))
    for a, b in trie_pairs(values, budget, start, end, bit):
        a, b = label[a], label[b]
        apart = a != b
        if apart.any():
            # The pairs are between roots now; what pointed to a root follows it.
            label = roots(len(values), a[apart], b[apart])[label]
    return label


def trie_pairs(
    values: np.ndarray, budget: int, start: np.ndarray, end: np.ndarray, bit: int = BITS - 1
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with i < j of distinct unsigned values in one of the tries, that differ in 1 to `budget` bits, in pieces.

    A trie node is a range of the sorted `values` whose upper bits are equal; `start` and `end` are the
    tries' roots, `bit` the first bit below them. The work list is a stack of pieces of at most FRONTIER node pairs, looked at depth
    first: each of the bits leaves a few pieces on it, so it is bounded by their number and not by that of the pairs.
    """
    # Node pairs: two ranges, differing bits so far, the bit to look at next.
    work = [(start, end, start, end, np.zeros(len(start), dtype=np.int8), bit)]
    while work:
        a0, a1, b0, b1, wrong, bit = work.pop()
        keep = (a0 < a1) & (b0 < b1) & (wrong <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, wrong = a0[keep], a1[keep], b0[keep], b1[keep], wrong[keep]
        if not len(a0):
            continue
        if bit < 0:
            yield a0, b0
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            # Two leaves: count the bits that are left at once.
            x, y = a0[single], b0[single]
            near = np.bitwise_count(values[x] ^ values[y]) <= budget
            if near.any():
                yield x[near], y[near]
            a0, a1, b0, b1, wrong = a0[~single], a1[~single], b0[~single], b1[~single], wrong[~single]
            if not len(a0):
                continue
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        other = ~same
        more = (wrong + 1).astype(np.int8)
        pairs = (
            (a0, am, b0, bm, wrong),
            (am, a1, bm, b1, wrong),
            (a0, am, bm, b1, more),
            (am[other], a1[other], b0[other], bm[other], more[other]),
        )
        stacked = [np.concatenate([p[k] for p in pairs]) for k in range(5)]
        for i in range(0, len(stacked[0]), FRONTIER):
            work.append((*(s[i : i + FRONTIER] for s in stacked), bit - 1))


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the values of each range get this bit set; above it they are all equal."""
    upper = (values[low] >> np.uint64(bit)) | np.uint64(1)
    at = np.searchsorted(values, upper << np.uint64(bit), side="left")
    return np.clip(at, low, high)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component; labels fall along links until none changes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _link_runs(budget: int, free_bits: int):
    """Self-joins all tries of a partition whose rows come sorted by table and moved value."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def join(rows: np.ndarray) -> pa.RecordBatch:
            # A group is a node of the trie of moved values: all its upper bits are equal.
            keys = rows[1] >> np.uint64(free_bits)
            start = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[0, 1:] != rows[0, :-1]))))
            ends = np.append(start[1:], rows.shape[1])
            more = ends - start > 1
            label = np.arange(rows.shape[1])
            for table in np.unique(rows[0]):
                low, high = np.searchsorted(rows[0], [table, table + np.uint64(1)])
                own = more & (start >= low) & (start < high)
                label[low:high] = low + trie_roots(rows[1, low:high], budget, start[own] - low, ends[own] - low, free_bits - 1)
            signed = rows[2].view(np.int64)
            # The least fingerprint stands for its component, whatever table found it, so links repeat and merge.
            least = np.full(len(label), np.iinfo(np.int64).max)
            np.minimum.at(least, label, signed)
            linked = np.flatnonzero(signed != least[label])
            return pa.RecordBatch.from_pydict({"a": signed[linked], "b": least[label[linked]]})

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            # The sign bit is turned, so that Spark's order is that of unsigned numbers.
            moved = columns[1].view(np.uint64) ^ np.uint64(1 << 63)
            held.append(np.stack([columns[0].astype(np.uint64), moved, columns[2].view(np.uint64)]))
            if sum(h.shape[1] for h in held) >= BUFFER_ROWS:
                rows = np.concatenate(held, axis=1)
                last = (rows[1] >> np.uint64(free_bits) == rows[1, -1] >> np.uint64(free_bits)) & (rows[0] == rows[0, -1])
                first = int(np.flatnonzero(last)[0])
                held = [rows[:, first:]]
                if first:
                    yield join(rows[:, :first])
        if held:
            yield join(np.concatenate(held, axis=1))

    return link


def links(distinct: DataFrame, budget: int = BUDGET, parts: int = PARTS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` within `budget` bits into their components."""
    if not 0 < budget < parts:
        raise ValueError("there must be more bit ranges than bits that may differ")
    every, choices = ranges(parts), list(combinations(range(parts), parts - budget))
    free = max(BITS - sum(every[i][1] for i in chosen) for chosen in choices)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for table, chosen in enumerate(choices):
                # The chosen ranges go to the top, the others below them; the sign bit is turned for Spark's order.
                at, moved = BITS, np.full(len(values), 1 << 63, dtype=np.uint64)
                for i in [*chosen, *(i for i in range(parts) if i not in chosen)]:
                    low, size = every[i]
                    at -= size
                    piece = (values.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << size) - 1)
                    moved ^= piece << np.uint64(at)
                number = np.full(len(values), table, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"table": number, "moved": moved.view(np.int64), "fp": values})

    dealt = distinct.select("fp").mapInArrow(deal, "table int, moved bigint, fp bigint")
    near = dealt.repartition("table", F.shiftrightunsigned("moved", free)).sortWithinPartitions("table", "moved")
    return near.mapInArrow(_link_runs(budget, free), "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of every node that has a link.

    Alternating steps: each node's larger neighbours, then its smaller ones, are tied to the least of them. Every
    round is written to the shared folder; the rounds needed grow with the logarithm of a component.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        after = materialize(small, "edges")
        moved = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if moved:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def group(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    budget: int = BUDGET,
    parts: int = PARTS,
) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id.

    `component_id` is the least id that can be reached over links of at most `budget` bits. A null or blank text has
    fingerprint zero and links like any other. Repeated rows give a row each. A null id is kept and never names a
    component unless all ids of it are null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    marked = materialize(plain.select("doc_id", fingerprints(F.col("text"), words).alias("fp")), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), budget, parts))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
