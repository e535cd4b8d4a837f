"""Near copies by SimHash, checked by the exact Jaccard similarity of word shingles, and an exact way for the rest: a prefix join.

SimHash comes first: the fingerprint of every set of shingles goes through the trie search of `simhash`, and each set meets the one that stands for
its group of fingerprints. Similar sets whose fingerprints differ in more bits than the search allows are the rest (at a similarity of 0.8 most
are): a prefix join finds them, so none is lost. All that meet are checked on the whole sets.

Two sets with similarity of at least t share ceil(t * n) members of either, so under any one order of all shingles the first
n - ceil(t * n) + 1 of both share a member: a join of these prefixes misses no pair. Frequent shingles, found in
a sample of texts, come last in the order; that only saves work. Texts with one set of shingles are one node.

Candidates are checked in two rounds. First come those of SimHash, and each node meets the least node of each shingle's group and the one
before it, which is linear in the prefixes and joins families of near copies. Then all pairs of a group that are still in different
components and whose sizes and parities allow the similarity are checked, so no link is left out that could join two components. Sets
are made again from the texts of candidates only.

The parity of a set has one bit for each of PARITIES * 64 classes of shingles: whether it holds an odd number of them. Where two
parities differ, at least one member of that class is in one set alone, so differing bits bound the difference of two sets from below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import ship, slices, whole_text
from .simhash import SEED, SLICE_SHINGLES, components, links, of_hashes

WORDS = 5
#: Least similarity, as a fraction of whole numbers, so that no rounding decides.
OVER, UNDER = 4, 5
#: Frequent shingles are those of several texts in a sample of one text in SAMPLED; at most so many are broadcast.
SAMPLED, LEAST_TEXTS, FREQUENT = 16, 3, 1 << 16
#: Columns of 64 bits in a set's parity. More bits keep the bound useful for longer texts.
PARITIES = 8
PARITY = [f"parity_{i}" for i in range(PARITIES)]
#: What is left of a component is ended in one task up to so many sets with so many members; more goes another round.
GREEDY_NODES, GREEDY_MEMBERS = 10_000, 1 << 21


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the shingles of a text in ascending order; words as `simhash.fingerprint` has them."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.int64)
    line = b" ".join(found)
    ends = np.cumsum(np.array([len(w) + 1 for w in found])) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(found)) - 1 :]
    parts = []
    for i in range(0, count, SLICE_SHINGLES):
        spans = zip(starts[i : min(count, i + SLICE_SHINGLES)].tolist(), last[i : i + SLICE_SHINGLES].tolist(), strict=True)
        parts.append(np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64))
    return np.unique(np.concatenate(parts).view(np.int64))


def node_of(hashes: np.ndarray) -> int:
    """64-bit name of a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parity of a set of shingles as PARITIES numbers of 64 bits."""
    odd = np.bincount(hashes & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        found = [shingles(t) for t in rows["text"]]
        yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(f) for f in found], pa.int64()), "members": _lists(found)})


def _prefixes(frequent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place = frequent.value
        for rows in slices(batches, "text"):
            found = [shingles(t) for t in rows["text"]]
            first = []
            for own in found:
                length = len(own) - -(-OVER * len(own) // UNDER) + 1 if len(own) else 0
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    late = names[at] == own
                    own = np.concatenate((own[~late], own[late][np.argsort(place[at[late]])]))
                first.append(own[:length])
            bits = np.array([parity(f) for f in found], dtype=np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(rows["doc_id"], pa.int64()),
                    "mark": pa.array(rows["mark"], pa.int64()),
                    "node": pa.array([node_of(f) for f in found], pa.int64()),
                    "size": pa.array([len(f) for f in found], pa.int32()),
                    "fp": pa.array(np.array([of_hashes(f.view(np.uint64)) for f in found], dtype=np.uint64).view(np.int64)),
                    "first": _lists(first),
                    **{name: pa.array(bits[:, i].copy(), pa.int64()) for i, name in enumerate(PARITY)},
                }
            )

    return run


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order, and the place of each in the order of their counts; at most FREQUENT."""
    sample = texts.where(F.pmod("mark", F.lit(SAMPLED)) == 0).select("text").mapInArrow(_sets, "node bigint, members array<bigint>")
    counts = sample.select(F.explode("members").alias("h")).groupBy("h").count().where(F.col("count") >= LEAST_TEXTS)
    names = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow().column("h").to_numpy()
    order = np.argsort(names)
    return names[order], len(names) - order


def _rest(size: Column, over: int, under: int) -> Column:
    """Members of a set behind a prefix of size - ceil(over / under * size) + 1."""
    return F.floor((size * over + under - 1) / under) - 1


def _able(rows: DataFrame, behind: Column) -> DataFrame:
    """Of rows (a, b, size_a, size_b), one for each shared member of two prefixes, the pairs that may be similar enough.

    All that two prefixes share is counted; `behind` bounds what is shared after the prefix that ends first in the order.
    """
    sizes = F.col("size_a") + F.col("size_b")
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return counted.where((OVER + UNDER) * (F.col("n") + behind) >= OVER * sizes).select("a", "b")


def _parity_allows() -> Column:
    """Whether the parities of x and y differ in no more bits than similar sets of these sizes have differing members."""
    differing = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITY))
    return (OVER + UNDER) * differing <= (UNDER - OVER) * (F.col("size_x") + F.col("size_y"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (x, y, size_x, size_y) as (a, b, size_a, size_b), the least node first."""
    turned = F.col("x") > F.col("y")
    pick = lambda n, m: F.when(turned, F.col(m)).otherwise(F.col(n))
    return rows.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("size_x", "size_y").alias("size_a"), pick("size_y", "size_x").alias("size_b"))


def _members(needed: DataFrame, nodes: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """Written (node, members) of the given nodes, each from the one row that stands for it."""
    rows = nodes.join(needed, "node", "left_semi").select("jid", "mark")
    # By id and mark, so that the copies of a text are spread and no other copy's text goes on.
    found = texts.join(rows, ["jid", "mark"], "left_semi").select("text")
    return materialize(found.mapInArrow(_sets, "node bigint, members array<bigint>").dropDuplicates(["node"]), label)


def _checked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough; only texts of the pairs are read as sets again."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _members(needed, nodes, texts, "sets")
    left, right = (sets.select(F.col("node").alias(n), F.col("members").alias(f"of_{n}")) for n in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    total = F.size("of_a") + F.size("of_b") - F.col("shared")
    return materialize(both.where(UNDER * F.col("shared") >= OVER * total).select("a", "b"), "links")


def mark_of(text: str = "text") -> Column:
    """64-bit name of a text; a null counts as empty."""
    return F.xxhash64(whole_text(text).cast("binary"))


def _plain(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    return own.withColumns({"mark": F.xxhash64("text"), "jid": F.coalesce("doc_id", F.lit(-(1 << 63)))})


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), the least node first, that SimHash finds among rows (node, size, fp) and whose sizes allow the similarity.

    Fingerprints are joined into groups by the search of `simhash`, within its bits; of each fingerprint, and of each group, one node stands
    for it and meets the others, so the pairs are no more than twice the nodes.
    """
    named = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("own"))
    near = links(named.select("fp"))
    least = F.col("own")
    same = nodes.join(named, "fp").select(F.col("node").alias("x"), F.col("size").alias("size_x"), least.getField("node").alias("y"), least.getField("size").alias("size_y"))
    ends = [named.select(F.col("fp").alias(c), least.getField("node").alias(n), least.getField("size").alias(f"size_{n}")) for c, n in (("a", "x"), ("b", "y"))]
    between = near.join(ends[0], "a").join(ends[1], "b").select("x", "size_x", "y", "size_y")
    sizes = (UNDER * F.least("size_a", "size_b")) >= OVER * F.greatest("size_a", "size_b")
    return _in_order(same.union(between).where("x <> y")).where(sizes).select("a", "b").distinct()


def _linked(plain: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, mark, node) of each text, (node, size, least id, and jid and mark of the row that stands for it), (node, root) of linked nodes."""
    spark = plain.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(plain))
    schema = "doc_id bigint, mark bigint, node bigint, size int, fp bigint, first array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITY)
    marked = materialize(plain.select("doc_id", "mark", "text").mapInArrow(_prefixes(frequent), schema), "prefixes")
    # The row of the least id stands for a node; rows without an id come last, of one id the least mark first.
    row = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("jid"), "mark")
    nodes = marked.groupBy("node").agg(F.min(row).alias("row"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "fp", *PARITY)))
    nodes = materialize(nodes.select("node", "least", "size", "fp", "row.jid", "row.mark", *PARITY), "nodes")
    # Repeated sets have one prefix; only rows of the chosen mark carry it on.
    single = marked.join(nodes.select("node", "mark"), ["node", "mark"], "left_semi").dropDuplicates(["node"])
    placed = Window.partitionBy("h").orderBy("size", "node")
    postings = single.select("node", "size", F.posexplode("first").alias("place", "h"))
    # The smaller of two similar sets shares more than the larger must: at least 2t / (1 + t) of it. So its prefix may be shorter, and
    # what is common to a family of texts that are not similar enough lies behind that prefix.
    postings = postings.withColumn("leads", F.col("place") < F.col("size") - _rest(F.col("size"), 2 * OVER, OVER + UNDER)).drop("place")
    running = placed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = postings.select(
        "h", "node", "size", "leads", F.lag("node").over(placed).alias("before"), F.lead("node").over(placed).alias("after"),
        F.first("node").over(running).alias("lead"), F.lag("size").over(placed).alias("before_size"), F.first("size").over(running).alias("lead_size"),
    )
    shared = materialize(met.where("before IS NOT NULL OR after IS NOT NULL"), "shared")
    # The smaller set comes first in the order, so one comparison of sizes is enough.
    met = [shared.select(F.col(n).alias("x"), F.col(f"{n}_size").alias("size_x"), F.col("node").alias("y"), F.col("size").alias("size_y")) for n in ("before", "lead")]
    larger = _rest(F.greatest("size_a", "size_b"), OVER, UNDER)
    able = _able(_in_order(met[0].union(met[1]).where((F.col("x") != F.col("y")) & (UNDER * F.col("size_x") >= OVER * F.col("size_y")))), larger)
    tried = materialize(simhash_pairs(nodes).union(able).distinct(), "tried")
    found = materialize(components(_checked(tried, nodes, plain)), "found")

    joined = shared.join(found, "node", "left").select("h", "node", "size", "leads", F.coalesce("root", "node").alias("root"))
    mixed = joined.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("leads").alias("any")).where("low <> high AND any").select("h")
    rest = materialize(joined.join(mixed, "h", "left_semi").join(nodes.select("node", *PARITY), "node"), "rest")
    x, y = (rest.select("h", F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("size", "root", "leads", *PARITY))) for n in ("x", "y"))
    ahead = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("x") < F.col("y")))
    apart = (UNDER * F.col("size_x") >= OVER * F.col("size_y")) & (F.col("root_x") != F.col("root_y")) & _parity_allows()
    behind = F.greatest(larger, _rest(F.least("size_a", "size_b"), 2 * OVER, OVER + UNDER))
    pairs = materialize(_able(_in_order(x.where("leads_x").join(y, "h").where(ahead & apart)), behind).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = _checked(pairs, nodes, plain)
    if not more.isEmpty():
        found = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "found")
    return marked, nodes, found


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each input row: doc_id and component_id, the least id that can be reached over similar texts.

    A text of fewer than WORDS words is one shingle, texts without words are copies of each other. A null id is kept and never
    names a component unless all ids of it are null. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    marked, nodes, found = _linked(_plain(docs, text, doc_id))
    rooted = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return marked.join(least, "node").select("doc_id", "component_id")


def greedy(sets: list[np.ndarray]) -> list[int]:
    """Places of the sets, in this order, that are similar to none before them that stays.

    A set is compared with all kept ones at once: its members are marked, and marks are counted by kept set.
    """
    ends = np.cumsum([0, *map(len, sets)])
    _, numbers = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    marked = np.zeros(len(numbers) + 1, dtype=bool)
    members, owner = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    sizes, kept, used = np.zeros(len(sets), np.int64), [], 0
    for i in range(len(sets)):
        own = numbers[ends[i] : ends[i + 1]]
        marked[own] = True
        shared = np.bincount(owner[:used][marked[members[:used]]], minlength=len(kept))[: len(kept)]
        marked[own] = False
        together = len(own) + sizes[: len(kept)] - shared
        # Two sets without members are alike.
        if (UNDER * shared >= OVER * together).any():
            continue
        members[used : used + len(own)], owner[used : used + len(own)] = own, len(kept)
        sizes[len(kept)] = len(own)
        used += len(own)
        kept.append(i)
    return kept


def _greedy(part: pa.Table) -> pa.Table:
    """Of one component's nodes, in order, those that are similar to none that stays."""
    rows = part.sort_by([("unnamed", "ascending"), ("jid", "ascending"), ("mark", "ascending"), ("node", "ascending")]).combine_chunks()
    listed = pa.concat_arrays(rows.column("members").chunks)
    ends, values = listed.offsets.to_numpy(), listed.values.to_numpy()
    kept = greedy([values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
    return pa.table({"node": rows.column("node").take(pa.array(kept, pa.int64()))})


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark) of one row of every text that stays, `mark_of` being the text's.

    In the order of ids (rows without an id last, then by mark) a text goes if it is similar to one that stays; of texts with one set of shingles
    the first stays. So every text that goes is similar to a kept one, and no two kept ones are similar.

    The first node of a component has no earlier neighbour: it stays, and all of its component are compared with it, which is linear. What is not
    similar to it is left: components with few such nodes are ended in one task each, the texts of the others are linked and
    compared anew without it. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    plain = _plain(docs, text, doc_id)
    kept: list[DataFrame] = []
    while True:
        _, nodes, found = _linked(plain)
        # Null ids were moved to the least number for joins; in the order they are last.
        order = F.struct(F.col("least").isNull().alias("unnamed"), "jid", "mark", "node")
        # A component's root has no row of its own in `found`.
        linked = found.select("node", "root").union(found.select("root", "root").distinct())
        rooted = nodes.join(linked, "node").select("node", "root", "jid", "mark", "size", order.alias("place"))
        leads = rooted.groupBy("root").agg(F.min("place").alias("lead")).select("root", F.col("lead.node").alias("lead"))
        others = materialize(rooted.join(leads, "root").where("node <> lead"), "others")
        alike = _checked(others.select(F.col("lead").alias("a"), F.col("node").alias("b")), nodes, plain)
        left = materialize(others.join(alike.select(F.col("b").alias("node")), "node", "left_anti"), "left")
        sizes = left.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("members"))
        fits = (F.col("n") <= GREEDY_NODES) & (F.col("members") <= GREEDY_MEMBERS)
        small = left.join(sizes.where(fits).select("root"), "root", "left_semi")
        sets = _members(small.select("node"), nodes, plain, "left-sets")
        ended = small.select("root", "node", "jid", "mark", F.col("place.unnamed").alias("unnamed")).join(sets, "node")
        ended = ended.groupBy("root").applyInArrow(_greedy, "node bigint")
        stays = nodes.join(others.select("node"), "node", "left_anti").unionByName(nodes.join(ended, "node", "left_semi"))
        kept.append(stays.select(F.col("least").alias("doc_id"), "mark"))
        large = materialize(left.join(sizes.where(~fits).select("root"), "root", "left_semi").select("jid", "mark"), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        plain = plain.join(large, ["jid", "mark"], "left_semi").select(*plain.columns)
