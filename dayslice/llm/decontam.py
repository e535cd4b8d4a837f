"""Benchmark passages in training documents, found through one FM-index for each shard of the documents.

A shard is a run of documents of about a million words. Its words become numbers, its index is written as one row of a
table, so an index serves many benchmarks and a lost executor repeats some shards only. The benchmark's windows (ten words in a row, or
a whole shorter item) are searched in blocks of a bounded size: each block is broadcast, each shard searches all its phrases at once,
locates the occurrences, and merges them into spans of words to remove. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import joined, parted, ship, squeeze, unsqueeze, whole_text
from .fmindex import BREAK, END, FMIndex

WORDS = 10
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Texts that are cut into words at once.
SLICE_BYTES = 1 << 20
#: Windows of a block that is broadcast; a window of ten usual words takes some 150 bytes.
BLOCK_WINDOWS = 100_000
#: Occurrences that are located at once.
BLOCK_ROWS = 1 << 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard bigint, ids binary, words binary, index binary, texts array<string>"
FOUND = "shard bigint, place int, doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>, text string"

_WORD_BYTES = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _values() -> np.ndarray:
    """A fixed odd 64-bit number for each byte, the same for both cases of a letter."""
    rng = np.random.default_rng(20_260)
    values = rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


_VALUES = _values()
_powers: dict[str, np.ndarray] = {}


def _power(base: int, count: int, name: str) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    if name not in _powers or len(_powers[name]) < count:
        step = np.full(count, base, dtype=np.uint64)
        step[0] = 1
        _powers[name] = np.multiply.accumulate(step)
    return _powers[name][:count]


def words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word of joined UTF-8 texts; `breaks` are the texts' first bytes and the end.

    Words are compared by these hashes: a polynomial in fixed numbers of the bytes, one for both cases of A-Z.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    inside = _WORD_BYTES[data]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    edges = breaks[breaks < len(data)]
    before[edges] = False
    edges = breaks[breaks > 0]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _power(_BASE, len(data), "up"))])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data), "down")[starts]
    hashes ^= hashes >> np.uint64(31)
    return starts, ends, hashes * np.uint64(0xD6E8FEB86659FD93)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes of texts without nulls, and the first byte of each with the end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    breaks = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[breaks[0] : breaks[-1]], breaks - breaks[0]


class _Shard:
    """Documents that wait for an index."""

    def __init__(self):
        self.ids, self.hashes, self.counts, self.texts, self.words = [], [], [], [], 0

    def add(self, ids: pa.Array, hashes: np.ndarray, counts: np.ndarray, texts: pa.Array | None) -> None:
        self.ids.append(ids)
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.texts.append(texts)
        self.words += len(hashes)

    def row(self, shard: int) -> pa.RecordBatch:
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        names, numbers = np.unique(hashes, return_inverse=True)
        document = np.repeat(np.arange(len(counts)), counts)
        text = np.full(len(hashes) + len(counts) + 1, BREAK, dtype=np.int64)
        text[np.arange(len(hashes)) + document] = numbers + BREAK + 1
        text[-1] = END
        ids = pa.concat_arrays(self.ids)
        present = ids.is_valid().to_numpy(zero_copy_only=False)
        about = joined([squeeze(ids.fill_null(0).to_numpy().astype(np.int64)), squeeze(present.astype(np.int8)), squeeze(counts.astype(np.int64))])
        texts = None if self.texts[0] is None else pa.concat_arrays(self.texts).to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([about], pa.binary()), pa.array([squeeze(names)], pa.binary()), pa.array([FMIndex.of(text).dump()], pa.binary()), pa.array([texts], pa.list_(pa.string()))],
            names=["shard", "ids", "words", "index", "texts"],
        )


def _shards(keep_text: bool, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            start = 0
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                count = max(1, int(np.searchsorted(sizes[start:], done + SLICE_BYTES, side="right")))
                part = batch.slice(start, count)
                data, breaks = _texts(part.column(1))
                starts, _, hashes = words_of(data, breaks)
                counts = np.diff(np.searchsorted(starts, breaks))
                if now.words and now.words + len(hashes) > shard_words:
                    yield now.row(number)
                    number, now = number + 1, _Shard()
                now.add(part.column(0), hashes, counts, part.column(1) if keep_text else None)
                start += count
        if now.ids:
            yield now.row(number)

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A table of FM-indexes, one row for each shard of the documents, written to the shared folder.

    A null text counts as empty. Null ids and repeated rows are kept: each row is a document of its own. With
    `keep_text` the shards hold the texts too, so that `find` can return them without the passages.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return materialize(plain.mapInArrow(_shards(keep_text, shard_words), INDEX), "fm-index")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(item, window, n) distinct: each run of `words` words of each item, joined by a space; a shorter item is one window of its n words."""
    lower = F.translate(F.col(text), UPPER, LOWER)
    listed = items.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1).alias("_w"))
    last = F.greatest(F.size("_w") - words, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_w", i + 1, words), " "))
    return listed.where(F.size("_w") > 0).select("item", F.explode(runs).alias("window"), F.least(F.size("_w"), F.lit(words)).alias("n")).distinct()


class _Block:
    """Phrases of one block: hashes of their words, by length, and the items of each."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.items = sorted({i for i, _ in rows if i is not None})
        place = {item: n for n, item in enumerate(self.items)}
        owners: dict[str, list[int]] = {}
        for item, window in rows:
            owners.setdefault(window, []).extend([place[item]] if item is not None else [])
        self.phrases: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        by_length: dict[int, list[str]] = {}
        for window in sorted(owners):
            by_length.setdefault(window.count(" ") + 1, []).append(window)
        for length, texts in by_length.items():
            data, breaks = _texts(pa.array(texts, pa.string()))
            hashes = words_of(data, breaks)[2].reshape(len(texts), length)
            self.phrases[length] = (hashes, [np.array(owners[t], dtype=np.int64) for t in texts])


def _occurrences(index: FMIndex, names: np.ndarray, block: _Block) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[np.ndarray]]]:
    """(places in the sequence, length, number of the phrase of each, items of the phrases) in bounded pieces."""
    for length, (hashes, owners) in block.phrases.items():
        numbers = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        whole = np.flatnonzero((names[numbers] == hashes).all(1))
        if not len(whole):
            continue
        low, high = index.ranges(numbers[whole] + BREAK + 1)
        ends = np.cumsum(high - low)
        for start in range(0, int(ends[-1]), BLOCK_ROWS):
            nth = np.arange(start, min(int(ends[-1]), start + BLOCK_ROWS))
            phrase = np.searchsorted(ends, nth, side="right")
            rows = high[phrase] - (ends[phrase] - nth)
            yield index.locate(rows), length, whole[phrase], owners


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the spans of words, from the first byte of a span's first word to the last of its last."""
    words = [m.span() for m in re.finditer(WORD.replace("A-Z", ""), text.translate(str.maketrans(UPPER, LOWER)))]
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*kept, text[at:]])


def _search(shared: Broadcast, every: bool, cleaned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                yield from _search_shard(row, block, every, cleaned)

    return run


def _search_shard(row: dict, block: _Block, every: bool, cleaned: bool) -> Iterator[pa.RecordBatch]:
    ids, present, counts = (unsqueeze(p, k) for p, k in zip(parted(row["ids"].as_py()), ("int64", "int8", "int64"), strict=True))
    names, n = unsqueeze(row["words"].as_py(), "uint64"), len(counts)
    firsts = np.concatenate([[0], np.cumsum(counts + 1)])  # in the sequence, each document is closed by a break
    cover = np.zeros(int(firsts[-1]) + 2, dtype=np.int32)
    pairs: list[np.ndarray] = []  # document, item
    if len(names):
        for places, length, phrase, owners in _occurrences(FMIndex.load(row["index"].as_py()), names, block):
            np.add.at(cover, places, 1)
            np.add.at(cover, places + length, -1)
            both = np.unique(np.stack([np.searchsorted(firsts, places, side="right") - 1, phrase]), axis=1)
            many = np.array([len(owners[p]) for p in both[1]], dtype=np.int64)
            if many.sum():
                pairs.append(np.unique(np.stack([np.repeat(both[0], many), np.concatenate([owners[p] for p in both[1]])]), axis=1))
    hit = np.cumsum(cover) > 0
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    document = np.searchsorted(firsts, starts, side="right") - 1
    chosen = np.arange(n) if every else np.unique(document)
    of = lambda found: np.searchsorted(found, np.append(chosen, n))
    spans = pa.array(of(document).astype(np.int32))
    found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    items = pa.array([block.items[k] for k in found[1]], pa.string())
    texts = pa.nulls(len(chosen), pa.string())
    if row["texts"].is_valid:
        kept = row["texts"].values.take(pa.array(chosen)).to_pylist()
        bounds = of(document)
        if cleaned:
            kept = [cut(t, (starts[a:b] - firsts[d]).tolist(), (ends[a:b] - firsts[d]).tolist()) if b > a else t for t, d, a, b in zip(kept, chosen, bounds[:-1], bounds[1:], strict=True)]
        texts = pa.array(kept, pa.string())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(chosen), row["shard"].as_py())), pa.array(chosen.astype(np.int32)), pa.array(ids[chosen], mask=present[chosen] == 0), pa.array(counts[chosen]),
            pa.ListArray.from_arrays(spans, pa.array(starts - firsts[document])), pa.ListArray.from_arrays(spans, pa.array(ends - firsts[document])),
            pa.ListArray.from_arrays(pa.array(of(found[0]).astype(np.int32)), items), texts,
        ],
        names=[c.split()[0] for c in FOUND.split(", ")],
    )


def _merged(batches: Iterator[pa.RecordBatch], cleaned: bool) -> Iterator[pa.RecordBatch]:
    """Documents that several blocks found: spans that touch or overlap become one."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            spans: list[list[int]] = []
            for a, b in sorted(zip(row["starts"], row["ends"], strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            row["starts"], row["ends"] = [a for a, _ in spans], [b for _, b in spans]
            if cleaned and row["text"] is not None and spans:
                row["text"] = cut(row["text"], row["starts"], row["ends"])
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def find(index: DataFrame, phrases: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans, items, text of every document of the index, one row each.

    `spans` are the merged runs of words (start, end) that any window occurs in, `items` the distinct ids, as sorted text, of the items whose
    windows occur, `text` the text without the spans (null if the index was made without texts). `phrases` are `windows`. An item with
    a null id marks words but names no item. Windows are dealt by a hash into blocks of about `block_windows`, so each
    broadcast is bounded by it whatever the size of the benchmark; one window of very many items falls into several blocks.
    """
    spark = index.sparkSession
    total = phrases.count()
    blocks = max(1, -(-total // block_windows))
    dealt = phrases.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    if blocks > 1:
        dealt = materialize(dealt.repartition("block"), "phrases")
    found: DataFrame | None = None
    for block in range(blocks):
        rows = [(r.item, r.window) for r in dealt.where(F.col("block") == block).select("item", "window").collect()]
        shared = spark.sparkContext.broadcast(_Block(rows))
        part = index.mapInArrow(_search(shared, block == 0, blocks == 1), FOUND)
        found = part if found is None else found.union(part)
    if blocks > 1:
        found = found.groupBy("shard", "place").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"),
            F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("text").alias("text"),
        )
        found = found.mapInArrow(lambda b: _merged(b, True), FOUND)
    return found.select("doc_id", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "items", "text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, keep_text: bool = True) -> DataFrame:
    """`find` on a new index of the documents: each document's hit spans, items, and its text without them.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. A word is hit if it lies in
    any occurrence of a window. A null text has no words (its text is returned empty). An empty benchmark hits nothing, an empty table
    gives no row. Other columns are ignored.
    """
    return find(build_index(docs, keep_text=keep_text), windows(benchmark, words=words))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of the rows of `find`."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
