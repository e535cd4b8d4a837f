"""Language-model score by prediction by partial matching (PPM), trained on the corpus itself.

The model is a byte trie of contexts up to five bytes. A byte is predicted by the longest
context that was seen; an unseen byte costs an escape (method C: distinct successors over
distinct plus total) to the next shorter context, where the bytes of the longer one are
excluded. The last resort is a uniform choice among the bytes never seen. Every probability
belongs to one distribution over 256 symbols, of which 0xFF ends a text.

How Spark runs it: the trie is never in one place. One pass cuts each slice of texts into
blocks of (six-byte gram, text, count), dealt by the three nearest context bytes, so that a
shard holds every count that the contexts of orders 3 to 5 need. Each shard streams its
blocks, first those that count, then those to be scored. Only the counts of orders 0 to 2 are
sent to all tasks: at most 2**24 numbers whatever the corpus. The unigram base is computed
from word blocks in the same shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_bucket, joined, parted, ship, shuffle_partitions, slices, squeeze, unsqueeze, whole_text

ORDER = 5
END, PAD = b"\xff", b"\xfe" * ORDER
SYMBOLS = 256
#: Multiplying a trigram by an odd number modulo 2**24 is reversible and spreads neighbours over shards.
MIX = 0x9E3779 | 1
UNMIX = pow(MIX, -1, 1 << 24)
#: Bytes of text that are cut into blocks at once; a task needs about 80 times as much memory for a moment.
SLICE_BYTES = 3 << 20
BLOCKS = "shard int, kind int, chunk string, payload binary"
GRAMS, PAIRS, ROWS, TOTALS, BASE, MODEL = range(6)
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_sum double, score double, n_bytes bigint"
)


def _pieces(texts: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, position of each symbol, row of each symbol) with ORDER bytes of context before each run."""
    parts, starts, sizes, rows, at = [], [], [], [], 0

    def flush():
        buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = np.array(sizes, dtype=np.int64)
        offset = np.repeat(np.array(starts, dtype=np.int64) - (np.cumsum(size) - size), size)
        return buffer, np.arange(size.sum()) + offset, np.repeat(np.array(rows, dtype=np.uint64), size)

    for row, text in enumerate(texts):
        whole = PAD + text + END
        for begin in range(ORDER, len(whole), limit):
            end = min(begin + limit, len(whole))
            if at + end - begin > limit and parts:
                yield flush()
                parts, starts, sizes, rows, at = [], [], [], [], 0
            starts.append(at + ORDER)
            parts.append(whole[begin - ORDER : end])
            sizes.append(end - begin)
            rows.append(row)
            at += end - begin + ORDER
    if parts:
        yield flush()


def _grams(buffer: np.ndarray, position: np.ndarray) -> np.ndarray:
    """48-bit key of each symbol with its context: mixed trigram, fifth and fourth byte, symbol."""
    wide = buffer.astype(np.uint64)
    trigram = (wide[position - 3] << np.uint64(16)) | (wide[position - 2] << np.uint64(8)) | wide[position - 1]
    mixed = (trigram * np.uint64(MIX)) & np.uint64(0xFFFFFF)
    key = (mixed << np.uint64(24)) | (wide[position - 5] << np.uint64(16)) | (wide[position - 4] << np.uint64(8))
    return key | wide[position]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each run starts."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], start


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    distinct, start = _runs(keys[order])
    return distinct, np.add.reduceat(counts[order], start) if len(start) else counts[:0]


def _blocks(shards: int, word_shards: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for rows in slices(batches, "text", SLICE_BYTES):
            chunk, serial = f"{task}-{serial}", serial + 1
            texts = [t.lower() for t in rows["text"]]
            train = np.array([not h for h in rows["held_out"]], dtype=bool)
            out: list[tuple[int, int, bytes]] = []
            for buffer, position, row in _pieces(texts, SLICE_BYTES):
                out += _byte_blocks(_grams(buffer, position), row, train, shards)
            tokens = np.zeros(len(texts), dtype=np.int64)
            for words, row in _word_pieces(texts):
                tokens += np.bincount(row, minlength=len(texts)).astype(np.int64)
                out += _word_blocks(words, row, train, shards, word_shards)
            ids = np.array([i if i is not None else 0 for i in rows["doc_id"]], dtype=np.int64)
            known = np.array([i is not None for i in rows["doc_id"]], dtype=np.uint8)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            head = [a.tobytes() for a in (ids, known, (~train).astype(np.uint8), tokens, sizes)]
            out.append((zlib.crc32(chunk.encode()) % shards, ROWS, joined(head)))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([s for s, _, _ in out], pa.int32()),
                    "kind": pa.array([k for _, k, _ in out], pa.int32()),
                    "chunk": pa.array([chunk] * len(out)),
                    "payload": pa.array([p for _, _, p in out], pa.binary()),
                }
            )

    return cut


def _byte_blocks(gram: np.ndarray, row: np.ndarray, train: np.ndarray, shards: int) -> list[tuple[int, int, bytes]]:
    pairs = np.sort((gram << np.uint64(16)) | row)
    pair, start = _runs(pairs)
    count = np.diff(start, append=len(pairs)).astype(np.uint32)
    key, doc = pair >> np.uint64(16), (pair & np.uint64(0xFFFF)).astype(np.uint16)
    # The upper bits of the key are the mixed trigram, so each shard is one range of the sorted keys.
    edges = (np.arange(1, shards, dtype=np.uint64) << np.uint64(48)) // np.uint64(shards)
    cuts = np.concatenate(([0], np.searchsorted(key, edges & ~np.uint64(0xFFFFFF)), [len(key)]))
    out = []
    for shard in range(shards):
        a, b = cuts[shard], cuts[shard + 1]
        if a < b:
            distinct, at = _runs(key[a:b])
            out += _pair_blocks(shard, squeeze(np.diff(distinct, prepend=np.uint64(0))), at, doc[a:b], count[a:b], train, distinct)
    return out


def _pair_blocks(shard, keys: bytes, at, doc, count, train, distinct) -> list[tuple[int, int, bytes]]:
    """The block of training counts and the block of (key, text, count) triples."""
    learned = np.add.reduceat(np.where(train[doc], count, 0), at).astype(np.uint32)
    per_key = np.diff(at, append=len(doc)).astype(np.uint32)
    pairs = joined([keys, squeeze(per_key), squeeze(doc), squeeze(count), len(train).to_bytes(8, "little")])
    out = [(shard, PAIRS, pairs)]
    if isinstance(distinct, np.ndarray):
        held = learned > 0
        if held.any():
            own = squeeze(np.diff(distinct[held], prepend=np.uint64(0)))
            out.append((shard, GRAMS, joined([own, squeeze(learned[held])])))
    elif learned.any():
        own = zstandard_words([w for w, n in zip(distinct, learned, strict=True) if n])
        out.append((shard, GRAMS, joined([own, squeeze(learned[learned > 0])])))
    return out


def zstandard_words(words: list[bytes]) -> bytes:
    """Words as one compressed text; none of them holds white space, and the empty one ends a document."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def words_of(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _word_pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Tokens of many texts with their rows; every text ends in one empty token."""
    words, row, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + SLICE_BYTES, len(text))
            # Cut long texts at white space.
            while end < len(text) and not text[end : end + 1].isspace():
                end += 1
            found = text[at:end].split()
            words += found
            row.append((i, len(found)))
            size += end - at
            at = end
            if size >= SLICE_BYTES:
                yield words, _expand(row)
                words, row, size = [], [], 0
        words.append(b"")
        row.append((i, 1))
    if words:
        yield words, _expand(row)


def _expand(row: list[tuple[int, int]]) -> np.ndarray:
    pairs = np.array(row, dtype=np.int64).reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1])


def _word_blocks(words, row, train, shards, word_shards) -> list[tuple[int, int, bytes]]:
    index: dict[bytes, int] = {}
    code = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    distinct = list(index)
    shard = np.array([zlib.crc32(w) % word_shards for w in distinct], dtype=np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), dtype=np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    pairs = np.sort((place[code] << np.uint64(16)) | row.astype(np.uint64))
    pair, start = _runs(pairs)
    count = np.diff(start, append=len(pairs)).astype(np.uint32)
    key, doc = (pair >> np.uint64(16)).astype(np.int64), (pair & np.uint64(0xFFFF)).astype(np.uint16)
    bounds = np.searchsorted(shard[order], np.arange(word_shards + 1))
    cuts = np.searchsorted(key, bounds)
    out = []
    for s in range(word_shards):
        a, b = cuts[s], cuts[s + 1]
        if a < b:
            own = [distinct[i] for i in order[bounds[s] : bounds[s + 1]]]
            _, at = _runs(key[a:b])
            out += _pair_blocks(shards + s, zstandard_words(own), at, doc[a:b], count[a:b], train, own)
    return out


class Level:
    """Counts of one order: successors of contexts in order, totals, distinct successors, excluded mass."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts.astype(np.float64)
        self.contexts, start = _runs(grams >> np.uint64(8))
        self.start = start
        self.total = np.add.reduceat(self.counts, start) if len(start) else np.zeros(0)
        self.kinds = np.diff(start, append=len(grams)).astype(np.float64)
        self.excluded = np.zeros(len(start))

    def exclude_from(self, lower: "Level", lower_keys: np.ndarray) -> None:
        """Per context, what its successors weigh in the next shorter context."""
        if len(self.start):
            self.excluded = np.add.reduceat(lower.count(lower_keys), self.start)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _look(self.grams, self.counts, keys)

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Index of each context, -1 where it was never seen."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _shorter(order: int, keys: np.ndarray) -> np.ndarray:
    """Keys of the next shorter order: the farthest context byte goes."""
    one = np.uint64(8)
    low = keys & np.uint64(0xFFFF if order == 5 else 0xFF)
    if order == 5:
        return (keys >> np.uint64(24) << np.uint64(16)) | low
    if order == 4:
        return (keys >> np.uint64(16) << one) | low
    if order == 3:
        trigram = ((keys >> one) * np.uint64(UNMIX)) & np.uint64(0xFFFF)
        return (trigram << one) | low
    return keys & np.uint64(0xFFFF if order == 2 else 0xFF)


class Model:
    """Trie levels of one shard; `log10` gives the probability of grams of the full order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]):
        self.levels: dict[int, Level] = {}
        for order in (5, 4, 3):
            self.levels[order] = Level(grams, counts)
            grams, counts = _summed(_shorter(order, grams), counts)
        grams, counts = short
        for order in (2, 1, 0):
            self.levels[order] = Level(grams, counts)
            if order:
                grams, counts = _summed(_shorter(order, grams), counts)
        for order in range(ORDER, 0, -1):
            level = self.levels[order]
            level.exclude_from(self.levels[order - 1], _shorter(order, level.grams))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        rest, keys = np.arange(len(grams)), grams
        mass, kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            at = level.find(keys >> np.uint64(8))
            seen = at >= 0
            total = np.where(seen, level.total[at] if len(level.total) else 0.0, 0.0) - mass
            fresh = np.where(seen, level.kinds[at] if len(level.kinds) else 0.0, 0.0) - kinds
            count = level.count(keys)
            hit = count > 0
            whole = np.where(seen & (fresh > 0), total + fresh, 1.0)
            out[rest[hit]] += np.log10(count[hit] / whole[hit])
            missed = ~hit
            escape = np.where(seen & (fresh > 0), fresh, 1.0) / whole
            out[rest[missed]] += np.log10(escape[missed])
            mass = np.where(seen, level.excluded[at] if len(level.excluded) else 0.0, 0.0)[missed]
            kinds = np.where(seen, level.kinds[at] if len(level.kinds) else 0.0, 0.0)[missed]
            rest, keys = rest[missed], _shorter(order, keys[missed]) if order else keys[missed]
            if not len(rest):
                return out
        out[rest] -= np.log10(SYMBOLS - kinds)
        return out


def _pairs_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    per_key, doc, count = (unsqueeze(parts[i], t) for i, t in ((1, "<u4"), (2, "<u2"), (3, "<u4")))
    return per_key, doc, count, int.from_bytes(parts[4], "little")


def _score_shards(shards: int, short):
    """Streams the blocks of one shard after another: counts first, then the texts to score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, model = None, None
        keys, counts, waiting, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], {}
        low = short.value

        def totals():
            numbers = np.array([len(words), sum(words.values())], dtype=np.int64)
            return _row(current, TOTALS, "", numbers.tobytes())

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                shard, kind, chunk, payload = row["shard"], row["kind"], row["chunk"], row["payload"]
                if shard != current:
                    if words:
                        out.append(totals())
                    current, model = shard, None
                    keys, counts, waiting, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], {}
                if kind == ROWS:
                    out.append(_row(shard, ROWS, chunk, payload))
                    continue
                parts = parted(payload)
                if kind == GRAMS and shard < shards:
                    own = np.cumsum(unsqueeze(parts[0], "<u8"))
                    waiting.append((own, unsqueeze(parts[1], "<u4").astype(np.int64)))
                    if sum(len(k) for k, _ in waiting) > max(4_000_000, len(keys)):
                        keys, counts = _merge(keys, counts, waiting)
                        waiting = []
                elif kind == GRAMS:
                    for word, n in zip(words_of(parts[0]), unsqueeze(parts[1], "<u4").tolist(), strict=True):
                        words[word] = words.get(word, 0) + n
                elif shard < shards:
                    if model is None:
                        keys, counts = _merge(keys, counts, waiting)
                        model, waiting = Model(keys, counts, low), []
                    per_key, doc, count, n = _pairs_of(parts)
                    log = model.log10(np.cumsum(unsqueeze(parts[0], "<u8")))
                    sums = np.bincount(doc, weights=np.repeat(log, per_key) * count, minlength=n)
                    out.append(_row(shard, MODEL, chunk, sums.astype("<f8").tobytes()))
                else:
                    per_key, doc, count, n = _pairs_of(parts)
                    seen = np.array([words.get(w, 0) for w in words_of(parts[0])], dtype=np.float64)
                    log = np.repeat(np.log10(seen + 1), per_key) * count
                    known = np.where(np.repeat(seen > 0, per_key), count, 0)
                    both = [np.bincount(doc, weights=x, minlength=n).astype("<f8").tobytes() for x in (log, known)]
                    out.append(_row(shard, BASE, chunk, joined(both)))
            yield _batch(out)
        if words:
            yield _batch([totals()])

    return score


def _merge(keys, counts, waiting):
    return _summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(n for _, n in waiting)]))


def _row(shard, kind, chunk, payload):
    return {"shard": shard, "kind": kind, "chunk": chunk, "payload": payload}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("chunk", pa.string()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (two context bytes, byte) of each slice."""
    for rows in slices(batches, "text", SLICE_BYTES):
        for buffer, position, _ in _pieces([t.lower() for t in rows["text"]], SLICE_BYTES):
            wide = buffer.astype(np.uint32)
            gram = (wide[position - 2] << 16) | (wide[position - 1] << 8) | wide[position]
            distinct, start = _runs(np.sort(gram))
            count = np.diff(start, append=len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"gram": distinct.astype(np.int64), "n": count})


def _rows_of_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per text from the partial sums of all shards."""
    head = parted(next(p for k, p in zip(pdf["kind"], pdf["payload"], strict=True) if k == ROWS))
    ids, known, held, tokens, sizes = (
        np.frombuffer(b, dtype=t) for b, t in zip(head, ("<i8", "u1", "u1", "<i8", "<i8"), strict=True)
    )
    score, base, n_known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    for kind, payload in sorted(zip(pdf["kind"], pdf["payload"], strict=True)):
        if kind == MODEL:
            score += np.frombuffer(payload, dtype="<f8")
        elif kind == BASE:
            log, count = (np.frombuffer(b, dtype="<f8") for b in parted(payload))
            base += log
            n_known += count
    return pd.DataFrame(
        {
            "doc_id": pd.array(np.where(known == 1, ids, 0), dtype="Int64").copy() if known.all() else pd.array([i if k else None for i, k in zip(ids.tolist(), known, strict=True)], dtype="Int64"),
            "held_out": held.astype(bool),
            "n_tokens": tokens,
            "n_known": n_known.astype(np.int64),
            "known_sum": base,
            "score": score,
            "n_bytes": sizes,
        }
    )


def score(
    docs: DataFrame,
    held_out: Column | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    shards: int | None = None,
) -> DataFrame:
    """log10 probability of every text under PPM and under an add-one unigram base, both learned from `docs`.

    `held_out` marks rows that are scored but not learned (default: crc32 of the id modulo 7 is
    2; a null id is learned). Returns one row per input row, other columns are ignored. A null text
    is empty and has one token, its end. Repeated rows are texts of their own. An empty table
    gives no rows. `docs` is read twice and has to keep the order of its rows when it is read again, as
    a file scan does. `shards` sets the parallelism of the model, not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(id_bucket(doc_id, 7) == 2, F.lit(False)) if held_out is None else held_out
    n = shards or max(64, min(1024, shuffle_partitions(spark)))
    words = max(16, n // 2)
    plain = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).cast("binary").alias("text"), held.alias("held_out")
    )
    counted = plain.where(~F.col("held_out")).mapInArrow(_short_counts, "gram bigint, n bigint")
    # At most 2**24 rows: every pair of bytes and its successor.
    low = counted.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    short = spark.sparkContext.broadcast(
        (low.column("gram").to_numpy().astype(np.uint64), low.column("n").to_numpy().astype(np.int64))
    )
    blocks = plain.mapInArrow(_blocks(n, words), BLOCKS)
    dealt = blocks.repartition(n, "shard").sortWithinPartitions("shard", "kind")
    partial = materialize(dealt.mapInArrow(_score_shards(n, short), BLOCKS), "ppm")
    # One row per word shard.
    sizes = [np.frombuffer(r.payload, dtype="<i8") for r in partial.where(F.col("kind") == TOTALS).select("payload").collect()]
    distinct, total = (int(sum(s[i] for s in sizes)) for i in (0, 1))
    rows = partial.where(F.col("kind") != TOTALS).select("chunk", "kind", "payload")
    scored = rows.groupBy("chunk").applyInPandas(_rows_of_chunk, SCORES)
    share = F.lit(float(np.log10(total + distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("known_sum") - F.col("n_tokens") * share).alias("base_score"),
        "score",
        "n_bytes",
    )
