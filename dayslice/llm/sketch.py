"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of all hashes, so sketches of texts of any
length can be compared and merged. A text with few hashes below it keeps its least ones instead, and the sketch
says up to which value it is complete; two sketches are compared up to the smaller of their two values.

To hold each text against its successor Spark deals texts by ranges of their id, and adds to each range
the first text of the next, so one shuffle of the texts is enough and no range knows more than its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, shuffle_partitions, slices, whole_text

WORDS = 5
#: One hash in so many is kept.
SCALE = 8
#: So many are kept at least, if the text has them.
LEAST = 32
ALL = (1 << 64) - 1
SLICE_BYTES = 2 << 20
#: Ranges for each shuffle partition, so that partitions even out.
RANGES = 4
SKETCHED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, jaccard_edited double, jaccard_next double, "
    "compared_edited int, compared_next int"
)
_white = np.zeros(256, dtype=bool)
_white[[9, 10, 11, 12, 13, 32]] = True
#: An odd base and its inverse modulo 2**64: hashes of words are polynomials of their bytes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < count:
        steps = np.full(max(count, SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:count]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a text without A-Z."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~_white[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    terms = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), dtype=np.uint64)
    before = np.where(start > 0, terms[start - 1], np.uint64(0))
    return _mix((terms[end - 1] - before) * _power(INVERSE, len(data))[start]), start


def _long_words(text: bytes) -> np.ndarray:
    """Hashes of the words of one text, a part at a time; parts end at white space."""
    hashes, at = [], 0
    while at < len(text):
        end = min(at + SLICE_BYTES, len(text))
        while end < len(text) and not _white[text[end]]:
            end += 1
        hashes.append(_words(text[at:end])[0])
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; fewer words are one run."""
    size = min(size, len(words))
    total = np.zeros(max(0, len(words) - size + 1) if size else 0, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + words[i : i + len(total)]
    return _mix(total + np.uint64(size))


class Sketch:
    """All distinct hashes of a set up to `limit`."""

    def __init__(self, limit: int, hashes: np.ndarray):
        self.limit, self.hashes = limit, hashes

    @classmethod
    def of(cls, hashes: np.ndarray, scale: int = SCALE, least: int = LEAST) -> "Sketch":
        limit = ALL // scale
        kept = np.unique(hashes[hashes <= np.uint64(limit)])
        if len(kept) >= least:
            return cls(limit, kept)
        kept = np.unique(hashes)
        if len(kept) <= least:
            return cls(ALL, kept)
        return cls(int(kept[least - 1]), kept[:least])

    def text(self) -> str:
        """The limit and the hashes in order, 16 hex digits each."""
        return f"{self.limit:016x}" + self.hashes.astype(">u8").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> "Sketch":
        return cls(int(text[:16], 16), np.frombuffer(bytes.fromhex(text[16:]), dtype=">u8").astype(np.uint64))

    def merge(self, other: "Sketch") -> "Sketch":
        """Sketch of both sets together."""
        limit = min(self.limit, other.limit)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(limit, both[both <= np.uint64(limit)])

    def _common(self, other: "Sketch") -> tuple[int, int, int]:
        limit = np.uint64(min(self.limit, other.limit))
        a, b = self.hashes[self.hashes <= limit], other.hashes[other.hashes <= limit]
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def compared(self, other: "Sketch") -> int:
        """How many of this set's hashes lie below both limits: what `contained` rests on. At 0 it says nothing."""
        return self._common(other)[1]

    def contained(self, other: "Sketch") -> float:
        """Estimated share of this set that is in the other; two sets without shingles are alike.

        Against a much longer text only hashes below that text's limit can be compared: of n shingles none is left with a chance of
        (1 - 1/SCALE)^n, and the answer is then 0.0 without evidence; `compared` tells.
        """
        common, own, _ = self._common(other)
        if not len(self.hashes):
            return float(not len(other.hashes))
        return common / own if own else 0.0

    def jaccard(self, other: "Sketch") -> float:
        """Estimated share of both sets' union that is in both."""
        common, own, others = self._common(other)
        if not len(self.hashes) and not len(other.hashes):
            return 1.0
        return common / (own + others - common) if own + others else 0.0


def sketches(texts: list[str], words: int = WORDS, scale: int = SCALE, least: int = LEAST) -> list[Sketch]:
    """Sketch of each text: A-Z count as a-z, words end at ASCII white space."""
    out: list[Sketch] = []
    waiting: list[bytes] = []

    def flush():
        hashes, start = _words(b"\n".join(waiting) + b"\n")
        ends = np.cumsum([len(t) + 1 for t in waiting])
        cuts = np.concatenate(([0], np.searchsorted(start, ends)))
        out.extend(Sketch.of(_shingles(hashes[a:b], words), scale, least) for a, b in zip(cuts, cuts[1:], strict=False))
        waiting.clear()

    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower()
        if len(data) > SLICE_BYTES:
            if waiting:
                flush()
            out.append(Sketch.of(_shingles(_long_words(data), words), scale, least))
            size = 0
            continue
        if size + len(data) > SLICE_BYTES and waiting:
            flush()
            size = 0
        waiting.append(data)
        size += len(data)
    if waiting:
        flush()
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(words: int, scale: int, least: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, text, sketch) of the row whose successor is still to come
        for rows in slices(batches, "text", SLICE_BYTES):
            texts = rows["text"]
            own = sketches(texts, words, scale, least)
            pairs = []
            for bucket, ghost, doc, text, sketch in zip(rows["bucket"], rows["ghost"], rows["doc_id"], texts, own, strict=True):
                if last is not None and last[0] == bucket:
                    pairs.append((*last[1:], text, sketch))
                last = None if ghost else (bucket, doc, text, sketch)
            if not pairs:
                continue
            changed = [edited(text, following) for _, text, _, following, _ in pairs]
            new = sketches(changed, words, scale, least)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([p[0] for p in pairs], pa.int64()),
                    "n_chars": [len(p[1]) for p in pairs],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                    "fingerprint": [p[2].text() for p in pairs],
                    "edited_fingerprint": [s.text() for s in new],
                    "near_edited": [p[2].contained(s) for p, s in zip(pairs, new, strict=True)],
                    "near_next": [p[2].contained(p[4]) for p in pairs],
                    "jaccard_edited": [p[2].jaccard(s) for p, s in zip(pairs, new, strict=True)],
                    "jaccard_next": [p[2].jaccard(p[4]) for p in pairs],
                    "compared_edited": pa.array([p[2].compared(s) for p, s in zip(pairs, new, strict=True)], pa.int32()),
                    "compared_next": pa.array([p[2].compared(p[4]) for p in pairs], pa.int32()),
                }
            )

    return compare


def _bucket(key: Column, bounds: list[int], first: int = 0) -> Column:
    """Number of bounds above the key, found by halving; larger keys come first."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key >= bounds[middle], _bucket(key, bounds[:middle], first)).otherwise(
        _bucket(key, bounds[middle + 1 :], first + middle + 1)
    )


def fingerprint(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    scale: int = SCALE,
    least: int = LEAST,
) -> DataFrame:
    """Per text its sketch, that of the text with its last third replaced from the next text, and their likeness.

    The next text is that of the next smaller id, after the smallest id that of the largest; rows with one id are
    ordered by a hash of their text, null ids come last, and a single row is its own successor. `near_*` is the
    estimated share of the text's shingles in the other text, `jaccard_*` that of all shingles of both; `compared_*` is the number of the
    text's hashes that the first rests on (0: no evidence, as for a text of few words against a long one). A null text is
    empty. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = RANGES * shuffle_partitions(spark)
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))
    keys = docs.select(key.alias("key"))
    # One number for each range.
    shares = [i / parts for i in range(1, parts)]
    middle = keys.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0] or []
    bounds = sorted(set(middle), reverse=True)
    heads = sorted((r.bucket, r.head) for r in keys.groupBy(_bucket(F.col("key"), bounds).alias("bucket")).agg(F.max("key").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], SKETCHED)
    plain = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), key.alias("key"), whole_text(text).alias("text")
    ).withColumn("bucket", _bucket(F.col("key"), bounds))
    before = [(b, heads[(i + 1) % len(heads)][1]) for i, (b, _) in enumerate(heads)]
    target = spark.createDataFrame(before, "target int, key bigint")
    ghosts = plain.join(F.broadcast(target), "key").select("doc_id", "key", "text", F.col("target").alias("bucket"), F.lit(1).alias("ghost"))
    dealt = plain.select("doc_id", "key", "text", "bucket", F.lit(0).alias("ghost")).union(ghosts)
    spread = dealt.repartition(shuffle_partitions(spark), "bucket")
    order = ["bucket", "ghost", F.desc("key"), F.desc(F.xxhash64("text")), F.desc("text")]
    rows = spread.sortWithinPartitions(*order).select("bucket", "ghost", "doc_id", "text")
    return rows.mapInArrow(_compare(words, scale, least), SKETCHED)
