"""Packs token runs into sequences of a fixed length: bounded-space online best fit.

Texts are encoded once and only the lengths travel. Pieces are dealt at random, by a hash of their
place in the input, into groups of some thousand; each group is packed by itself, in the order in which the pieces come.
A fixed number of bins is open at a time. A bitset with one bit for each amount of free space finds the
fullest bin that still takes a piece; when one bin too many is open, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ship, slices, whole_text
from .tokens import encoder, vocabulary

SEQUENCE = 2048
OPEN_BINS = 4096
GROUP_PIECES = 16_384
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, serial bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut(total: int, limit: int) -> list[int]:
    """Lengths of a document's pieces: whole pieces at the end, the rest first."""
    rest = total % limit
    return ([rest] if rest else []) + [limit] * (total // limit)


class BestFit:
    """Open bins by free space; `add` returns the bin that took a length and the place in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.open, self.used = 0, [[] for _ in range(capacity + 1)], 0, 0

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.used
            self.used += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                # The fullest bin has the least free space: the lowest bit.
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def _pieces(definition, end_id: int, limit: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, serial = encoder(definition.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for rows in slices(batches, "text"):
            out = []
            for doc, ids in zip(rows["doc_id"], encode.encode(rows["text"]), strict=True):
                data, at = memoryview(ids + end), 0
                for piece, length in enumerate(cut(len(data) // 4, limit)):
                    out.append((doc, piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), task, serial))
                    at, serial = at + length, serial + 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "serial")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return cut_up


def _pack_group(capacity: int, open_bins: int):
    def fill(group: pd.DataFrame) -> pd.DataFrame:
        # Online: in the order of the input, which a task that runs again must find again.
        group = group.sort_values(["task", "serial"])
        bins = BestFit(capacity, open_bins)
        places = [bins.add(n) for n in group["length"].tolist()]
        first = int(group["bucket"].iloc[0]) << 32
        group["sequence_id"] = [first + b for b, _ in places]
        group["offset"] = [o for _, o in places]
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return fill


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    sequence: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row for each piece of each document with its sequence and its place there.

    A document's ids and the end id are kept whole up to `sequence` ids; a longer one is cut from its end
    into pieces of that length, so only its first piece may be shorter. A null text is empty: one piece
    with the end id. Repeated rows and null ids are documents of their own; other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    pieces = materialize(plain.mapInArrow(_pieces(vocabulary(spark, path), end_id, sequence), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("task", "serial"), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(_pack_group(sequence, open_bins), PACKED)
