"""Token ids in a binary file format: fixed-width bit packing with block offsets.

One file holds the ids of a run of documents. Layout, all numbers little-endian:

    magic DSIDS1, bits u16, documents u64, ids u64, ids in a block u64
    document ids i64 x documents, 1 where the id is null u8 x documents, end of each document u64 x documents
    byte offset of each block in the payload u64 x (blocks + 1)
    payload: each block's ids, `bits` bits each, lowest bit first, filled up to a whole byte

`bits` is the least that holds the vocabulary. A block can be read without those before it.
Spark sorts documents into ranges of ids and every task writes the files of its range; names sort like
the documents. A task that runs again writes the same files under the same names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, new_dir
from .common import SLICE_BYTES, ship, shuffle_partitions, slices, whole_text
from .tokens import encoder, vocabulary

MAGIC = b"DSIDS1"
HEADER = np.dtype([("magic", "S6"), ("bits", "<u2"), ("documents", "<u8"), ("ids", "<u8"), ("block", "<u8")])
BLOCK_IDS = 65_536
FILE_IDS = 8_000_000
MANIFEST = "file string, documents bigint, ids bigint"


def width(size: int) -> int:
    """Least number of bits for ids below `size`."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits` bits each, lowest bit first, filled up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    wide = np.ascontiguousarray(ids, dtype="<u4")
    planes = wide.view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return np.ascontiguousarray(planes[:, : bits // 8]).tobytes()
    return np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    """The `count` ids that `pack` was given."""
    raw = np.frombuffer(data, dtype=np.uint8)
    planes = np.zeros((count, 4), dtype=np.uint8)
    if bits % 8 == 0:
        planes[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
    else:
        single = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
        planes = np.packbits(np.pad(single, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little")
    return planes.reshape(-1).view("<u4")


def to_bytes(doc_ids: list[int | None], parts: list[bytes], bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file: `parts` are the documents' ids as unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    ends = np.cumsum(np.array([len(p) // 4 for p in parts], dtype="<u8"), dtype="<u8")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = np.array([(MAGIC, bits, len(parts), len(ids), block)], dtype=HEADER)
    numbers = np.array([i if i is not None else 0 for i in doc_ids], dtype="<i8")
    missing = np.array([i is None for i in doc_ids], dtype=np.uint8)
    return b"".join([head.tobytes(), numbers.tobytes(), missing.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class IdFile:
    """Reads one file; ids of any range or document without unpacking the rest."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        head = np.frombuffer(self.data[: HEADER.itemsize], dtype=HEADER)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.bits, self.documents, self.ids, self.block = (int(head[k]) for k in ("bits", "documents", "ids", "block"))
        at, n = HEADER.itemsize, self.documents
        self.doc_ids = np.frombuffer(self.data[at : at + 8 * n], dtype="<i8")
        self.missing = np.frombuffer(self.data[at + 8 * n : at + 9 * n], dtype=np.uint8)
        self.ends = np.frombuffer(self.data[at + 9 * n : at + 17 * n], dtype="<u8")
        at += 17 * n
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(self.data[at : at + 8 * (blocks + 1)], dtype="<u8")
        self.payload = self.data[at + 8 * (blocks + 1) :]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` up to `stop`; only the blocks that hold them are unpacked."""
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.ids - b * self.block)
            parts.append(unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, number: int) -> np.ndarray:
        """Ids of the document at this place in the file."""
        return self.range(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def _save(folder: str, name: str, data: bytes, attempt: int) -> None:
    """Writes under a name of this attempt first, so that a file is whole as soon as it has its name."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/_{name}.{attempt}") as out:
        out.write(data)
    files.move(f"{path}/_{name}.{attempt}", f"{path}/{name}")


def _writer(folder: str, definition, end_id: int, file_ids: int, block: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(definition.value), TaskContext.get()
        bits, end = width(max(encode.size, end_id + 1)), np.array([end_id], dtype="<u4").tobytes()
        docs, parts, held, serial = [], [], 0, 0

        def save():
            name = f"{context.partitionId():06d}-{serial:06d}.ids"
            _save(folder, name, to_bytes(docs, parts, bits, block), context.taskAttemptId())
            return pa.RecordBatch.from_pydict({"file": [name], "documents": [len(docs)], "ids": [held]})

        for rows in slices(batches, "text"):
            for doc, ids in zip(rows["doc_id"], encode.encode(rows["text"]), strict=True):
                docs.append(doc)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= file_ids:
                    yield save()
                    docs, parts, held, serial = [], [], 0, serial + 1
        if docs:
            yield save()

    return write


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
          file_ids: int = FILE_IDS, block: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of all documents in ascending id order; one manifest row for each file.

    A null text is empty and gives the end id alone. Null ids come first; equal ids are ordered by
    text. Repeated rows are documents of their own. An empty table gives no file. Other columns are ignored.
    `folder` is a place that all executors share and that pyarrow can write to.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sorted_ = plain.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text")
    return materialize(sorted_.mapInArrow(_writer(folder, vocabulary(spark, path), end_id, file_ids, block), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = IdFile(row["content"])
            start = 0
            for first in range(0, file.documents, 1024):
                ends = file.ends[first : first + 1024].tolist()
                ids = file.range(start, ends[-1]).tobytes()
                sums, sizes, starts, at = [], [], [], start
                for end in ends:
                    sums.append(zlib.crc32(ids[4 * (at - start) : 4 * (end - start)]))
                    sizes.append(end - at)
                    starts.append(at)
                    at = end
                gone = file.missing[first : first + 1024].astype(bool)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [row["file"]] * len(ends),
                        "doc_id": pa.array(file.doc_ids[first : first + 1024], pa.int64(), mask=gone),
                        "at": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )
                start = ends[-1]


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: its place among all ids, its number of ids and their crc32."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    digests = files.mapInArrow(_read, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # One row for each file.
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    first = manifest.select("file", F.coalesce(before, F.lit(0)).alias("first"))
    return digests.join(first, "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def packed(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids below the shared folder and return what the files say; see `write`."""
    spark = docs.sparkSession
    folder = new_dir(spark, "ids")
    manifest = write(docs, folder, path, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_digests(spark, folder, manifest)
