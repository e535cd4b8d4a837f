"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python and Spark work on texts in slices of about so many bytes, so memory stays bounded.
SLICE_BYTES = 6 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of all executors this package; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(package))
        sources = shutil.ignore_patterns("__pycache__")
        shutil.copytree(package, os.path.join(target, os.path.basename(package)), ignore=sources)
        context.addPyFile(shutil.make_archive(target, "zip", target))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(
    batches: Iterable[pa.RecordBatch], size_of: str, limit: int = SLICE_BYTES, most: int = 8192
) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches in runs of at most `most` rows and about `limit` bytes of column `size_of`.

    A single value over the limit makes a run of its own. The order of rows is kept.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))), 0)
        lengths = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(lengths[start : start + most])
            count = max(1, int(np.searchsorted(ends, limit, side="right")))
            part = batch.slice(start, count)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
            start += count


def squeeze(array: np.ndarray) -> bytes:
    """An array as compressed byte planes; small numbers leave planes of zeros."""
    item = array.dtype.itemsize
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, item).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    """The array that `squeeze` was given."""
    item = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(item, -1).T).reshape(-1).view(dtype)


def joined(parts: list[bytes]) -> bytes:
    """Several byte strings as one, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    """The byte strings that `joined` was given."""
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return parts
