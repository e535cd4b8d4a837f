"""Intake of partner files: verified, complete, and repeatable."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day
from .readers import FILE


#: `binaryFile` holds a file in one value, which ends at 2 GB; larger files are read in pieces.
LARGEST_VALUE = (1 << 31) - 1024
PIECE = 8 << 20


def digests(spark: SparkSession, glob: str, largest_value: int = LARGEST_VALUE) -> DataFrame:
    """(path, actual) MD5 of every file, companions left out. Spark hashes files that fit one value, tasks stream larger ones.

    An MD5 cannot be split, so one file is one task's work, in bounded memory.
    """
    listed = spark.read.format("binaryFile").load(glob).where(~F.col("path").endswith(".md5"))
    small = listed.where(F.col("length") <= largest_value).select("path", F.md5("content").alias("actual"))
    # Only the listing is read here, no content; each file is dealt to a task of its own.
    large = listed.where(F.col("length") > largest_value).select("path")

    # Nested, so that it travels with the job and workers need no package.
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                files, inside = fs.FileSystem.from_uri(path)
                digest = hashlib.md5(usedforsecurity=False)
                with files.open_input_stream(inside) as source:
                    while piece := source.read(PIECE):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "actual"])

    streamed = large.repartition(F.col("path")).mapInArrow(stream, "path string, actual string")
    return small.unionByName(streamed)


def put_texts(rows: DataFrame) -> int:
    """Write each row (path, text) as a small file, from the tasks; how many there are. Running again replaces the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                files, inside = fs.FileSystem.from_uri(path)
                with files.open_output_stream(inside) as target:
                    target.write(text.encode())
            yield batch

    return rows.select("path", "text").mapInArrow(write, "path string, text string").count()


def write_companions(spark: SparkSession, glob: str, largest_value: int = LARGEST_VALUE) -> int:
    """Write `<file>.md5` beside every file, from the tasks that know the digests; how many there are."""
    sums = digests(spark, glob, largest_value)
    return put_texts(sums.select(F.concat("path", F.lit(".md5")).alias("path"), F.col("actual").alias("text")))


def verify_checksums(spark: SparkSession, glob: str, largest_value: int = LARGEST_VALUE) -> DataFrame:
    """Manifest (path, expected, actual, ok) of files and their `.md5` companions.

    Hashing runs in the tasks that read the files. A file without a companion is not ok.
    """
    sums = spark.read.format("binaryFile").load(f"{glob}.md5")
    expected = sums.select(
        F.regexp_replace("path", r"\.md5$", "").alias("path"),
        F.lower(F.regexp_extract(F.col("content").cast("string"), r"([0-9a-fA-F]{32})", 1)).alias("expected"),
    )
    return digests(spark, glob, largest_value).join(expected, "path", "left").select(
        "path",
        "expected",
        "actual",
        F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"),
    )


def accepted_rows(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of files that passed verification, by their `source_file`; rows of rejected files never load."""
    good = manifest.where("ok").select(F.col("path").alias(FILE))
    return df.join(good, FILE, "left_semi").drop(FILE)


def missing_files(
    partners: DataFrame, manifest: DataFrame, d0: str | dt.date, d1: str | dt.date
) -> DataFrame:
    """Expected (partner, file_date) pairs of d0..d1 that the listing lacks."""
    grid = partners.select("partner").distinct().withColumn(
        "file_date", F.explode(F.sequence(day(d0), day(d1)))
    )
    return grid.join(manifest.select("partner", "file_date"), ["partner", "file_date"], "left_anti")


def replay_late(
    arrived: DataFrame, loaded: DataFrame, load_day: Callable[[dt.date], None]
) -> Sequence[dt.date]:
    """Run the load again for every date with a file that arrived after the date was loaded.

    Loads replace a date slice, so running one again is safe. The list holds one entry per
    late date, bounded by the calendar.
    """
    late = arrived.join(loaded, ["partner", "file_date"], "left_anti")
    dates = [r["file_date"] for r in late.select("file_date").distinct().orderBy("file_date").collect()]
    for date in dates:
        load_day(date)
    return dates
