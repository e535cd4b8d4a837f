"""Sinks. Each can run again for the same date and leaves the same table."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LayoutError
from ..functions.columns import day, shift
from ..operators.load import only_slice
from ..operators.quality import gate
from . import layouts
from .readers import has_slices, partition_path, path_exists


def write_slices(df: DataFrame, path: str, col: str, packed: bool = False) -> None:
    """Replace exactly the slices present in `df`; other slices stay.

    REBALANCE writes few files per slice and still splits a slice that is too large for one task.
    It shuffles every row; with `packed` each task writes the rows it has (see `write_slice`).
    """
    (
        (df if packed else df.hint("rebalance", F.col(col)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(col)
        .parquet(path)
    )


def write_slice(
    df: DataFrame, path: str, col: str, ds: str | dt.date, evolving: bool = False, packed: bool = False
) -> int:
    """Replace one date slice and return its row count, taken while writing.

    With `evolving` the table's schema is kept beside it (`write_evolving`).
    With `packed` the rows are neither shuffled nor sorted: each task writes one file. That is for rows that lie
    together already, a whole day's files or what came out of a shuffle; a few rows picked out of a large table would
    make many small files.

    A row of another date fails the write. An empty slice removes the old one, as a delete
    followed by an empty insert would.
    """
    seen = Observation()
    counted = only_slice(df, col, ds).observe(seen, F.count(F.lit(1)).alias("n"))
    if isinstance(df.schema[col].dataType, T.DateType):
        # Past the guard the date is this one; of a literal Spark knows that it needs no sort before the write.
        counted = counted.withColumn(col, day(ds))
    (write_evolving if evolving else write_slices)(counted, path, col, packed)
    rows = int(seen.get["n"])
    if rows == 0:
        drop_slice(df.sparkSession, path, col, ds)
    return rows


def drop_slice(spark: SparkSession, path: str, col: str, ds: str | int | dt.date) -> bool:
    """Remove the folder of one slice, if there is one."""
    folder = f"{path}/{col}={ds}"
    if not path_exists(spark, folder):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True))


def delete_slices(
    spark: SparkSession, path: str, col: str, lo: str | dt.date, hi: str | dt.date
) -> list[dt.date]:
    """Remove the slices lo..hi of a table on disk; no data is read or rewritten."""
    first, last = shift(lo, 0), shift(hi, 0)
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    return [d for d in days if drop_slice(spark, path, col, d)]


def append_partitioned(df: DataFrame, path: str, col: str) -> None:
    """Add files to a partitioned table. Not repeatable; prefer `write_slices`."""
    df.write.mode("append").partitionBy(col).parquet(path)


def overwrite_table(df: DataFrame, path: str, col: str | None = None) -> None:
    """Replace a whole table with its schema."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(col) if col else writer).parquet(path)


def save_external(df: DataFrame, name: str, path: str, col: str | None = None) -> None:
    """Write a table at a path and register it in the catalog."""
    writer = df.write.mode("overwrite").option("path", path).format("parquet")
    (writer.partitionBy(col) if col else writer).saveAsTable(name)


def write_json_partition(df: DataFrame, root: str, layer: str, table: str, ds: str) -> None:
    """Replace one date of a JSON table."""
    df.write.mode("overwrite").json(partition_path(root, layer, table, ds))


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Export with a header line. `one_file` is for small reports only."""
    rows = df.coalesce(1) if one_file else df
    rows.write.mode("overwrite").option("header", True).csv(path)


def publish(df: DataFrame, path: str, col: str, ds: str | dt.date, result: DataFrame | None = None) -> int:
    """Promote a validated slice: nothing is written unless its suite passed."""
    if result is not None:
        gate(result)
    return write_slice(df, path, col, ds)


def bucket_count(n_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Buckets for a table of this size: a power of two, each bucket about `target_bytes`."""
    return 1 << max(0, -(-n_bytes // target_bytes) - 1).bit_length()


def _bucket_of(key: str, buckets: int) -> Column:
    """Bucket of a key by its text, so that an int and a bigint of one value meet."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def merge_buckets(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int | None = None,
    bucket_col: str = "bucket",
    delivery: tuple[str, int] | None = None,
) -> list[int]:
    """Merge a batch into a table laid out by hash bucket and rewrite only touched buckets.

    Bucket count, key type and schema are stored with the table: the batch's key is cast to that type, and another
    count or key is refused. `merge(target, batch)` is one of the load patterns; both frames have all columns of the table, those that the
    batch lacks as NULL. Columns that the merge adds are added to the table, and a shared column takes the wider type (`layouts.evolve`); a
    merge that loses a column, or a type that does not fit, is refused. A merged row that lies in a bucket
    that was not read fails the job before anything is replaced.

    The merged buckets are written aside, then one rename of the layout decides that they count, then their folders move in. A job
    that dies before the decision changes nothing; after it the next reader or writer moves what is left. `delivery` names a stream
    and a number that grows with its batches: it is decided together with the data, and a batch that was merged before is left out,
    so a merge that adds up is applied once. Without it, running the batch again gives the same table as long as the merge
    is repeatable. One writer at a time. The lists of touched and kept buckets have at most as many entries as the table has buckets.
    """
    layout = finish_merge(spark, path, bucket_col)
    count = int(layout["buckets"])
    if layout["key"] != key or buckets not in (None, count):
        raise LayoutError(f"{path} is laid out by {layout['key']} in {count} buckets, not by {key} in {buckets}")
    if delivery is not None and layout.get("deliveries", {}).get(delivery[0], -1) >= delivery[1]:
        return []
    batch = batch.withColumn(key, F.col(key).cast(layout["type"]))
    touched = sorted(r[0] for r in batch.select(_bucket_of(key, count).alias(bucket_col)).distinct().collect())
    folder = None
    if touched:
        old_schema = read_buckets(spark, path, bucket_col).schema
        batch = layouts.aligned(batch, layouts.evolve(old_schema, batch.schema))
        old = _with_buckets(spark, path, old_schema, bucket_col).where(F.col(bucket_col).isin(touched)).drop(bucket_col)
        merged = merge(old, batch)
        lost = [c for c in old_schema.names if c not in merged.columns]
        if lost:
            raise LayoutError(f"the merge into {path} loses the columns {lost}")
        schema = layouts.evolve(old_schema, merged.schema)
        if schema != layouts.schema_of(layout):
            layout["schema"] = schema.jsonValue()
            # Before any file of the wider schema.
            layouts.write_layout(spark, path, layout)
        kept = Observation()
        bucket = _bucket_of(key, count)
        foreign = F.raise_error(F.concat(F.lit("merged row in a bucket that was not read: "), bucket.cast("string")))
        placed = layouts.aligned(merged, schema).withColumn(bucket_col, F.when(bucket.isin(touched), bucket).otherwise(foreign.cast("int")))
        folder = f"{PENDING}-{uuid.uuid4().hex}"
        write_slices(placed.observe(kept, F.collect_set(bucket_col).alias("buckets")), f"{path}/{folder}", bucket_col)
        layout["pending"] = {"folder": folder, "full": sorted(kept.get["buckets"]), "touched": touched}
    if delivery is not None:
        layout["deliveries"] = layout.get("deliveries", {}) | {delivery[0]: delivery[1]}
    if touched or delivery is not None:
        layouts.write_layout(spark, path, layout)
        finish_merge(spark, path, bucket_col)
    return touched


PENDING = "_merged"


def finish_merge(spark: SparkSession, path: str, bucket_col: str = "bucket") -> dict:
    """Move in the buckets of a merge that was decided but not ended, and return the table's layout.

    Each step can run again: a bucket whose new folder is gone has been moved already.
    """
    layout = layouts.read_layout(spark, path)
    pending = layout.get("pending")
    if pending is None:
        return layout
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in pending["touched"]:
        name = f"{bucket_col}={bucket}"
        new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pending['folder']}/{name}")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if bucket not in pending["full"]:
            files.delete(target, True)
        elif files.exists(new):
            files.delete(target, True)
            if not files.rename(new, target):
                raise LayoutError(f"could not move {new} to {target}")
    layout.pop("pending")
    layouts.write_layout(spark, path, layout)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pending['folder']}"), True)
    return layout


def create_buckets(
    df: DataFrame, path: str, key: str, buckets: int = 256, bucket_col: str = "bucket", delivery: tuple[str, int] | None = None
) -> None:
    """First write of a table for `merge_buckets`, with its layout beside it.

    The layout comes last and makes the table exist; what a job that died before it has left is replaced.
    """
    overwrite_table(df.withColumn(bucket_col, _bucket_of(key, buckets)).hint("rebalance", F.col(bucket_col)), path, bucket_col)
    layout = {"key": key, "type": df.schema[key].dataType.simpleString(), "buckets": str(buckets)}
    layout["schema"] = layouts.evolve(df.schema, df.schema).jsonValue()
    if delivery is not None:
        layout["deliveries"] = {delivery[0]: delivery[1]}
    layouts.write_layout(df.sparkSession, path, layout)


def upsert_table(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    first: Callable[[DataFrame], DataFrame],
    buckets: int = 256,
    delivery: tuple[str, int] | None = None,
) -> None:
    """`merge_buckets` on a table that may not exist yet; `first(batch)` is its start state."""
    if path_exists(spark, f"{path}/{layouts.LAYOUT}"):
        merge_buckets(spark, path, batch, key, merge, buckets, delivery=delivery)
    else:
        create_buckets(first(batch), path, key, buckets, delivery=delivery)


def _with_buckets(spark: SparkSession, path: str, schema: T.StructType, bucket_col: str) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, T.StructField(bucket_col, T.IntegerType())])).parquet(path)


def read_buckets(spark: SparkSession, path: str, bucket_col: str = "bucket") -> DataFrame:
    """A table written by `upsert_table`, with all its columns whatever file has them, without its layout column.

    The stored schema is used, so no file is opened for it. A merge that was decided but not ended is ended first.
    """
    schema = layouts.schema_of(finish_merge(spark, path, bucket_col))
    if schema is None:
        return spark.read.option("mergeSchema", True).parquet(path).drop(bucket_col)
    return _with_buckets(spark, path, schema, bucket_col).drop(bucket_col)


def write_evolving(df: DataFrame, path: str, col: str, packed: bool = False) -> None:
    """`write_slices` on a table whose columns grow: its schema is stored and widened (`layouts.evolve`), old slices stay as they are."""
    spark = df.sparkSession
    if path_exists(spark, f"{path}/{layouts.LAYOUT}"):
        known = layouts.read_layout(spark, path)
    else:
        # Slices that were written before the schema was kept are read once for theirs.
        known = {"slice": col}
        if has_slices(spark, path):
            known["schema"] = spark.read.option("mergeSchema", True).parquet(path).schema.jsonValue()
    if known["slice"] != col:
        raise LayoutError(f"{path} is sliced by {known['slice']}, not by {col}")
    old = layouts.schema_of(known)
    schema = layouts.evolve(old or df.schema, df.schema)
    if schema != old:
        layouts.write_layout(spark, path, known | {"schema": schema.jsonValue()})
    write_slices(layouts.aligned(df, schema), path, col, packed)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """A table of `write_evolving` by its stored schema: no footer of old slices is read to find their columns."""
    return spark.read.schema(layouts.schema_of(layouts.read_layout(spark, path))).parquet(path)
