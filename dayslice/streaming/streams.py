"""Streams over landing folders. Each reuses a batch operator and gives the batch answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import new_dir
from ..sources.writers import upsert_table


def stream_landing(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files as they land, with a stated schema and a bounded batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        # A header that differs from the schema stops the stream instead of shifting columns.
        reader = reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Zone-less timestamps cannot carry a watermark; read them as UTC instants."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return df.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.lit(zone), ts).cast("timestamp"))
    return df


def stream_dedup(df: DataFrame, key: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop copies of an event that arrive within the delay; state older than it is freed."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def tumbling(ts: str, size: str, slide: str | None = None) -> Column:
    return F.window(ts, size) if slide is None else F.window(ts, size, slide)


def session_of(ts: str, gap: str) -> Column:
    return F.session_window(ts, gap)


@contextmanager
def local_sessions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside merge the rows of a session in their own task before the shuffle: for few or hot keys."""
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_metrics(
    df: DataFrame,
    ts: str,
    frame: Column,
    keys: Sequence[str],
    aggs: Sequence[Column],
    delay: str = "1 hour",
) -> DataFrame:
    """Windowed metrics per key; `frame` is a tumbling, sliding or session window of `ts`.

    On a batch frame the watermark is ignored, so the same call gives the batch answer.
    """
    timed = event_time(df, ts).withWatermark(ts, delay)
    grouped = timed.groupBy(frame, *keys).agg(*aggs)
    name = grouped.columns[0]
    return grouped.select(
        F.col(f"{name}.start").alias("window_start"),
        F.col(f"{name}.end").alias("window_end"),
        *keys,
        *[c for c in grouped.columns if c not in {name, *keys}],
    )


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> None:
    """Process everything that has landed, write it to a folder, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that a checkpoint belongs to; batch numbers grow under this id, also over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def foreach_batch_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    first: Callable[[DataFrame], DataFrame],
    buckets: int = 64,
    applied: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Merge each micro-batch into a bucketed table, once.

    The checkpoint's id and the number of the last batch are stored with the table and decided together with its data
    (`writers.merge_buckets`), so a batch that is delivered again after a failure is left out, and `merge(target, batch)` may add up.
    `first(batch)` is the table made from the first batch. Only the buckets a batch touches are rewritten. `applied` is called after
    each batch. With `merge_changes` the batches may come in any order; with `apply_cdc` changes of a key have to
    come in order from batch to batch. A checkpoint that is thrown away starts another stream: its batches all apply.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upsert_table(spark, path, batch, key, merge, first, buckets, (query_id(spark, checkpoint), batch_id))
        if applied is not None:
            applied(batch_id)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed and return the written result as a batch frame."""
    spark = stream.sparkSession
    path, checkpoint = new_dir(spark, label), new_dir(spark, f"{label}-state")
    schema = stream.schema
    run_available(stream, path, checkpoint, mode)
    return spark.read.schema(schema).parquet(path)


def drain_landings(stream: DataFrame, landings: Iterable[Callable[[], None]], label: str) -> DataFrame:
    """`drain` with a run after each landing; a landing is a function that puts files where the stream looks.

    All files of a landing are one micro-batch, so the watermark moves between landings only and not with each file, and the
    number of batches follows that of landings, not of files. The stream must not bound its batches.
    """
    spark = stream.sparkSession
    path, checkpoint = new_dir(spark, label), new_dir(spark, f"{label}-state")
    schema = stream.schema
    for land in landings:
        land()
        run_available(stream, path, checkpoint)
    return spark.read.schema(schema).parquet(path)


def drain_complete(stream: DataFrame, label: str) -> DataFrame:
    """Run an aggregating stream over what has landed and return its complete result.

    Appending would hold windows back until the watermark passes them; here every batch
    replaces the result table with all windows so far.
    """
    spark = stream.sparkSession
    path, checkpoint = new_dir(spark, label), new_dir(spark, f"{label}-state")

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.foreachBatch(replace)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
