"""Streams give the batch answer, also over several micro-batches and after a restart."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from check_oracle import compare
from dayslice.operators import load
from dayslice.sources import writers
from dayslice.streaming import streams
from workload import all_queries

from .conftest import rows

SCHEMA = "id bigint, user int, op string, v int, ts timestamp_ntz"


def _land(spark, root, batches):
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "id bigint, user int, op string, v int, at string")
        df.select("id", "user", "op", "v", F.col("at").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{root}/in/b{i}")
    return streams.stream_landing(spark, f"{root}/in/*", SCHEMA, files_per_batch=1)


BATCHES = [
    [(1, 1, "I", 10, "2026-01-01 00:00:00"), (2, 2, "I", 20, "2026-01-01 00:01:00"), (2, 2, "I", 20, "2026-01-01 00:01:00")],
    [(2, 2, "I", 20, "2026-01-01 00:01:00"), (3, 1, "U", 11, "2026-01-01 00:10:00")],
    [(4, 2, "D", 0, "2026-01-01 00:20:00"), (5, 3, "I", 30, "2026-01-01 00:30:00")],
]


def test_dedup_over_batches(spark, root):
    stream = _land(spark, root, BATCHES)
    out = streams.drain(streams.stream_dedup(stream, ["id"], "ts", "1 hour"), "dedup")
    assert rows(out, "id") == [(1,), (2,), (3,), (4,), (5,)]


def test_windows_equal_the_batch_form(spark, root):
    stream = _land(spark, root, BATCHES)
    batch = spark.read.schema(SCHEMA).parquet(f"{root}/in/*")
    for frame in (streams.tumbling("ts", "10 minutes"), streams.tumbling("ts", "20 minutes", "10 minutes"), streams.session_of("ts", "5 minutes")):
        live = streams.stream_metrics(stream, "ts", frame, ["user"], [F.count("*").alias("n"), F.sum("v").alias("v")])
        still = streams.stream_metrics(batch, "ts", frame, ["user"], [F.count("*").alias("n"), F.sum("v").alias("v")])
        assert rows(streams.drain_complete(live, "win")) == rows(still)


def test_change_data_in_micro_batches_and_a_restart(spark, root):
    stream = _land(spark, root, BATCHES)
    empty = spark.createDataFrame([], "id bigint, user int, v int, ts timestamp_ntz")

    def merge(old, new):
        return load.apply_cdc(old, new, ["user"], ["ts"])

    for _ in range(2):
        query = streams.foreach_batch_upsert(
            stream, f"{root}/out", f"{root}/state", "user", merge, lambda b: merge(empty, b), buckets=4
        )
        query.awaitTermination()
    assert rows(writers.read_buckets(spark, f"{root}/out"), "user", "v") == [(1, 11), (3, 30)]


def test_landing_appends_once(spark, root):
    stream = _land(spark, root, BATCHES)
    for _ in range(2):
        streams.run_available(stream, f"{root}/copy", f"{root}/copy-state")
    assert spark.read.parquet(f"{root}/copy").count() == 7


def _many_files(spark, root):
    """Events of a month, an hour apart for each of two users, in files of no order."""
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) * 30)")
    kind = F.element_at(F.array(F.lit("click"), F.lit("view")), (F.col("id") % 2 + 1).cast("int"))
    events = spark.range(1400).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 2).alias("user_id"), kind.alias("event_type"), F.lit(1.25).alias("value"), F.lit("").alias("props")
    )
    events.repartition(6, "event_id").write.parquet(f"{root}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{root}/events.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["stream_dedup", "stream_tumbling_append", "stream_sliding", "stream_sessions_by_user"])
def test_a_landing_of_many_files_is_one_batch(spark, root, monkeypatch, name):
    """The watermark of one file must not drop rows of the next one of its landing, and more files make no more batches."""
    con, batches = _many_files(spark, root), []
    real = streams.run_available

    def noted(stream, path, checkpoint, *rest):
        real(stream, path, checkpoint, *rest)
        batches.append(sum(n.isdigit() for n in os.listdir(f"{checkpoint}/offsets")))

    monkeypatch.setattr(streams, "run_available", noted)
    ok, note, _ = compare(spark, con, all_queries()[name], root)
    assert ok, note
    # At most one more for each landing, without rows, that ends windows.
    assert batches[-1] <= 2 * (4 if name == "stream_dedup" else 6)
