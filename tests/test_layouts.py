"""Tables whose columns grow, merges that die half way, and deliveries that come twice."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayslice.errors import LayoutError, SchemaDriftError
from dayslice.operators import load
from dayslice.operators.layout import plan_text
from dayslice.sources import layouts, writers
from dayslice.streaming import streams

from .conftest import d, rows


def upsert(old, new):
    return load.upsert_all(old, new, ["k"])


def table(spark, root, n=200, buckets=16):
    path = f"{root}/t"
    writers.create_buckets(spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("v")), path, "k", buckets)
    return path


def test_added_column_stays_over_later_merges(spark, root):
    path = table(spark, root)
    writers.merge_buckets(spark, path, spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (900, 7, "c")], "k int, v int, w string"), "k", upsert)
    writers.merge_buckets(spark, path, spark.range(3, 200).select(F.col("id").cast("int").alias("k"), F.lit(9).alias("v")), "k", upsert)
    whole = writers.read_buckets(spark, path)
    assert whole.columns == ["k", "v", "w"] and whole.count() == 201
    assert rows(whole.where("w IS NOT NULL")) == [(1, 5, "a"), (2, 6, "b"), (900, 7, "c")]
    # The stored schema is used: no job is needed to know the columns.
    assert layouts.schema_of(layouts.read_layout(spark, path)).names == ["k", "v", "w"]


def test_types_widen_and_never_narrow(spark, root):
    path = table(spark, root, 20, 4)
    big = spark.createDataFrame([(1, 1 << 40)], "k int, v bigint")
    writers.merge_buckets(spark, path, big, "k", upsert)
    writers.merge_buckets(spark, path, spark.createDataFrame([(2, 3)], "k int, v smallint"), "k", upsert)
    whole = writers.read_buckets(spark, path)
    assert whole.schema["v"].dataType == T.LongType()
    assert rows(whole.where("k in (0, 1, 2)")) == [(0, 0), (1, 1 << 40), (2, 3)]
    with pytest.raises(SchemaDriftError, match="v is bigint"):
        writers.merge_buckets(spark, path, spark.createDataFrame([(1, "x")], "k int, v string"), "k", upsert)
    with pytest.raises(LayoutError, match="loses"):
        writers.merge_buckets(spark, path, big, "k", lambda old, new: old.select("k"))
    assert writers.read_buckets(spark, path).count() == 20


@pytest.mark.parametrize(("old", "new", "wide"), [
    ("int", "bigint", "bigint"), ("bigint", "tinyint", "bigint"), ("float", "double", "double"), ("decimal(10,2)", "decimal(18,2)", "decimal(18,2)"),
    ("decimal(18,2)", "decimal(20,4)", "decimal(20,4)"), ("void", "string", "string"), ("int", "string", None), ("decimal(18,2)", "decimal(18,4)", None),
    ("date", "timestamp", None), ("bigint", "double", None), ("array<int>", "array<int>", "array<int>"),
])
def test_the_wider_type(spark, old, new, wide):
    types = [spark.sql(f"SELECT CAST(NULL AS {t}) AS c").schema["c"].dataType for t in (old, new)]
    found = layouts.wider(*types)
    assert (found.simpleString() if found else None) == wide


class Died(RuntimeError):
    pass


def test_a_merge_dies_before_or_after_its_decision(spark, root, monkeypatch):
    path = table(spark, root, 50, 4)
    batch = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (77, 1)], "k int, v int")

    def add(old, new):
        return old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))

    real = layouts.write_layout

    def no_decision(spark, path, layout):
        if "pending" in layout:
            raise Died
        real(spark, path, layout)

    monkeypatch.setattr(layouts, "write_layout", no_decision)
    with pytest.raises(Died):
        writers.merge_buckets(spark, path, batch, "k", add, delivery=("s", 0))
    monkeypatch.setattr(layouts, "write_layout", real)
    assert rows(writers.read_buckets(spark, path).where("v > 0")) == []

    move, calls = writers.finish_merge, []

    def no_move(spark, path, bucket_col="bucket"):
        calls.append(1)
        if len(calls) == 3:  # start of the merge, its read, then the move
            raise Died
        return move(spark, path, bucket_col)

    monkeypatch.setattr(writers, "finish_merge", no_move)
    with pytest.raises(Died):
        writers.merge_buckets(spark, path, batch, "k", add, delivery=("s", 0))
    monkeypatch.setattr(writers, "finish_merge", move)
    # Decided: the next writer finds the batch applied, and the next reader moves it in.
    assert writers.merge_buckets(spark, path, batch, "k", add, delivery=("s", 0)) == []
    assert rows(writers.read_buckets(spark, path).where("v > 0")) == [(1, 1), (2, 1), (3, 1), (77, 1)]
    assert "pending" not in layouts.read_layout(spark, path)
    writers.merge_buckets(spark, path, batch, "k", add, delivery=("s", 1))
    assert rows(writers.read_buckets(spark, path).where("v > 0"), "v") == [(2,)] * 4


def test_counters_count_once_over_a_restart(spark, root):
    for i in range(4):
        spark.createDataFrame([(j, i) for j in range(10)], "k int, v int").coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = streams.stream_landing(spark, f"{root}/in/*", "k int, v int", files_per_batch=1)

    def merge(old, new):
        return old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))

    def die(batch_id):
        if batch_id == 2:
            raise Died

    run = streams.foreach_batch_upsert(stream, f"{root}/out", f"{root}/state", "k", merge, lambda b: b, 4, die)
    with pytest.raises(StreamingQueryException):
        run.awaitTermination()
    streams.foreach_batch_upsert(stream, f"{root}/out", f"{root}/state", "k", merge, lambda b: b, 4).awaitTermination()
    assert rows(writers.read_buckets(spark, f"{root}/out")) == sorted([(j, 6) for j in range(10)], key=lambda t: str(t[0]))


def test_slices_keep_their_schema(spark, root, six_orders):
    path = f"{root}/s"
    writers.write_slices(six_orders.where("order_date = '2026-01-15'"), path, "order_date")  # before schemas were kept
    late = six_orders.where("order_date = '2026-01-16'").withColumn("channel", F.lit("web"))
    writers.write_evolving(late, path, "order_date")
    whole = writers.read_evolving(spark, path)
    assert set(whole.columns) == {*six_orders.columns, "channel"} and whole.count() == 6
    assert rows(whole.where("channel IS NOT NULL"), "order_id", "order_date") == [(6, d("2026-01-16"))]
    assert "PartitionFilters: [isnotnull" in plan_text(whole.where("order_date = DATE'2026-01-16'"))
    with pytest.raises(LayoutError):
        writers.write_evolving(late, path, "customer_id")


def test_change_tables_gain_columns(spark):
    old = spark.createDataFrame([(1, 1, "I", 5)], "k int, at int, op string, v int")
    new = spark.createDataFrame([(1, 2, "U", "x"), (2, 1, "I", "y")], "k int, at int, op string, w string")
    merged = load.merge_changes(old, new, ["k"], ["at"])
    assert rows(merged, "k", "v", "w") == [(1, None, "x"), (2, None, "y")]
    added = load.apply_cdc(old.drop("op"), new.withColumn("v", F.lit(None).cast("int")), ["k"], ["at"], add=["w"])
    assert rows(added, "k", "w") == [(1, "x"), (2, "y")]


def test_null_keys_keep_one_row(spark):
    dim = spark.createDataFrame([], "k int, name string, first_seen_date date, last_updated_date date")
    src = spark.createDataFrame([(None, "a"), (1, "b")], "k int, name string")
    for ds in ("2026-01-01", "2026-01-02"):
        dim = load.upsert_scd1(dim, src, ["k"], ["name"], ds)
    assert rows(dim) == [(1, "b", d("2026-01-01"), d("2026-01-02")), (None, "a", d("2026-01-01"), d("2026-01-02"))]
    act = spark.createDataFrame([], "k int, name string, first_seen_date date, last_active_date date")
    for ds in ("2026-01-01", "2026-01-02"):
        act = load.upsert_activity(act, src, "k", ds, {"name": "name"})
    assert rows(act) == [(1, "b", d("2026-01-01"), d("2026-01-02")), (None, "a", d("2026-01-01"), d("2026-01-02"))]
