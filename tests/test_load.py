"""Load patterns: repeatable, order independent where promised, and guarded."""

from __future__ import annotations

import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dayslice.errors import DuplicateKeyError, LayoutError
from dayslice.operators import load
from dayslice.sources import writers
from dayslice.sources.readers import read_partitioned

from .conftest import d, rows


def test_slice_replaced_twice_is_the_same(spark, six_orders):
    day = six_orders.where("order_date = DATE '2026-01-15'").withColumn("amount", F.lit(1.0))
    once = load.replace_slice(six_orders, day, "order_date", "2026-01-15")
    twice = load.replace_slice(once, day, "order_date", "2026-01-15")
    assert rows(once) == rows(twice) and once.count() == 6
    assert rows(once.where("order_id = 6"), "amount") == [(80.0,)]


def test_foreign_row_in_a_slice_fails(six_orders):
    with pytest.raises(PySparkException, match="outside slice"):
        load.replace_slice(six_orders, six_orders, "order_date", "2026-01-15").count()


def test_undated_rows_survive_slices_and_deletes(spark):
    tgt = spark.createDataFrame([(1, None), (2, d("2026-01-01"))], "id int, on date")
    src = spark.createDataFrame([(3, d("2026-01-01"))], "id int, on date")
    assert rows(load.replace_slice(tgt, src, "on", "2026-01-01"), "id") == [(1,), (3,)]
    assert rows(load.delete_range(tgt, "on", "2026-01-01", "2026-01-31"), "id") == [(1,)]


def test_sink_replaces_one_day_only(spark, root, six_orders):
    path = f"{root}/t"
    writers.write_slices(six_orders, path, "order_date")
    day = six_orders.where("order_id = 1")
    assert writers.write_slice(day, path, "order_date", "2026-01-15") == 1
    assert rows(read_partitioned(spark, path), "order_id") == [(1,), (6,)]


def test_empty_slice_clears_the_day(spark, root, six_orders):
    path = f"{root}/t"
    writers.write_slices(six_orders, path, "order_date")
    assert writers.write_slice(six_orders.where("false"), path, "order_date", "2026-01-15") == 0
    assert rows(read_partitioned(spark, path), "order_id") == [(6,)]


def test_failed_write_leaves_the_old_day(spark, root, six_orders):
    path = f"{root}/t"
    writers.write_slices(six_orders, path, "order_date")
    with pytest.raises(PySparkException):
        writers.write_slice(six_orders, path, "order_date", "2026-01-15")
    assert read_partitioned(spark, path).count() == 6


def test_packed_slice_is_neither_shuffled_nor_sorted(spark, root, six_orders):
    path = f"{root}/t"
    writers.write_slices(six_orders, path, "order_date")
    day = six_orders.where("order_id <> 6").repartition(3)
    assert writers.write_slice(day, path, "order_date", "2026-01-15", packed=True) == 5
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = runs.apply(runs.size() - 1).physicalPlanDescription()
    # The frame's own shuffle, in the final and in the initial plan.
    assert "WriteFiles" in plan and plan.count("- Exchange") == 2 and "- Sort" not in plan
    with pytest.raises(PySparkException, match="outside slice"):
        writers.write_slice(six_orders, path, "order_date", "2026-01-15", packed=True)
    assert rows(read_partitioned(spark, path)) == rows(six_orders)
    assert read_partitioned(spark, path).schema["order_date"].dataType == six_orders.schema["order_date"].dataType
    assert writers.write_slice(day.where("false"), path, "order_date", "2026-01-15", packed=True) == 0
    assert rows(read_partitioned(spark, path), "order_id") == [(6,)]


def test_type_one_upsert(spark):
    cols = "id int, name string, first_seen_date date, last_updated_date date"
    dim = spark.createDataFrame([(1, "old", d("2026-01-01"), d("2026-01-01")), (2, "stay", d("2026-01-01"), d("2026-01-01"))], cols)
    day = spark.createDataFrame([(1, "new"), (1, "new"), (3, None)], "id int, name string")
    once = load.upsert_scd1(dim, day, ["id"], ["name"], "2026-01-02")
    assert rows(once) == [
        (1, "new", d("2026-01-01"), d("2026-01-02")),
        (2, "stay", d("2026-01-01"), d("2026-01-01")),
        (3, None, d("2026-01-02"), d("2026-01-02")),
    ]
    assert rows(load.upsert_scd1(once, day, ["id"], ["name"], "2026-01-02")) == rows(once)


def test_upserts_refuse_a_repeated_key(spark):
    tgt = spark.createDataFrame([(1, "a")], "id int, v string")
    src = spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
    with pytest.raises(PySparkException, match="several source rows"):
        load.upsert_all(tgt, src, ["id"]).count()
    with pytest.raises(DuplicateKeyError, match="1 keys"):
        load.assert_unique_source(src, ["id"])
    assert rows(load.upsert_dedup(tgt, src, ["id"], ["v"])) == [(1, "b")]
    assert rows(load.upsert_dedup(tgt, src, ["id"], ["v"], latest=True)) == [(1, "c")]


def test_upsert_all_accepts_new_columns(spark):
    tgt = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    src = spark.createDataFrame([(2, "B", 5), (3, "C", 6)], "id int, v string, n int")
    assert rows(load.upsert_all(tgt, src, ["id"])) == [(1, "a", None), (2, "B", 5), (3, "C", 6)]


def test_insert_missing_and_update_where(spark):
    tgt = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    src = spark.createDataFrame([(2, "z"), (3, "c"), (3, "d")], "id int, v string")
    assert rows(load.insert_missing(tgt, src, ["id"], ["v"])) == [(1, "a"), (2, "b"), (3, "c")]
    changed = load.update_where(tgt, src, ["id"], {"v": F.concat("v", F.lit("!"))})
    assert rows(changed) == [(1, "a"), (2, "b!")]


def _cdc_batch(spark, n=1000):
    """n inserts, n/5 late updates, n/10 tombstones and n/20 duplicate retries."""
    ids = spark.range(1, n + 1).select(F.col("id").alias("event_id"), (F.lit(10.0) + F.pmod("id", F.lit(500)) * 1.5).alias("amount"))

    def at(df, op, hour):
        return df.select("event_id", "amount", F.lit(op).alias("op"), F.lit(f"2026-01-15 {hour}:00:00").cast("timestamp").alias("updated_at"))

    return (
        at(ids, "I", "09")
        .unionByName(at(ids.where(f"event_id <= {n // 5}").withColumn("amount", F.col("amount") + 100), "U", "15"))
        .unionByName(at(ids.where(f"event_id > {n * 9 // 10}").withColumn("amount", F.lit(None).cast("double")), "D", "18"))
        .unionByName(at(ids.where(f"event_id <= {n // 20}"), "I", "09"))
    )


def test_change_data_golden_numbers(spark):
    batch = _cdc_batch(spark)
    assert batch.count() == 1350
    empty = spark.createDataFrame([], "event_id bigint, amount double, updated_at timestamp")
    once = load.apply_cdc(empty, batch, ["event_id"], ["updated_at"])
    assert once.count() == 900
    assert rows(once.where("event_id = 1"), "amount") == [(111.5,)]
    assert once.where("event_id = 901").count() == 0
    assert rows(load.apply_cdc(once, batch, ["event_id"], ["updated_at"])) == rows(once)


def test_any_order_of_dates_and_batches_gives_one_table(spark):
    dim = spark.createDataFrame([], "id int, name string, first_seen_date date, last_updated_date date")
    days = {"2026-01-02": [(1, "b")], "2026-01-01": [(1, "a"), (2, "x")], "2026-01-03": [(2, "y"), (3, "z")]}
    log = [(1, "I", 1.0, 1), (1, "D", None, 4), (2, "I", 2.0, 2), (1, "U", 5.0, 3), (2, "U", 7.0, 6), (3, "D", None, 5), (3, "I", 9.0, 1)]
    schema, batches = "id int, op string, v double, t int", (log[:2], log[2:5], log[5:])
    tables, changes = set(), set()
    for order in itertools.permutations(range(3)):
        table, state = dim, spark.createDataFrame([], schema)
        for i in (*order, order[0]):
            ds = list(days)[i]
            table = load.upsert_scd1(table, spark.createDataFrame(days[ds], "id int, name string"), ["id"], ["name"], ds)
            state = load.merge_changes(state, spark.createDataFrame(batches[i], schema), ["id"], ["t"])
        tables.add(tuple(rows(table)))
        changes.add(tuple(rows(load.live(state))))
    assert tables == {(
        (1, "b", d("2026-01-01"), d("2026-01-02")), (2, "y", d("2026-01-01"), d("2026-01-03")), (3, "z", d("2026-01-03"), d("2026-01-03")),
    )}
    assert changes == {((2, 7.0, 6),)}


def test_delete_of_an_absent_key_is_nothing(spark):
    tgt = spark.createDataFrame([(1, 1.0)], "id int, v double")
    change = spark.createDataFrame([(9, None, "D", 1)], "id int, v double, op string, t int")
    assert rows(load.apply_cdc(tgt, change, ["id"], ["t"])) == [(1, 1.0)]


def _activity_days(spark):
    daily = [
        (d("2026-06-26"), "ad1", "c1", 0.1), (d("2026-06-26"), "ad2", "c1", 0.2),
        (d("2026-06-27"), "ad1", "c2", 0.3), (d("2026-06-28"), "ad3", "c3", 0.4),
    ]
    return spark.createDataFrame(daily, "event_date date, ad_id string, campaign_id string, ctr double")


def test_activity_is_independent_of_day_order(spark):
    daily = _activity_days(spark)
    attrs = {"campaign_id": "campaign_id", "latest_ctr": "ctr"}
    empty = spark.createDataFrame(
        [], "ad_id string, campaign_id string, first_seen_date date, last_active_date date, latest_ctr double"
    )
    answers = set()
    days = ["2026-06-26", "2026-06-27", "2026-06-28"]
    for order in itertools.permutations(days):
        dim = empty
        for ds in (*order, order[0]):
            dim = load.upsert_activity(dim, daily.where(F.col("event_date") == d(ds)), "ad_id", ds, attrs)
        answers.add(tuple(rows(dim)))
    whole = load.activity_from_history(daily, "ad_id", "event_date", attrs).select(empty.columns)
    assert answers == {tuple(rows(whole))}
    assert rows(whole)[0] == ("ad1", "c2", d("2026-06-26"), d("2026-06-27"), 0.3)


def test_backfill_equals_the_day_loop(spark, six_orders):
    from dayslice.plans.orders import customer_daily

    days = ["2026-01-15", "2026-01-16"]
    loop = load.backfill_days(lambda ds: customer_daily(six_orders, ds), days)
    assert rows(loop) == rows(customer_daily(six_orders))


def test_snapshots_read_back_as_of_a_day(spark):
    one = load.snapshot(spark.createDataFrame([(1, 5)], "id int, n int"), "2026-06-01")
    two = load.snapshot(spark.createDataFrame([(1, 7)], "id int, n int"), "2026-06-03")
    both = one.unionByName(two)
    assert rows(load.read_as_of(both, "snapshot_date", "2026-06-02"), "n") == [(5,)]
    assert rows(load.read_as_of(both, "snapshot_date", "2026-06-03"), "n") == [(7,)]
    assert load.read_as_of(both, "snapshot_date", "2026-05-31").count() == 0


def test_bucket_merge_rewrites_only_touched_buckets(spark, root):
    path = f"{root}/b"
    tgt = spark.range(100).select(F.col("id"), F.lit(0).alias("v"))
    writers.create_buckets(tgt, path, "id", 16)
    files = {r.path for r in spark.read.format("binaryFile").load(f"{path}/*/*.parquet").select("path").collect()}
    batch = spark.createDataFrame([(3, 1), (500, 2)], "id bigint, v int")
    touched = writers.merge_buckets(spark, path, batch, "id", lambda o, n: load.upsert_all(o, n, ["id"]), 16)
    after = {r.path for r in spark.read.format("binaryFile").load(f"{path}/*/*.parquet").select("path").collect()}
    assert 1 <= len(touched) <= 2 and len(files & after) >= 14
    table = writers.read_buckets(spark, path)
    assert table.count() == 101 and rows(table.where("v > 0")) == [(3, 1), (500, 2)]


def test_bucket_merge_loses_no_row(spark, root):
    path = f"{root}/b"
    writers.create_buckets(spark.range(1000).select("id", F.lit(0).alias("v")), path, "id", 16)

    def upsert(old, new):
        return load.upsert_all(old, new, ["id"])

    one = spark.createDataFrame([(7, 1)], "id int, v int")
    writers.merge_buckets(spark, path, one, "id", upsert)
    table = writers.read_buckets(spark, path)
    assert table.count() == 1000 and table.schema["id"].dataType.simpleString() == "bigint"
    with pytest.raises(LayoutError):
        writers.merge_buckets(spark, path, one, "id", upsert, 8)
    with pytest.raises(LayoutError):
        writers.merge_buckets(spark, path, one, "v", upsert)
    many = spark.range(500, 3000).select(F.col("id").cast("string").alias("id"), F.lit(2).alias("v"))
    for _ in range(2):
        assert writers.merge_buckets(spark, path, many, "id", upsert, 16) == list(range(16))
    assert rows(writers.read_buckets(spark, path).groupBy("v").count()) == [(0, 499), (1, 1), (2, 2500)]
    # A merge that makes rows of other buckets must not replace what it has not read.
    with pytest.raises(Exception, match="not read"):
        writers.merge_buckets(spark, path, one, "id", lambda o, n: o.unionByName(n).withColumn("id", F.col("id") + 1))
    assert writers.read_buckets(spark, path).count() == 3000
    with pytest.raises(LayoutError):
        writers.merge_buckets(spark, f"{root}/none", one, "id", upsert)


def test_bucket_count_follows_the_size():
    assert [writers.bucket_count(n << 20) for n in (0, 1, 128, 129, 1000)] == [1, 1, 1, 2, 8]


def test_slices_deleted_on_disk(spark, root, six_orders):
    writers.write_slices(six_orders, f"{root}/t", "order_date")
    assert writers.delete_slices(spark, f"{root}/t", "order_date", "2026-01-10", "2026-01-15") == [d("2026-01-15")]
    assert rows(read_partitioned(spark, f"{root}/t"), "order_id") == [(6,)]
