"""Sources, intake, layout and plan evidence."""

from __future__ import annotations

import hashlib
import json
import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from dayslice.errors import EmptySourceError, SchemaDriftError
from dayslice.operators import layout, load
from dayslice.operators.joins import hot_keys, join_copartitioned, salted_counts, skew_join
from dayslice.plans.orders import category_revenue, state_gmv, top_order_per_customer
from dayslice.session import shared_dir, shuffle_partitions
from dayslice.sources import catalog, intake, readers, shipments, writers

from dayslice.operators.layout import plan_text
from workload import all_queries

from .conftest import d, rows


def _put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


HEADER = "external_order_id,shop_product_id,seller_sku,partner,order_date,quantity_sold,sale_price,platform_discount,commission_rate,net_revenue,settlement_date,status\n"


def _sale(partner, n):
    return f"{partner}-{n},{n},sku,{partner},2026-06-01,2,100,0,0.08,184,2026-06-16,completed\n"


def _landing(root):
    for partner, n in (("lazada", 1), ("shopee", 2), ("tiktok", 3)):
        text = HEADER + _sale(partner, n)
        path = f"{root}/{partner}/{partner}_20260601.csv"
        _put(path, text)
        digest = hashlib.md5(text.encode()).hexdigest() if partner != "tiktok" else "0" * 32
        _put(path + ".md5", digest + "\n")
    _put(f"{root}/newcomer/newcomer_20260601.csv", HEADER + _sale("", 4))


def test_only_verified_files_load(spark, root):
    _landing(root)
    manifest = intake.verify_checksums(spark, f"{root}/*/*.csv")
    name = F.regexp_extract("path", r"/([a-z]+)_\d+\.csv$", 1)
    assert rows(manifest.select(name, "ok")) == [
        ("lazada", True), ("newcomer", False), ("shopee", True), ("tiktok", False)
    ]
    loaded = intake.accepted_rows(readers.read_marketplace(spark, root)[0], manifest)
    assert rows(loaded, "partner", "net_revenue") == [("lazada", 184), ("shopee", 184)]


def test_new_partner_needs_no_code(spark, root):
    _landing(root)
    got = readers.read_marketplace(spark, root)[0].where("product_id = 4")
    assert rows(got, "partner") == [("newcomer",)]


def test_missing_days_per_partner(spark):
    listing = spark.createDataFrame([("a", d("2026-06-01")), ("a", d("2026-06-03")), ("b", d("2026-06-02"))], "partner string, file_date date")
    assert rows(intake.missing_files(listing, listing, "2026-06-01", "2026-06-03")) == [
        ("a", d("2026-06-02")), ("b", d("2026-06-01")), ("b", d("2026-06-03"))
    ]


def test_late_file_loads_only_its_date(spark):
    loaded = spark.createDataFrame([("a", d("2026-06-01"))], "partner string, file_date date")
    arrived = loaded.unionByName(spark.createDataFrame([("b", d("2026-06-02"))], loaded.schema))
    seen = []
    assert intake.replay_late(arrived, loaded, seen.append) == seen == [d("2026-06-02")]


def test_shipment_documents(spark, root):
    doc = {
        "shipments": [
            {"order_id": "1", "carrier": "ghn", "status": "delivered", "shipped_at": "2026-06-01T18:00:00+07:00",
             "actual_delivery_date": "2026-06-02T10:26:00+07:00", "estimated_delivery_date": "2026-06-03", "delivery_attempts": 1},
            {"order_id": "2", "carrier": None, "status": "picked_up", "shipped_at": "soon"},
        ],
        "count": 2, "not_found": ["3", "4"], "not_found_count": 2,
    }
    _put(f"{root}/a.json", json.dumps(doc) + "\n" + json.dumps({"shipments": [], "not_found": ["4"]}) + "\n")
    found, missing = shipments.parse_shipments(shipments.read_shipment_files(spark, root))
    first = found.where("order_id = '1'").first()
    assert (first.shipped_at.hour, first.delivered_at.day, first.estimated_delivery_date) == (11, 2, d("2026-06-03"))
    assert found.where("order_id = '2'").first().shipped_at is None
    assert rows(missing) == [("3",), ("4",)]


def test_json_partition_absent_is_empty(spark, root):
    empty = readers.read_json_partition(spark, root, "raw", "t", "2026-01-01", "a int")
    assert empty.count() == 0 and empty.columns == ["a"]
    df = spark.createDataFrame([(1,), (2,)], "a int")
    for _ in range(2):
        writers.write_json_partition(df, root, "raw", "t", "2026-01-01")
    assert rows(readers.read_json_partition(spark, root, "raw", "t", "2026-01-01", "a int")) == [(1,), (2,)]


def test_csv_day(spark, root):
    _put(f"{root}/2026-06-26.csv", "id,n\n1,5\n2,x\n")
    typed = readers.read_csv_day(spark, root, "2026-06-26", "id int, n int")
    with pytest.raises(Exception, match="n is no int"):
        typed.collect()
    assert readers.read_csv_day(spark, root, "2026-06-26").dtypes == [("id", "int"), ("n", "string")]
    _put(f"{root}/2026-06-27.csv", "n,other,id\n5,a,1\n,b,2\n")
    assert rows(readers.read_csv_day(spark, root, "2026-06-27", "id int, n int")) == [(1, 5), (2, None)]


def test_csv_lines_that_do_not_fit_are_kept_aside(spark, root):
    _put(f"{root}/a.csv", "id,n\n1,5\n3,7,9,9\n4\nabc,1\n5,\n")
    good, bad = readers.read_csv_checked(spark, f"{root}/a.csv", "n int, id int")
    assert rows(good, "n", "id") == [(5, 1), (None, 5)]
    assert rows(bad, "line", "reject_reason") == [("3,7,9,9", "wrong number of fields"), ("4", "wrong number of fields"), ("abc,1", "id is no int")]
    with pytest.raises(SchemaDriftError, match="amount"):
        readers.read_csv_checked(spark, f"{root}/a.csv", "id int, amount int")


def test_broken_shipment_documents_are_returned(spark):
    docs = ['{"shipments": [], "not_found": ["4"]}', '{"shipments": [{"order_id": "1"', "no json", None, '{"count": 0}', '{"not_found": ["1"]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, doc string")
    assert rows(shipments.shipment_rejects(df, "doc"), "id") == [(1,), (2,), (3,), (4,)]


def test_guards(spark):
    with pytest.raises(EmptySourceError, match="landing"):
        readers.assert_nonempty(spark.range(0), "landing")
    assert readers.date_series(spark, "2026-02-27", "2026-03-01").count() == 3
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", {}, part_col="id")
    split = readers.jdbc_options("jdbc:x", "t", {"user": "u"}, "id", (1, 1000), 8)
    assert (split["numPartitions"], split["upperBound"], split["user"]) == ("8", "1000", "u")
    assert "partitionColumn" not in readers.jdbc_options("jdbc:x", "t", {})


def test_tables_are_made_once_and_queried(spark, root):
    spec = catalog.TableSpec("default.people", "id int, on date", ("on",), f"{root}/people")
    catalog.ensure_tables(spark, [spec])
    spark.createDataFrame([(1, d("2026-01-01"))], "id int, on date").write.insertInto("default.people", overwrite=True)
    catalog.ensure_tables(spark, [spec])
    table = spark.table("default.people")
    assert rows(catalog.query_table(table, "id = 1", ["id"])) == [(1,)]
    assert rows(catalog.query_table(table, sql="SELECT count(*) AS n FROM tbl")) == [(1,)]
    assert rows(catalog.describe_table(table), "column", "type") == [("id", "int"), ("on", "date")]
    assert catalog.empty_table(spark, "a int").count() == 0
    spark.sql("DROP TABLE default.people")


def test_evolving_files_read_as_one_schema(spark, root):
    for ds, ddl, row in (("2026-06-26", "id string", ("a",)), ("2026-06-27", "id string, device string", ("b", "ios"))):
        day = spark.createDataFrame([row], ddl).withColumn("on", F.lit(d(ds)))
        writers.write_slice(day, f"{root}/t", "on", ds)
    assert rows(readers.read_partitioned(spark, f"{root}/t", merge=True), "id", "device") == [("a", None), ("b", "ios")]


def test_compaction_keeps_content(spark, root):
    spark.range(1000).repartition(20).write.parquet(f"{root}/small")
    report = layout.compact(spark, f"{root}/small", f"{root}/big")
    assert rows(report, "stage", "n_files", "n_rows") == [("after", 1, 1000), ("before", 20, 1000)]


def test_compaction_into_one_file_whatever_the_size(spark, root, monkeypatch):
    """The query's table is far above the target here, as 60 times sf0.1 is above 128 MB."""
    spark.range(1000).repartition(20).write.parquet(f"{root}/small")
    monkeypatch.setattr(layout, "compact", partial(layout.compact, target_mb=0.001))
    report = layout.compact(spark, f"{root}/small", f"{root}/big", n_files=1)
    assert rows(report, "stage", "n_files", "n_rows") == [("after", 1, 1000), ("before", 20, 1000)]
    spark.range(1000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{root}/orders.parquet")
    report = all_queries()["compact_files"].run(spark, root)
    assert rows(report, "stage", "n_files", "n_rows") == [("after", 1, 1000), ("before", 24, 1000)]


def test_switch_points_a_table_at_new_files(spark, root):
    for name, n in (("old", 3), ("new", 5)):
        spark.range(n).write.parquet(f"{root}/{name}")
    spark.sql(f"CREATE TABLE switched USING parquet LOCATION '{root}/old'")
    layout.switch_location(spark, "switched", f"{root}/new")
    assert spark.table("switched").count() == 5
    spark.sql("DROP TABLE switched")


def test_day_query_opens_one_folder(spark, root):
    flat = spark.range(220).select("id", F.timestamp_add("DAY", (F.col("id") % 22).cast("int"), F.lit("2026-07-01").cast("timestamp_ntz")).alias("bought_at"))
    layout.partition_flat(flat, f"{root}/by_day", "bought_at")
    one = readers.read_partitioned(spark, f"{root}/by_day").where(F.col("order_date") == d("2026-07-07"))
    assert "PartitionFilters: [isnotnull(order_date" in layout.plan_text(one, "simple")
    assert one.select("_metadata.file_path").distinct().count() == 1 and one.count() == 10


def _sales(spark, root):
    orders = spark.range(2100).select(
        F.col("id").alias("order_id"), F.date_add(F.lit(d("2026-07-01")), (F.col("id") % 21).cast("int")).alias("order_date"),
        F.lit(None).cast("string").alias("coupon_code"),
    ).withColumn("approved_at", F.date_add("order_date", (F.col("order_id") % 3).cast("int")))
    items = orders.select("order_id", "order_date", F.lit("toys").alias("product_category"), F.lit(2.5).alias("price"))
    layout.write_compact(orders, f"{root}/orders", "order_date")
    layout.write_compact(items, f"{root}/items", "order_date")
    return spark.read.parquet(f"{root}/orders"), spark.read.parquet(f"{root}/items")


def test_lagged_filter_prunes_both_sides(spark, root):
    orders, items = _sales(spark, root)
    out = category_revenue(orders, items, "2026-07-07", "2026-07-08", max_lag_days=2)
    pruned = [line for line in layout.plan_text(out).splitlines() if line.startswith("PartitionFilters")]
    assert len(pruned) >= 2 and all("order_date" in line and "2026-07-05" in line for line in pruned)
    plain = orders.where("approved_at = DATE '2026-07-07'").join(items.drop("order_date"), "order_id")
    assert rows(out, "items_sold") == [(plain.count(),)]


def test_join_on_the_slice_column(spark, root):
    orders, items = _sales(spark, root)
    day = orders.where(F.col("order_date") == d("2026-07-07"))
    joined = join_copartitioned(day, items, ["order_id"], "order_date")
    assert joined.count() == 100


def test_clustering_narrows_ranges(spark, root):
    layout.cluster_by(spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k")), ["k"], 10).write.parquet(f"{root}/c")
    spans = spark.read.parquet(f"{root}/c").groupBy("_metadata.file_path").agg((F.max("k") - F.min("k")).alias("w")).collect()
    assert len(spans) == 10 and max(r.w for r in spans) < 2_000


def test_pushdown_and_pruned_columns(spark, root):
    spark.range(100).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(f"{root}/p")
    plan = layout.plan_text(spark.read.parquet(f"{root}/p").where("id > 50").select("b"), "formatted")
    assert "GreaterThan(id,50)" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_lag_prune_fails_on_rows_that_break_the_bound(spark):
    df = spark.createDataFrame([(1, d("2026-01-02"), d("2026-01-01")), (2, d("2026-01-09"), d("2026-01-01")), (3, d("2025-12-31"), d("2026-01-01")), (4, None, d("2026-01-01"))], "id int, ts date, part date")
    assert rows(layout.lag_prune(df.where("id in (1, 4)"), "ts", "2026-01-01", "2026-01-05", "part", 2), "id") == [(1,)]
    for i in (2, 3):
        with pytest.raises(Exception, match="outside"):
            layout.lag_prune(df.where(f"id = {i}"), "ts", "2026-01-01", "2026-01-05", "part", 2).collect()
    assert rows(layout.lag_violations(df, "ts", "part", 2), "id") == [(2,), (3,)]


def hot_orders(spark, n=3000, customers=500):
    """Orders of which three in ten belong to customer 1."""
    return spark.range(n).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 10 < 3, F.lit(1)).otherwise(F.col("id") % customers + 1).cast("bigint").alias("customer_id"),
    )


def states(spark, n):
    return spark.range(1, n + 1).select(
        F.col("id").alias("customer_id"), F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (F.col("id") % 3 + 1).cast("int")).alias("customer_state")
    )


def test_hot_keys_found_and_join_unchanged(spark):
    big, small = hot_orders(spark), states(spark, 500)
    assert 1 in hot_keys(big, "customer_id", 0.05)
    lost = small.where("customer_id <> 1")
    for spread in (None, ["order_id"]):
        assert rows(skew_join(big, small, "customer_id", 8, spread=spread)) == rows(big.join(small, "customer_id"))
        for how in ("left", "left_anti", "left_semi"):
            assert rows(skew_join(big, lost, "customer_id", 8, how, spread=spread)) == rows(big.join(lost, "customer_id", how))
    with pytest.raises(ValueError):
        skew_join(big, small, "customer_id", how="right")


def test_a_frame_of_the_key_alone_spreads(spark):
    narrow = hot_orders(spark).select("customer_id")
    dealt = salted_counts(narrow, F.col("customer_id") == 1, 16).where("customer_id = 1")
    assert dealt.select("_salt").distinct().count() == 16
    by_salt = [r.n for r in dealt.groupBy("_salt").agg(F.sum("_n").alias("n")).collect()]
    assert sum(by_salt) == narrow.where("customer_id = 1").count() and max(by_salt) - min(by_salt) <= 1
    assert rows(skew_join(narrow, states(spark, 500), "customer_id", 16)) == rows(narrow.join(states(spark, 500), "customer_id"))
    with pytest.raises(ValueError, match="salts"):
        skew_join(narrow, states(spark, 500), "customer_id", 16, spread=["customer_id"])


def test_state_totals_with_a_hot_customer(spark):
    orders, people = hot_orders(spark, 2000, 100), states(spark, 101)
    items = spark.range(4000).select((F.col("id") % 2000).alias("order_id"), (F.col("id") % 97 + 0.5).alias("price"))
    plain = orders.join(items, "order_id").join(people, "customer_id").groupBy("customer_state").agg(
        F.sum(F.col("price").cast("decimal(18,2)")).cast("decimal(18,2)").alias("gmv")
    )
    assert rows(state_gmv(orders, items, people).select("customer_state", F.col("gmv").cast("decimal(18,2)"))) == rows(plain)


def test_current_version_join_gives_one_row_per_customer(spark):
    """100,000 customers with 20 versions each, here by a hundred."""
    orders = spark.range(50_000).select("id", (F.col("id") % 1000).alias("customer_id"), F.col("id").cast("double").alias("amount"))
    versions = spark.range(20_000).select(
        (F.col("id") % 1000).alias("customer_id"), F.lit("SP").alias("customer_state"), (F.floor(F.col("id") / 1000) == 19).alias("is_current")
    )
    assert top_order_per_customer(orders, versions).count() == 1000


def test_sizing_and_shared_folder(spark):
    gib = 1024**3
    assert shuffle_partitions(100 * 1024 * gib, 4000) == 820_000
    assert shuffle_partitions(1, 8) == 8
    assert shared_dir(spark) == shared_dir(spark)


def test_delete_range(spark):
    df = spark.createDataFrame([(d(f"2026-06-0{i}"),) for i in range(1, 6)], "on date")
    assert load.delete_range(df, "on", "2026-06-02", "2026-06-04").count() == 2


def test_month_slices_prune_both_scans(spark):
    from workload import reports
    from workload.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    plan = plan_text(QUERIES["status_category_gmv"].run(spark, sf))
    scans = [line for line in plan.splitlines() if line.startswith("PartitionFilters") and "order_month" in line and ">= 1998-01-01" in line]
    assert len(scans) >= 2
    assert reports.sliced_tables(spark, sf)[0].count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_skew_join_keeps_columns_whatever_their_names(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("_salt"), F.create_map(F.lit("a"), "id").alias("m"))
    small = spark.createDataFrame([(1, "x"), (3, "y")], "k bigint, _n string")
    got = skew_join(big, small, "k", 8)
    assert got.count() == 2002 and got.columns == ["k", "_salt", "m", "_n"]
    alike = spark.range(3000).select(F.lit(1).cast("bigint").alias("k"), F.lit("same").alias("_i"))
    assert skew_join(alike, small, "k", 8).count() == 3000
    assert "Exchange hashpartitioning(k" in plan_text(got, "simple") or "BroadcastHashJoin" in plan_text(got, "simple")
