"""Daily runs end to end: twice the same date, bad inputs, and what lands on disk."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dayslice import jobs
from dayslice.errors import QualityError, ReconcileError, SchemaDriftError
from dayslice.plans import pipelines
from dayslice.sources import writers
from dayslice.sources.readers import read_partitioned

from .conftest import d, rows


def _orders(spark, ds, n=400):
    """n good orders of 50 customers, one without a customer and one negative."""
    base = spark.range(n).select(
        (F.lit(int(ds.replace("-", "")) * 1_000_000) + F.col("id")).alias("order_id"),
        (F.lit(101) + F.col("id") % 50).cast("int").alias("customer_id"),
        F.concat(F.lit("Customer "), (F.lit(101) + F.col("id") % 50).cast("string")).alias("customer_name"),
        (F.lit(20.0) + F.col("id") % 97).alias("amount"),
        F.lit(d(ds)).alias("order_date"),
    )
    bad = spark.createDataFrame([(1, None, None, 5.0, d(ds)), (2, 101, "x", -5.0, d(ds))], base.schema.simpleString()[7:-1].replace(":", " "))
    return base.unionByName(bad)


def test_orders_twice_and_next_day(spark, root):
    for ds in ("2026-01-15", "2026-01-15", "2026-01-16"):
        checks = pipelines.run_orders_day(spark, _orders(spark, ds), root, ds, buckets=4)
        assert checks.where("NOT passed").count() == 0
    fact = read_partitioned(spark, f"{root}/gold/fact_sales")
    assert rows(fact.groupBy("order_date").count()) == [(d("2026-01-15"), 400), (d("2026-01-16"), 400)]
    assert read_partitioned(spark, f"{root}/bronze/orders").count() == 804
    dim = writers.read_buckets(spark, f"{root}/gold/dim_customer")
    assert rows(dim.groupBy("first_seen_date", "last_updated_date").count()) == [(d("2026-01-15"), d("2026-01-16"), 50)]


def test_halved_day_fails_after_loading(spark, root):
    pipelines.run_orders_day(spark, _orders(spark, "2026-01-15"), root, "2026-01-15", buckets=4)
    with pytest.raises(ReconcileError, match="dod_ok: expected 400, observed 100"):
        pipelines.run_orders_day(spark, _orders(spark, "2026-01-16", 100), root, "2026-01-16", buckets=4)


def test_duplicate_order_blocks_silver(spark, root):
    day = _orders(spark, "2026-01-15")
    with pytest.raises(QualityError, match="unique"):
        pipelines.run_orders_day(spark, day.unionAll(day), root, "2026-01-15", buckets=4)
    assert read_partitioned(spark, f"{root}/bronze/orders").count() == 804
    from dayslice.sources.readers import path_exists

    assert not path_exists(spark, f"{root}/silver/orders")


def _stages(spark):
    """Shuffled records of each stage so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), none)
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_orders_are_shuffled_for_their_uniqueness_only(spark, root):
    n, ds = 20_000, "2026-01-15"
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # As for a dimension that is too large to broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = max(_stages(spark), default=-1)
        pipelines.run_orders_day(spark, _orders(spark, ds, n), root, ds, buckets=4)
        shuffled = sum(records for stage, records in _stages(spark).items() if stage > before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert n <= shuffled < 1.5 * n
    assert read_partitioned(spark, f"{root}/gold/fact_sales").count() == n


def test_row_of_another_day_is_refused(spark, root):
    with pytest.raises(PySparkException, match="outside slice"):
        pipelines.run_orders_day(spark, _orders(spark, "2026-01-16"), root, "2026-01-15", buckets=4)


def _ads(spark, ds, extra=(), text_campaign=False):
    """1,000 events over 20 ads, 3 % clicks, 2 % sent twice, and one unknown type."""
    hour = F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(ds).cast("timestamp"))
    campaign = (F.col("id") % 4).cast("int")
    base = spark.range(1000).select(
        (F.lit(int(ds[-2:]) * 10_000) + F.col("id")).alias("event_id"),
        (F.col("id") % 20).alias("ad_id"),
        (F.concat(F.lit("cmp_0"), campaign.cast("string")) if text_campaign else campaign).alias("campaign_id"),
        (F.col("id") % 300).alias("user_id"),
        F.when(F.col("id") % 33 == 0, F.lit("click")).otherwise(F.lit("impression")).alias("event_type"),
        hour.alias("event_ts"),
        *[F.lit(v).alias(c) for c, v in extra],
    )
    odd = base.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "event_type": F.lit("hover")})
    return base.unionByName(base.where("event_id % 50 = 0")).unionByName(odd)


def test_ads_over_three_schema_ages(spark, root):
    days = {
        "2026-06-26": _ads(spark, "2026-06-26"),
        "2026-06-27": _ads(spark, "2026-06-27", [("device_type", "ios")]),
        "2026-06-28": _ads(spark, "2026-06-28", [("device_type", "ios"), ("cost_micros", 5)], True),
    }
    for ds in ("2026-06-26", "2026-06-27", "2026-06-28", "2026-06-27"):
        pipelines.run_ads_day(spark, days[ds], root, ds, buckets=4)
    fact = pipelines.read_ads(spark, root)
    got = fact.groupBy("event_date").agg(F.count("*"), F.count("device_type"), F.count("cost_micros"))
    assert rows(got) == [
        (d("2026-06-26"), 1000, 0, 0), (d("2026-06-27"), 1000, 1000, 0), (d("2026-06-28"), 1000, 1000, 1000)
    ]
    dim = writers.read_buckets(spark, f"{root}/gold/dim_ad")
    assert dim.count() == 20
    assert rows(dim.select("first_seen_date", "last_active_date").distinct()) == [(d("2026-06-26"), d("2026-06-28"))]
    assert dim.where("campaign_id LIKE 'cmp_0%'").count() == 20


def test_ads_without_users_stop_at_the_contract(spark, root):
    with pytest.raises(SchemaDriftError, match="user_id"):
        pipelines.run_ads_day(spark, _ads(spark, "2026-06-26").drop("user_id"), root, "2026-06-26")


def _market(spark, ds):
    return spark.range(500).select(
        F.concat(F.lit("o"), F.col("id").cast("string")).alias("order_id"),
        F.element_at(F.array(F.lit("p1"), F.lit("p2")), (F.col("id") % 2 + 1).cast("int")).alias("partner"),
        F.lit("a@x.com").alias("customer_email"),
        F.lit(10.5).alias("amount"),
        F.lit(f"{ds} 10:00:00").cast("timestamp").alias("order_ts"),
        F.element_at(F.array(F.lit("completed"), F.lit("lost")), (F.col("id") / 400 + 1).cast("int")).alias("status"),
    )


def test_marketplace_rename_is_refused_or_caught(spark, root):
    checks = pipelines.run_marketplace_day(spark, _market(spark, "2026-01-01"), root, "2026-01-01")
    assert rows(checks, "check_name", "observed") == [
        ("not_empty", 400.0), ("positive_total_revenue", 4200.0), ("rollup_match", 400.0)
    ]
    silver = read_partitioned(spark, f"{root}/silver/orders")
    assert "customer_email" not in silver.columns and len(silver.first().customer_email_masked) == 64
    renamed = _market(spark, "2026-01-02").withColumnRenamed("amount", "revenue")
    with pytest.raises(SchemaDriftError, match="amount"):
        pipelines.run_marketplace_day(spark, renamed, root, "2026-01-02")
    with pytest.raises(ReconcileError, match="positive_total_revenue"):
        pipelines.run_marketplace_day(spark, renamed, root, "2026-01-02", fill_missing=True)


def test_customers_twice(spark, root):
    raw = spark.range(200).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("customer_id"),
        F.lit(" Ann ").alias("full_name"), F.lit("0901234567").alias("phone"), F.lit(" A@X.com").alias("email"),
        F.lit("012345678901").alias("cccd"), F.lit("street").alias("address"), F.lit("mass").alias("segment"),
        F.when(F.col("id") % 2 == 0, F.lit("UK")).otherwise(F.lit("US")).alias("region"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("registered_at"),
        F.lit(60_000_000).cast("decimal(18,2)").alias("account_balance"), F.lit(700).alias("credit_score"),
    )
    for _ in range(2):
        pipelines.run_customers_day(spark, raw, root, "2026-01-01", "2026-01-01T06:00:00Z", buckets=4)
    gold = writers.read_buckets(spark, f"{root}/gold/customer_analytics")
    assert rows(gold.groupBy("region", "balance_tier", "credit_tier", "email").count()) == [
        ("UK", "medium", "good", "a@x.com", 100), ("US", "medium", "good", "a@x.com", 100)
    ]
    assert "full_name" not in gold.columns
    trail = spark.read.json(f"{root}/audit/pii_access/dt=2026-01-01")
    assert rows(trail, "job", "record_count") == [("ingest_bronze", 200), ("transform_gold", 200), ("transform_silver", 200)]


def test_campaign_reports(spark, root):
    """30 events, three campaigns, click every 10th, 2nd and 4th impression."""
    names = ("brand_awareness", "retargeting", "prospecting")
    every = (10, 2, 4)
    data = []
    for i in range(30):
        c, rank = i % 3, i // 3
        click = rank % every[c] == 0
        data.append((i, names[c], click, round(0.10 + (0.40 if click else 0.0) + c * 0.05, 2)))
    events = spark.createDataFrame(data, "event_id int, campaign string, is_click boolean, cost_usd double")
    for _ in range(2):
        pipelines.run_campaigns_day(spark, events, root, "2026-01-15", budget=3.0)
    metrics = spark.read.json(f"{root}/published/campaign_metrics/dt=2026-01-15")
    assert rows(metrics, "campaign", "impressions", "clicks", "spend_usd", "ctr") == [
        ("brand_awareness", 10, 1, 1.4, 0.1), ("prospecting", 10, 3, 3.2, 0.3), ("retargeting", 10, 5, 3.5, 0.5)
    ]
    spend = spark.read.json(f"{root}/reports/campaign_spend/dt=2026-01-15").first()
    assert (spend.over_budget_campaigns, spend.total_spend_usd) == (["prospecting", "retargeting"], 8.1)
    low = spark.read.json(f"{root}/reports/campaign_low_ctr/dt=2026-01-15").first()
    assert (low.low_ctr_campaigns, low.wasted_spend_usd) == (["brand_awareness"], 1.4)


def test_command_line(spark, root):
    _market(spark, "2026-01-01").coalesce(1).write.option("header", True).csv(f"{root}/raw/2026-01-01.csv")
    out = jobs.run(spark, ["marketplace", "--ds", "2026-01-01", "--raw", f"{root}/raw", "--root", root])
    assert out.where("passed").count() == 3
    table = f"{root}/gold/fact_daily_revenue"
    assert rows(jobs.run(spark, ["query", table, "--columns", "partner,order_count", "--where", "order_count > 1"])) == [("p1", 200), ("p2", 200)]
    assert jobs.run(spark, ["query", table, "--count"]).first()[0] == 2
    assert jobs.run(spark, ["query", table, "--sql", "SELECT sum(order_count) AS n FROM tbl"]).first().n == 400
    assert jobs.run(spark, ["query", table, "--describe"]).count() == 4
    assert jobs.run(spark, ["file-stats", table]).first().n_rows == 2
    assert jobs.run(spark, ["compact", table, f"{root}/compacted"]).count() == 2


def test_command_line_reads_csv_by_contract(spark, root):
    """Ids keep their leading zeros, a broken line stops the job, and a job without a contract asks for one."""
    lines = ["order_id,partner,extra,customer_email,amount,order_ts,status"]
    lines += [f"00{i},p{i % 2},x,a{i}@b.vn,{10 + i}.5,2026-01-01 08:00:00,completed" for i in range(40)]
    spark.createDataFrame([(0, "\n".join(lines))], "n int, line string").select("line").coalesce(1).write.text(f"{root}/raw/2026-01-01.csv")
    argv = ["--ds", "2026-01-01", "--raw", f"{root}/raw", "--root", root]
    assert jobs.run(spark, ["marketplace", *argv]).where("passed").count() == 3
    silver = read_partitioned(spark, f"{root}/silver/orders", "order_id string, partner string, amount double, status string, customer_email_masked string, order_date date")
    assert rows(silver.where("amount < 12"), "order_id") == [("000",), ("001",)]
    with pytest.raises(SystemExit, match="--schema"):
        jobs.run(spark, ["customers", *argv])
