"""Contracts, suites, reconciliation: each must pass on good data and fail on injected faults."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayslice.errors import QualityError, ReconcileError, SchemaDriftError
from dayslice.operators import contracts, quality, reconcile
from dayslice.plans.pipelines import AD_CONTRACT, AD_IDS

from .conftest import d, rows

DAYS = {
    1: "event_id string, ad_id string, campaign_id int, user_id string, event_type string, event_ts timestamp",
    2: "event_id string, ad_id string, campaign_id int, user_id string, event_type string, event_ts timestamp, device_type string",
    3: "event_id string, ad_id string, campaign_id string, user_id string, event_type string, event_ts timestamp, "
       "device_type string, cost_micros int",
}


def _day(spark, n):
    return spark.createDataFrame([], DAYS[n])


def test_drift_against_the_base_contract(spark):
    one, three = (contracts.check_schema(_day(spark, n), AD_CONTRACT) for n in (1, 3))
    assert (one.added, one.missing, one.retyped) == ([], [], ["campaign_id"])
    assert (three.added, three.retyped) == (["cost_micros", "device_type"], [])
    assert contracts.enforce(one, retyped_ok=AD_IDS) == ["retyped column campaign_id"]


def test_drift_against_the_day_before(spark):
    drift = contracts.check_schema(_day(spark, 3), contracts.contract_of(_day(spark, 2)))
    assert (drift.added, drift.retyped) == (["cost_micros"], ["campaign_id"])


def test_missing_and_retyped_columns_stop_a_load(spark):
    lost = contracts.check_schema(_day(spark, 1).drop("user_id"), AD_CONTRACT)
    with pytest.raises(SchemaDriftError, match="user_id"):
        contracts.enforce(lost)
    typed = contracts.check_schema(_day(spark, 1), AD_CONTRACT)
    with pytest.raises(SchemaDriftError, match="changed type"):
        contracts.enforce(typed, retyped_ok=())
    with pytest.raises(SchemaDriftError, match="unexpected"):
        contracts.enforce(contracts.check_schema(_day(spark, 3), AD_CONTRACT), allow_added=False)
    assert contracts.check_schema(spark.createDataFrame([], DAYS[3].split(", device")[0]), AD_CONTRACT).is_clean


def test_align_fills_only_on_request(spark):
    df = spark.createDataFrame([("7", "x"), ("no", "y")], "n string, extra string")
    schema = T.StructType.fromDDL("n int, note string")
    with pytest.raises(SchemaDriftError):
        contracts.align(df, schema)
    assert rows(contracts.align(df, schema, fill_missing=True)) == [(7, None), (None, None)]


def _orders(spark, n=1000):
    return spark.range(1, n + 1).select(
        F.col("id").alias("order_id"),
        (F.lit(101) + F.col("id") % 500).cast("int").alias("customer_id"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("customer_name"),
        (F.lit(20.0) + F.col("id") % 900).alias("amount"),
        F.lit(d("2026-01-15")).alias("order_date"),
    )


SUITE = quality.load_suite(json.dumps({"expectations": [
    {"expectation_type": quality.ROW_COUNT, "kwargs": {"min_value": 1}},
    {"expectation_type": quality.NOT_NULL, "kwargs": {"column": "order_date"}},
    {"expectation_type": quality.NOT_NULL, "kwargs": {"column": "customer_name"}},
    {"expectation_type": quality.BETWEEN, "kwargs": {"column": "amount", "min_value": 20, "max_value": 4000}},
    {"expectation_type": quality.BETWEEN, "kwargs": {"column": "customer_id", "min_value": 101, "max_value": 5100}},
    {"expectation_type": quality.UNIQUE, "kwargs": {"column": "order_id"}},
]}))


def test_clean_orders_pass_all_six(spark):
    result = quality.run_suite(_orders(spark), SUITE)
    assert result.count() == 6 and result.where("NOT success").count() == 0
    quality.gate(result)


def test_broken_orders_fail_and_are_named(spark):
    """20 null names, 15 negative amounts, 1 duplicate id among 1,001 rows."""
    base = _orders(spark)
    broken = base.withColumns({
        "customer_name": F.when(F.col("order_id") > 20, F.col("customer_name")),
        "amount": F.when(F.col("order_id") > 985, F.lit(-1.0)).otherwise(F.col("amount")),
    }).unionByName(base.where("order_id = 500"))
    result = quality.run_suite(broken, SUITE)
    bad = {r.column: (r.unexpected, round(r.unexpected_percent, 4)) for r in result.where("NOT success").collect()}
    assert bad == {"customer_name": (20, 1.998), "amount": (15, 1.4985), "order_id": (2, 0.1998)}
    with pytest.raises(QualityError, match=r"3 expectations failed: .*amount.*order_id"):
        quality.gate(result)


def test_suite_on_absent_column_and_empty_table(spark):
    rules = [
        {"expectation_type": quality.EXISTS, "kwargs": {"column": "gone"}},
        {"expectation_type": quality.NOT_NULL, "kwargs": {"column": "gone"}},
        {"expectation_type": quality.ROW_COUNT, "kwargs": {"min_value": 1}},
        {"expectation_type": quality.UNIQUE, "kwargs": {"column": "order_id"}},
    ]
    got = {r.expectation: r.success for r in quality.run_suite(_orders(spark), rules).collect()}
    assert got == {quality.EXISTS: False, quality.NOT_NULL: False, quality.ROW_COUNT: True, quality.UNIQUE: True}
    empty = quality.run_suite(_orders(spark).where("false"), rules[2:])
    assert rows(empty, "success", "unexpected") == [(False, 1), (True, 0)]


def _one(check):
    row = reconcile.evaluate(check).first()
    return row.passed, row.expected, row.observed


def test_count_sum_and_rollup(spark):
    src = _orders(spark)
    less = src.where("order_id > 1")
    wrong = src.withColumn("amount", F.when(F.col("order_id") == 1, F.col("amount") + 100).otherwise(F.col("amount")))
    assert _one(reconcile.recon_count(src, src))[0] and not _one(reconcile.recon_count(src, less))[0]
    assert _one(reconcile.recon_sum(src, src, "amount"))[0]
    assert not _one(reconcile.recon_sum(src, wrong, "amount"))[0]
    assert _one(reconcile.recon_sum(src, wrong, "amount", tolerance=100))[0]
    roll = src.groupBy("customer_id").count()
    assert _one(reconcile.recon_rollup(src, roll, "count")) == (True, 1000.0, 1000.0)
    assert not _one(reconcile.recon_rollup(less, roll, "count"))[0]
    nothing = src.where("false")
    assert _one(reconcile.recon_sum(nothing, nothing, "amount")) == (True, 0.0, 0.0)


def test_day_over_day(spark):
    fact = spark.createDataFrame([(d("2026-06-06"),)] * 4 + [(d("2026-06-07"),)] * 12, "on date")
    assert not _one(reconcile.recon_dod(fact, "on", "2026-06-07"))[0]
    assert _one(reconcile.recon_dod(fact, "on", "2026-06-06")) == (True, 0.0, 4.0)
    assert _one(reconcile.recon_dod(fact, "on", "2026-06-07", exclude=["2026-06-07"]))[0]


def test_rules_orphans_unique(spark):
    fact = spark.createDataFrame([(1, 10.0), (2, 5.0)], "customer_id int, amount double")
    dim = spark.createDataFrame([(1,), (2,), (None,)], "customer_id int")
    assert _one(reconcile.recon_rules(fact, dim, "customer_id", "amount"))[0]
    for bad in ((3, 1.0), (None, 1.0), (1, -1.0)):
        more = fact.unionByName(spark.createDataFrame([bad], fact.schema))
        assert _one(reconcile.recon_rules(more, dim, "customer_id", "amount")) == (False, 0.0, 1.0)
    orphan = fact.unionByName(spark.createDataFrame([(9, 1.0)], fact.schema))
    assert not _one(reconcile.check_no_orphans(orphan, dim, ["customer_id"]))[0]
    assert not _one(reconcile.check_unique(fact.unionAll(fact), ["customer_id"]))[0]


def test_silent_rename_is_caught_by_value_not_by_count(spark):
    gold = spark.createDataFrame([(3, None)], "order_count bigint, total_revenue double")
    assert _one(reconcile.check_positive(gold))[0]
    assert not _one(reconcile.check_positive(gold, "total_revenue"))[0]


def test_tombstone_and_not_null(spark):
    tgt = spark.createDataFrame([(1,), (2,)], "id int")
    log = spark.createDataFrame([(1, "I", 1), (1, "D", 2), (2, "D", 1), (2, "U", 3)], "id int, op string, t int")
    assert _one(reconcile.check_no_tombstone(tgt, log, ["id"], ["t"])) == (False, 0.0, 1.0)
    assert _one(reconcile.check_no_tombstone(tgt.where("id = 2"), log, ["id"], ["t"]))[0]
    half = spark.createDataFrame([(None, d("2026-01-01")), ("a", d("2026-01-02"))], "k string, on date")
    assert not _one(reconcile.check_not_null(half, "k"))[0]
    assert _one(reconcile.check_not_null(half, "k", "on", "2026-01-02"))[0]


def test_checks_on_one_table_share_its_scan(spark, root):
    from dayslice.operators.layout import plan_text

    _orders(spark).write.parquet(f"{root}/o")
    df = spark.read.parquet(f"{root}/o")
    checks = reconcile.evaluate(
        reconcile.recon_count(df, df), reconcile.recon_sum(df, df, "amount"),
        reconcile.check_positive(df, "amount"), reconcile.check_not_null(df, "customer_id"),
    )
    assert plan_text(checks, "simple").count("FileScan") == 1
    reconcile.require(checks)


def test_require_names_the_failures(spark):
    src = _orders(spark)
    with pytest.raises(ReconcileError, match="count_match: expected 1000, observed 999"):
        reconcile.require(reconcile.evaluate(reconcile.recon_count(src, src.where("order_id > 1"))))


def test_trace_shows_where_values_vanish(spark):
    bronze = _orders(spark, 10)
    silver = bronze.withColumn("amount", F.lit(None).cast("double"))
    got = rows(reconcile.trace_layers({"bronze": bronze, "silver": silver}, "order_date", "amount"), "layer", "n_rows", "n_values")
    assert got == [("bronze", 10, 10), ("silver", 10, 0)]


def test_run_summary(spark):
    checks = reconcile.evaluate(reconcile.check_positive(_orders(spark)))
    out = reconcile.run_summary(checks, {"silver": 1000}, "2026-01-15", "2026-01-16 07:10:00")
    assert rows(out, "check_name", "observed") == [("not_empty", 1000.0), ("rows_silver", 1000.0)]
