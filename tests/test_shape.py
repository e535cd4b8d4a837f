"""Validation, quarantine, anomaly flags, and columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dayslice.functions import columns as C
from dayslice.operators import shape

from .conftest import d, rows


def test_valid_orders_of_a_day(six_orders):
    kept = shape.validate_orders(six_orders, "2026-01-15")
    assert rows(kept, "order_id") == [(1,), (2,), (3,)]
    assert kept.schema == six_orders.schema


def test_day_without_rows_keeps_the_schema(six_orders):
    none = shape.validate_orders(six_orders, "1900-01-01")
    assert none.count() == 0 and none.columns == six_orders.columns


def test_zero_is_valid_only_when_inclusive(spark, six_orders):
    zero = spark.createDataFrame([(7, 106, "Fay", 0.0, d("2026-01-15"))], six_orders.schema)
    more = six_orders.unionByName(zero)
    assert shape.validate_orders(more, "2026-01-15").count() == 4
    assert shape.validate_orders(more, "2026-01-15", inclusive=False).count() == 3


def test_stamp_is_the_run_date_and_repeats(six_orders):
    once, twice = (rows(shape.stamp_valid(six_orders, "2026-01-15")) for _ in range(2))
    assert once == twice and {r[-1] for r in once} == {"2026-01-15"}


def test_split_loses_no_row(six_orders):
    rules = {"customer": F.col("customer_id").isNotNull(), "amount": F.col("amount") >= 0}
    good, bad = shape.split_valid(six_orders, rules)
    assert good.count() + bad.count() == six_orders.count()
    assert rows(bad, "order_id", "reasons") == [(4, ["customer"]), (5, ["amount"])]


def test_rule_on_null_counts_as_broken(six_orders):
    good, bad = shape.split_valid(six_orders, {"big": F.col("customer_id") > 0})
    assert rows(bad, "order_id") == [(4,)] and good.count() == 5


def test_order_flags(spark):
    orders = spark.createDataFrame(
        [("a", None, 0.0, 10.0, 5.0), ("b", "FREE", 0.0, 10.0, 5.0), ("c", None, 3.0, 10.0, 11.0)],
        "order_id string, voucher_code string, shipping_fee double, subtotal double, discount_amount double",
    )
    flagged = shape.flag_order_anomalies(orders)
    assert rows(flagged, "order_id", "is_zero_shipping", "is_over_discounted") == [
        ("a", True, False), ("b", False, False), ("c", False, True)
    ]


def test_known_columns_and_text_ids(spark):
    raw = spark.createDataFrame([(1, "x", 9)], "event_id int, note string, extra int")
    out = shape.select_known(shape.normalize_ids(raw, ["event_id", "ad_id"]), ["extra", "event_id"])
    assert out.dtypes == [("extra", "int"), ("event_id", "string")]


def test_union_of_three_ages(spark):
    one = spark.createDataFrame([("a",)], "id string")
    two = spark.createDataFrame([("b", "ios")], "id string, device string")
    three = spark.createDataFrame([("c", "web", 5)], "id string, device string, cost int")
    assert rows(shape.union_evolving(one, two, three)) == [
        ("a", None, None), ("b", "ios", None), ("c", "web", 5)
    ]


def test_ratio_tier_and_dates(spark):
    row = spark.range(1).select(
        C.safe_ratio(F.lit(1), F.lit(3)).alias("third"),
        C.safe_ratio(F.lit(1), F.lit(0)).alias("none"),
        C.tier(F.lit(None).cast("double"), (1, 2), ("a", "b", "c")).alias("unknown"),
        C.tier(F.lit(2.0), (1, 2), ("a", "b", "c")).alias("edge"),
        C.date_key(C.day("2026-01-15"), F.lit(7)).alias("key"),
        C.settlement_date(C.day("2026-06-20")).alias("paid"),
    ).first()
    assert (row.third, row.none, row.unknown, row.edge) == (0.3333, 0.0, None, "c")
    assert row.key == 20260115000007 and row.paid == d("2026-07-05")


def test_tier_needs_matching_labels():
    with pytest.raises(ValueError):
        C.tier("x", (1, 2), ("a", "b"))


def test_risk_score_matches_the_row_function(spark):
    base = C.RISK_BASE
    data = [("credit_card", 3, 120.5), ("boleto", 1, None), ("unknown", 2, 10.0), (None, 1, 1.0)]
    df = spark.createDataFrame(data, "t string, n int, v double")
    got = [r.s for r in df.select(C.risk_score("t", "n", "v").alias("s")).collect()]
    assert got == [base.get(t, 0.0) + n * 2.0 + (v or 0.0) * 0.01 for t, n, v in data]
