"""Masks, policies, and the access trail."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from dayslice.errors import AccessDenied
from dayslice.functions import privacy
from dayslice.operators import access

from .conftest import d, rows

POLICY = {"tables": [
    {"user": "admin", "privileges": ["SELECT"]},
    {"user": "analyst_(uk|us)", "schema": "gold", "table": "customer_analytics", "privileges": ["SELECT"],
     "filter": "region = 'UK'", "columns": [{"name": "phone", "mask": "phone"}, {"name": "cccd", "mask": "null"}]},
    {"user": "analyst", "schema": "silver|gold", "table": ".*", "privileges": ["SELECT"],
     "columns": [{"name": "phone", "mask": lambda c: F.lit("hidden")}]},
    {"user": "writer", "privileges": ["INSERT"]},
]}


@pytest.fixture(scope="module")
def people(spark):
    data = [(i, "0901234567", "UK" if i % 2 else "US", f"{i:012d}") for i in range(200)]
    return spark.createDataFrame(data, "customer_id int, phone string, region string, cccd string")


def test_mask_shapes(spark):
    df = spark.createDataFrame([("0901234567", "john@x.com"), (None, "a@x.com"), ("123", None)], "p string, e string")
    assert rows(df.select(privacy.mask_phone("p"), privacy.mask_email("e"))) == [
        ("090****567", "jo***@x.com"), ("123", None), (None, "a@x.com")
    ]


def test_hash_drops_the_raw_value_and_survives_absence(spark):
    df = spark.createDataFrame([(1, "a@x.com")], "id int, email string")
    assert rows(access.hash_column(df, "email")) == [(1, hashlib.sha256(b"a@x.com").hexdigest())]
    assert rows(access.hash_column(df.drop("email"), "email")) == [(1, None)]


def test_row_counts_by_role(people):
    assert access.secure_view(people, POLICY, "analyst_uk", "gold.customer_analytics").count() == 100
    assert access.secure_view(people, POLICY, "admin", "gold.customer_analytics").count() == 200


def test_filter_cannot_be_bypassed_and_types_stay(people):
    view = access.secure_view(people, POLICY, "analyst_uk", "gold.customer_analytics")
    assert view.where("region = 'US'").count() == 0
    assert view.where("phone = '0901234567'").count() == 0
    assert view.dtypes == people.dtypes
    assert rows(view.select("phone", "cccd").distinct()) == [("090****567", None)]


def test_first_match_wins_and_default_is_deny(people):
    assert rows(access.secure_view(people, POLICY, "analyst", "silver.x").select("phone").distinct()) == [("hidden",)]
    for role, table in (("analyst", "bronze.customers"), ("nobody", "gold.customer_analytics"), ("writer", "gold.x")):
        with pytest.raises(AccessDenied):
            access.secure_view(people, POLICY, role, table)


def test_only_approved_columns(people):
    assert access.minimize(people, {"customer_id", "region"}).columns == ["customer_id", "region"]
    with pytest.raises(AccessDenied, match="cccd"):
        access.minimize(people, {"customer_id"}, ["customer_id", "cccd"])


def test_trail_holds_no_values(spark):
    log = access.audit_row(spark, "a", "t", ["phone"], 3, "2026-01-01", "2026-01-01T01:00:00Z").unionByName(
        access.audit_row(spark, "b", "t", ["phone"], 4, "2026-01-01", "2026-01-01T02:00:00Z")
    )
    assert rows(access.audit_tail(log, 1), "job", "record_count") == [("b", 4)]


def test_silver_customers_are_clean_unique_and_repeatable(spark):
    bronze = spark.createDataFrame(
        [(1, " Ann ", " A@X.com", d("2026-01-01"), 1), (1, "Ann B", "b@x.com", d("2026-01-01"), 2), (2, "Old", "o@x", d("2025-12-31"), 1)],
        "customer_id int, full_name string, email string, ingested_at date, registered_at int",
    )
    once = access.customers_silver(bronze, None, "2026-01-01")
    assert rows(once, "customer_id", "full_name", "email") == [(1, "Ann B", "b@x.com")]
    assert rows(access.customers_silver(bronze, once, "2026-01-01")) == rows(once)


def test_unknown_numbers_have_no_tier(spark):
    df = spark.createDataFrame([(60_000_000, 579), (None, None), (200_000_000, 800)], "b bigint, s int")
    assert rows(access.with_tiers(df, "b", "s"), "balance_tier", "credit_tier") == [
        (None, None), ("high", "excellent"), ("medium", "poor")
    ]


def test_policy_file(people):
    text = """{"tables": [{"user": "guest", "schema": "gold", "table": "people", "privileges": ["SELECT"],
        "filter": "customer_id < 10", "columns": [{"name": "cccd", "mask": "hash"}]}]}"""
    view = access.secure_view(people, access.load_policy(text), "guest", "gold.people")
    assert view.count() == 10 and len(view.first().cccd) == 64
    with pytest.raises(ValueError, match="unknown masks"):
        access.load_policy(text.replace('"hash"', '"blur"'))
    with pytest.raises(ValueError, match="privileges"):
        access.load_policy('{"tables": [{"user": "x"}]}')
