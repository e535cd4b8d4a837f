"""Type 2 dimensions: golden numbers, replay, and equality of fold and set form."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dayslice.operators import joins, scd2
from dayslice.operators.layout import plan_text
from dayslice.session import materialize

from .conftest import d, rows

CLOSED = "id int, tier string, effective_date date, expiration_date date, is_current boolean, version int"
OPEN = "customer_key bigint, id int, tier string, effective_from date, effective_to date, is_current boolean"


def _silver(spark, upto, n=100):
    tier = F.when(F.col("id") <= upto, F.lit("SILVER")).otherwise(F.lit("BRONZE"))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"), tier.alias("tier"))


def test_closed_golden_numbers(spark):
    """1,000 customers, 200 promoted: 1,200 versions; here by ten."""
    dim = spark.createDataFrame([], CLOSED)
    dim = scd2.apply_scd2_closed(dim, _silver(spark, 0), ["id"], ["tier"], "2024-01-01")
    dim = scd2.apply_scd2_closed(dim, _silver(spark, 20), ["id"], ["tier"], "2024-01-02")
    assert dim.count() == 120 and dim.where("is_current").count() == 100
    first = scd2.as_of(dim, "2024-01-01", "effective_date", "expiration_date")
    second = scd2.as_of(dim, "2024-01-02", "effective_date", "expiration_date")
    assert rows(first.groupBy("tier").count()) == [("BRONZE", 100)]
    assert rows(second.groupBy("tier").count()) == [("BRONZE", 80), ("SILVER", 20)]
    assert rows(scd2.scd2_problems(dim, ["id"])) == [(0, 0, 0, 0, 0)]


def test_open_golden_numbers(spark):
    dim = spark.createDataFrame([], OPEN)
    for ds, upto in (("2024-01-01", 0), ("2024-01-02", 0), ("2024-01-03", 10)):
        # A daily run reads the table the day before wrote.
        dim = materialize(scd2.apply_scd2_open(dim, _silver(spark, upto), ["id"], ["tier"], ds), "dim")
    assert dim.count() == 110 and dim.where("is_current").count() == 100
    assert sorted(r.customer_key for r in dim.collect()) == list(range(1, 111))
    two = dim.where("id = 1").orderBy("effective_from").collect()
    assert (two[0].effective_to, two[1].effective_from) == (d("2024-01-03"), d("2024-01-03"))
    point = scd2.as_of(dim, "2024-01-02", "effective_from", "effective_to", closed=False)
    assert point.count() == 100 and point.where("tier = 'SILVER'").count() == 0


@pytest.mark.parametrize("apply, schema", [(scd2.apply_scd2_closed, CLOSED), (scd2.apply_scd2_open, OPEN)])
def test_date_can_run_again_also_corrected(spark, apply, schema):
    day1 = apply(spark.createDataFrame([], schema), _silver(spark, 0, 10), ["id"], ["tier"], "2024-01-01")
    day1 = materialize(day1, "day1")
    day2 = materialize(apply(day1, _silver(spark, 3, 10), ["id"], ["tier"], "2024-01-02"), "day2")
    assert rows(apply(day2, _silver(spark, 3, 10), ["id"], ["tier"], "2024-01-02")) == rows(day2)
    wrong = materialize(apply(day1, _silver(spark, 7, 10), ["id"], ["tier"], "2024-01-02"), "wrong")
    assert rows(apply(wrong, _silver(spark, 3, 10), ["id"], ["tier"], "2024-01-02")) == rows(day2)


def test_older_date_is_refused(spark):
    dim = scd2.apply_scd2_closed(spark.createDataFrame([], CLOSED), _silver(spark, 0, 3), ["id"], ["tier"], "2024-01-05")
    with pytest.raises(PySparkException, match="older than version start"):
        scd2.apply_scd2_closed(dim, _silver(spark, 2, 3), ["id"], ["tier"], "2024-01-04").collect()


def test_vanished_keys_stay_or_close_and_come_back(spark):
    dim = scd2.apply_scd2_closed(spark.createDataFrame([], CLOSED), _silver(spark, 0, 3), ["id"], ["tier"], "2024-01-01")
    stay = scd2.apply_scd2_closed(dim, _silver(spark, 0, 2), ["id"], ["tier"], "2024-01-02")
    assert stay.where("is_current").count() == 3
    gone = scd2.apply_scd2_closed(dim, _silver(spark, 0, 2), ["id"], ["tier"], "2024-01-02", close_missing=True)
    assert rows(gone.where("NOT is_current"), "id", "expiration_date") == [(3, d("2024-01-01"))]
    back = scd2.apply_scd2_closed(gone, _silver(spark, 0, 3), ["id"], ["tier"], "2024-01-04")
    assert rows(back.where("id = 3"), "version", "is_current") == [(1, False), (2, True)]


def test_null_is_a_value(spark):
    snap = spark.createDataFrame([(1, None)], "id int, tier string")
    dim = scd2.apply_scd2_closed(spark.createDataFrame([], CLOSED), snap, ["id"], ["tier"], "2024-01-01")
    assert rows(scd2.apply_scd2_closed(dim, snap, ["id"], ["tier"], "2024-01-02")) == rows(dim)
    named = spark.createDataFrame([(1, "GOLD")], "id int, tier string")
    assert scd2.apply_scd2_closed(dim, named, ["id"], ["tier"], "2024-01-02").count() == 2


def test_repeated_snapshot_key_is_refused(spark):
    snap = spark.createDataFrame([(1, "A"), (1, "B")], "id int, tier string")
    with pytest.raises(PySparkException, match="several source rows"):
        scd2.apply_scd2_closed(spark.createDataFrame([], CLOSED), snap, ["id"], ["tier"], "2024-01-01").collect()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.integers(1, 3), st.sampled_from(["A", "B", None]), min_size=1), min_size=1, max_size=3))
def test_set_form_equals_the_daily_fold(spark, days):
    dim = spark.createDataFrame([], CLOSED)
    snaps = []
    for i, day in enumerate(days):
        ds = f"2024-01-{i + 1:02d}"
        snap = spark.createDataFrame(list(day.items()), "id int, tier string")
        dim = materialize(scd2.apply_scd2_closed(dim, snap, ["id"], ["tier"], ds), "fold")
        snaps += [(k, v, d(ds)) for k, v in day.items()]
    whole = spark.createDataFrame(snaps, "id int, tier string, snapshot_date date")
    assert rows(scd2.scd2_from_snapshots(whole, ["id"], ["tier"])) == rows(dim)


def _versions(spark, data):
    return spark.createDataFrame([(k, v, d(a), d(b), v == 9) for k, v, a, b in data],
                                 "id int, version int, effective_date date, expiration_date date, is_current boolean")


def test_overlap_equals_the_pair_search(spark):
    dim = _versions(spark, [
        (1, 1, "2024-01-01", "2024-01-20"), (1, 2, "2024-01-05", "2024-01-06"), (1, 3, "2024-01-10", "2024-01-30"),
        (2, 1, "2024-01-01", "2024-01-09"), (2, 2, "2024-01-10", "2024-01-30"),
    ])
    got = scd2.overlapping_versions(dim, ["id"], "version", "effective_date", "expiration_date")
    a, b = dim.alias("a"), dim.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.version") < F.col("b.version"))
                   & (F.col("a.expiration_date") >= F.col("b.effective_date")))
    assert rows(got, "id", "version") == rows(pairs.select("b.id", "b.version").distinct()) == [(1, 2), (1, 3)]


def test_gap_and_repeats_are_found(spark):
    dim = _versions(spark, [(1, 1, "2024-01-01", "2024-01-04"), (1, 2, "2024-01-08", "2024-01-09"), (1, 2, "2024-01-10", "2024-01-11")])
    assert rows(scd2.gaps_between_versions(dim, ["id"]), "version", "next_start") == [(1, d("2024-01-08"))]
    found = scd2.scd2_problems(dim, ["id"]).first()
    assert (found.no_current, found.gaps, found.repeated_versions) == (1, 1, 1)


def test_tier_at_time_of_purchase(spark):
    dim = scd2.scd2_from_snapshots(
        spark.createDataFrame([(1, "A", d("2024-01-01")), (1, "B", d("2024-01-10"))], "id int, tier string, snapshot_date date"),
        ["id"], ["tier"],
    )
    fact = spark.createDataFrame(
        [(1, d("2024-01-09")), (1, d("2024-01-10")), (1, d("2023-12-31")), (2, d("2024-01-05"))], "id int, on date"
    )
    got = joins.join_as_of(fact, dim, ["id"], "on", "effective_date", "expiration_date")
    assert rows(got, "id", "on", "tier") == [
        (1, d("2023-12-31"), None), (1, d("2024-01-09"), "A"), (1, d("2024-01-10"), "B"), (2, d("2024-01-05"), None)
    ]
    assert rows(joins.join_current(fact, dim, ["id"]), "tier").count(("B",)) == 3


def test_closed_apply_joins_once_and_leaves_history_alone(spark, root):
    dim = spark.range(40).select(
        (F.col("id") % 20).cast("int").alias("id"), F.lit("a").alias("tier"), F.lit("2026-01-01").cast("date").alias("effective_date"),
        F.when(F.col("id") < 20, F.lit("2026-01-05").cast("date")).otherwise(F.lit("9999-12-31").cast("date")).alias("expiration_date"),
        (F.col("id") >= 20).alias("is_current"), F.lit(1).alias("version"),
    )
    dim.write.parquet(f"{root}/dim")
    snap = spark.createDataFrame([(1, "b"), (2, "a")], "id int, tier string")
    out = scd2.apply_scd2_closed(spark.read.parquet(f"{root}/dim"), snap, ["id"], ["tier"], "2026-02-01")
    plan = plan_text(out, "simple")
    # The one full outer join is done and written; what is left is a union over history and that result, without a shuffle.
    assert "Join" not in plan and "Exchange" not in plan
    assert rows(out.where("is_current"), "id", "tier", "version")[:3] == [(0, "a", 1), (1, "b", 2), (10, "a", 1)]
    # A key that comes back counts on from its closed versions, found without a shuffle of history.
    back = scd2.apply_scd2_closed(spark.read.parquet(f"{root}/dim").where("NOT (id = 3 AND is_current)"), spark.createDataFrame([(3, "c")], "id int, tier string"), ["id"], ["tier"], "2026-02-01")
    assert rows(back.where("id = 3 AND is_current"), "tier", "version") == [("c", 2)]
