"""One row per key, numbering, batches, and ordered calculations."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayslice.operators import dedup, numbering, windows
from dayslice.operators.layout import plan_text

from .conftest import d, rows


def test_first_and_latest(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "k string, t int, v string")
    assert rows(dedup.keep_first(df, ["k"], ["t"])) == [("a", 1, "x"), ("b", 5, "z")]
    assert rows(dedup.keep_latest(df, ["k"], ["t"])) == [("a", 2, "y"), ("b", 5, "z")]


def test_ties_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([("a", 1, v) for v in "qwertyuiop"], "k string, t int, v string")
    answers = {tuple(rows(dedup.keep_first(df.repartition(n), ["k"], ["t"]))) for n in (1, 3, 7)}
    assert answers == {(("a", 1, "e"),)}


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    plan = plan_text(dedup.keep_first(df, ["k"], ["t"]), "simple")
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle


def test_snapshot_validation_counts(spark):
    """5,150 rows in, 5,000 out, scaled by ten: 500 ids, 10 copies, 5 without a tier."""
    tiers = F.element_at(F.array(*[F.lit(t) for t in ("bronze", "silver", "gold", "platinum")]), (F.col("id") % 4 + 1).cast("int"))
    base = spark.range(500).select((F.col("id") + 201).alias("customer_id"), tiers.alias("tier"))
    copies = base.where("customer_id > 690")
    nulls = spark.range(5).select((F.col("id") + 6001).alias("customer_id"), F.lit(None).cast("string").alias("tier"))
    raw = base.unionByName(copies).unionByName(nulls).withColumn("snapshot_date", F.lit(d("2024-01-01")))
    assert raw.count() == 515
    kept = dedup.validate_snapshot(raw, ["customer_id"], "tier", ["bronze", "silver", "gold", "platinum"])
    assert kept.count() == 500 and kept.select("customer_id").distinct().count() == 500


def test_top_with_and_without_ties(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", 3, 1)], "g string, id int, v int")
    tied = dedup.top_per_group(df, ["g"], [F.col("v").desc()], 1, ties=True)
    single = dedup.top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 1)
    assert rows(tied, "id") == [(1,), (2,)] and rows(single, "id") == [(1,)]


def test_top_and_bottom(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(6)], "g string, id int, v int")
    out = dedup.top_bottom_per_group(df, ["g"], "v", ["id"], 2)
    assert rows(out, "side", "rank", "id") == [
        ("best", 1, 5), ("best", 2, 4), ("slow", 1, 0), ("slow", 2, 1)
    ]


def test_numbers_are_dense_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    one = rows(numbering.number_rows(df.repartition(3), ["k"], "n"))
    two = rows(numbering.number_rows(df.repartition(11), ["k"], "n"))
    assert one == two and sorted(n for _, n in one) == list(range(1, 1001))


def test_numbers_continue_after_a_maximum(spark):
    df = spark.range(20).select(F.col("id").alias("k"))
    highest = spark.createDataFrame([(40,)], "m bigint")
    assert sorted(r.n for r in numbering.number_rows(df, ["k"], "n", after=highest).collect()) == list(range(41, 61))
    nothing = spark.createDataFrame([(None,)], "m bigint")
    assert min(r.n for r in numbering.number_rows(df, ["k"], "n", after=nothing).collect()) == 1


def test_batches_are_full_but_for_the_last(spark):
    ids = spark.range(1234).select(F.col("id").cast("string").alias("order_id"))
    batches = numbering.batch_ids(ids.unionAll(ids.limit(10)), "order_id", 50).collect()
    sizes = Counter(len(b.ids) for b in batches)
    assert sizes == {50: 24, 34: 1} and len({i for b in batches for i in b.ids}) == 1234


def _naive_sequence(orders):
    out = []
    for who in {o[1] for o in orders}:
        mine = sorted((o for o in orders if o[1] == who), key=lambda o: (o[2], o[0]))
        for n, (oid, _, on) in enumerate(mine):
            out.append((oid, n + 1, (on - mine[n - 1][2]).days if n else None))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 28)), min_size=1, max_size=25))
def test_order_sequence_equals_the_plain_loop(spark, picks):
    orders = [(i, c, d(f"2026-02-{day:02d}")) for i, (c, day) in enumerate(picks)]
    df = spark.createDataFrame(orders, "order_id int, customer_id int, order_date date")
    got = windows.order_sequence(df, "customer_id", "order_date", ["order_id"])
    assert sorted(tuple(r) for r in got.select("order_id", "order_no", "gap_days").collect()) == _naive_sequence(orders)


def test_stock_is_rebuilt_backwards(spark):
    stock = spark.createDataFrame([(1, 2540), (2, 10)], "product_id int, stock_qty bigint")
    moves = spark.createDataFrame(
        [
            (1, -139, dt.datetime(2026, 6, 15, 0, 0)), (1, -171, dt.datetime(2026, 6, 16, 23, 59, 59)),
            (1, 5, dt.datetime(2026, 6, 20, 12)), (1, 99, dt.datetime(2026, 6, 14, 18)),
        ],
        "product_id int, qty_change bigint, created_at timestamp",
    )
    out = windows.end_of_day_stock(stock, moves, "2026-06-14", "2026-06-16")
    dated = moves.withColumn("created_at", F.col("created_at").cast("date"))
    assert rows(windows.end_of_day_stock(stock, dated, "2026-06-14", "2026-06-16")) == rows(out)
    got = {(r.product_id, r.snapshot_date.day): r.stock_qty for r in out.collect()}
    assert got == {(1, 14): 2845, (1, 15): 2706, (1, 16): 2535, (2, 14): 10, (2, 15): 10, (2, 16): 10}


def test_trailing_average_counts_idle_days(spark):
    sales = spark.createDataFrame([(1, d("2026-06-01"), 7), (1, d("2026-06-03"), 14)], "p int, on date, n bigint")
    out = windows.avg_daily_units(sales, "p", "on", "n", "2026-06-01", "2026-06-09")
    got = {r.day.day: r.avg_units for r in out.collect()}
    assert (got[1], got[2], got[3], got[8], got[9]) == (1.0, 1.0, 3.0, 2.0, 2.0)


def test_trailing_average_reads_the_days_before_its_first(spark):
    sales = spark.createDataFrame([(1, dt.datetime(2026, 1, n, 13), 7) for n in range(1, 21)], "p int, on timestamp, n bigint")
    out = windows.avg_daily_units(sales, "p", "on", "n", "2026-01-10", "2026-01-21")
    got = {r.day.day: r.avg_units for r in out.collect()}
    assert sorted(got) == list(range(10, 22)) and all(got[n] == 7.0 for n in range(10, 21)) and got[21] == 6.0


def test_gap_day_has_no_prior(spark):
    fact = spark.createDataFrame([(d("2026-01-01"),)] * 2 + [(d("2026-01-03"),)] * 3 + [(d("2026-01-04"),)] * 6, "day date")
    got = {r.day.day: (r.n_rows, r.prior_rows, r.change) for r in windows.dod_change(fact, "day").collect()}
    assert got == {1: (2, None, None), 3: (3, None, None), 4: (6, 3, 1.0)}
