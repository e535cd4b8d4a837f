"""Numbers in a total order, split windows, as-of joins by sorting, space-filling order, seeded draws."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayslice.errors import ReconcileError
from dayslice.operators import joins, layout, numbering, scd2, windows
from dayslice.plans import ads
from dayslice.session import materialize
from dayslice.sources import intake

from .conftest import d, rows

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_numbers_follow_the_order_also_in_a_hot_value(spark):
    rng = random.Random(4)
    data = [(7 if i % 3 else rng.randrange(50), f"n{rng.randrange(1000)}", i % 5) for i in range(3000)]
    df = spark.createDataFrame(data, "v int, name string, g int").repartition(7)
    got = numbering.number_in_order(df, [F.desc("v"), "name"], partitions=8)
    want = sorted(data, key=lambda r: (-r[0], r[1], r[0], r[1], r[2]))
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == want
    assert [r[0] for r in got.select("rank").orderBy("rank").collect()] == list(range(1, 3001))
    # Two thirds of the rows hold one value; no range holds more than a fourth of all.
    stored = got.withColumn("file", F.input_file_name()).groupBy("file").count().agg(F.max("count")).first()[0]
    assert stored <= 750
    assert "SinglePartition" not in layout.plan_text(got)


def test_numbers_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, "b"), (2, None), (None, "a")], "v int, name string")
    assert numbering.number_in_order(df.limit(0), ["v"]).count() == 0
    assert rows(numbering.number_in_order(df, ["v"]), "rank", "name") == [(1, "a"), (2, "b"), (3, None)]


@FEW
@given(picks=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 9)), max_size=40))
def test_split_days_number_as_one_window(spark, picks):
    data = [(i, e, d("2026-01-01") + dt.timedelta(days=day), v) for i, (e, day, v) in enumerate(picks)]
    df = spark.createDataFrame(data, "order_id int, e int, on date, v int")
    split = windows.order_sequence_split(df, "e", "on", ["v", "order_id"], hot_rows=3, ranges=4)
    whole = windows.order_sequence(df, "e", "on", ["v", "order_id"])
    assert rows(split) == rows(whole.select(split.columns))


def test_split_day_spreads_its_rows(spark):
    """One entity and day holds half of all rows; no range of it holds an eighth."""
    df = spark.range(8000).select(F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("e"), F.lit(d("2026-01-01")).alias("on"))
    split = windows.order_sequence_split(df, "e", "on", ["order_id"], hot_rows=500, ranges=16)
    assert split.where("e = 0").agg(F.max("order_no")).first()[0] == 4000
    # The day is a literal here; what is left of the key has the range in it.
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(e#\d+L?, _range#\d+, order_id", layout.plan_text(split, "simple"))
    cuts = [r[0] for r in df.where("e = 0").select(F.percentile_approx("order_id", [i / 16 for i in range(1, 16)], 1000)).collect()][0]
    sizes = [sum(1 for i in range(0, 8000, 2) if a <= i < b) for a, b in zip([-1, *cuts], [*cuts, 9000], strict=True)]
    assert max(sizes) < 1000


def versions_of(spark, n, key=1):
    day = d("2020-01-01")
    data = [(key, i, day + dt.timedelta(days=2 * i), day + dt.timedelta(days=2 * i + (0 if i % 10 == 3 else 1))) for i in range(n)]
    return spark.createDataFrame(data, "k int, version int, lo date, hi date")


@pytest.mark.parametrize("hot", [None, 100])
@pytest.mark.parametrize("closed", [True, False])
def test_sorted_as_of_join_equals_the_pairwise_one(spark, hot, closed):
    dim = versions_of(spark, 2000).unionByName(versions_of(spark, 3, 2))
    if not closed:
        dim = dim.withColumn("hi", F.when(F.col("version") < 1999, F.date_add("hi", 1)))
    dim = materialize(dim.unionByName(spark.createDataFrame([(None, 1, d("2000-01-01"), d("2040-01-01"))], dim.schema)), "dim")
    fact = spark.range(1200).select(
        F.col("id"), F.when(F.col("id") % 50 == 0, None).otherwise(F.when(F.col("id") % 7 == 0, F.lit(2)).otherwise(F.lit(1))).alias("k"),
        F.when(F.col("id") % 41 != 0, F.date_add(F.lit(d("2019-12-20")), (F.col("id") * 37 % 4100).cast("int"))).alias("at"), F.lit("x").alias("note"),
    )
    got = joins.join_as_of_sorted(fact, dim, ["k"], "at", "lo", "hi", closed, hot)
    want = joins.join_as_of(fact, dim, ["k"], "at", "lo", "hi", closed)
    assert got.columns == want.columns and rows(got) == rows(want)
    plan = layout.plan_text(got)
    assert "NestedLoop" not in plan and "Join condition: (" not in plan


def test_zorder_prunes_both_columns(spark, root):
    df = spark.range(20_000).select((F.xxhash64("id") % 1000).alias("a"), F.concat(F.lit("n"), F.lpad((F.xxhash64(F.col("id") + 7) % 1000 + 1000).cast("string"), 4, "0")).alias("b"), "id")
    layout.write_ranged(layout.zorder(df, ["a", "b"], 16), f"{root}/z", ["a", "b"])
    layout.write_ranged(layout.cluster_by(df, ["a"], 16), f"{root}/one", ["a", "b"])
    asked = {"a": (100, 120), "b": ("n1100", "n1120")}
    opened = {p: {c: len(layout.files_for(spark, f"{root}/{p}", c, *ends)) for c, ends in asked.items()} for p in ("z", "one")}
    assert opened["one"]["b"] == 16  # a sort by one column leaves the other everywhere
    assert opened["z"]["a"] <= 8 and opened["z"]["b"] <= 8
    for c, ends in asked.items():
        assert rows(layout.lookup(spark, f"{root}/z", df.schema, c, *ends)) == rows(df.where(F.col(c).between(*ends)))
    assert layout.lookup(spark, f"{root}/z", df.schema, "a", 5000, 6000).count() == 0


def test_zorder_of_nulls_dates_and_nothing(spark):
    df = spark.createDataFrame([(None, None, 1.5), (d("2026-01-01"), "b", None), (d("2026-01-02"), "", 2.5)], "on date, s string, x double")
    assert rows(layout.zorder(df, ["on", "s", "x"], 2)) == rows(df)
    assert layout.zorder(df.limit(0), ["on"], 2).count() == 0
    with pytest.raises(ValueError):
        layout.zorder(df, ["on"] * 8)


def test_only_small_files_are_rewritten(spark, root):
    path = f"{root}/c"
    spark.range(100_000).select("id", F.lit("a").alias("p")).coalesce(1).write.partitionBy("p").parquet(path)
    spark.range(100_000, 100_200).select("id", F.lit("a").alias("p")).repartition(8).write.mode("append").partitionBy("p").parquet(path)
    spark.range(200_000, 200_010).select("id", F.lit("b").alias("p")).coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    before = {r.path: r.length for r in spark.read.format("binaryFile").load(f"{path}/*/*.parquet").select("path", "length").collect()}
    large = max(before, key=before.get)
    report = layout.compact_small(spark, path, "p", target=before[large])
    after = {r.path for r in spark.read.format("binaryFile").load(f"{path}/*/*.parquet").select("path").collect()}
    assert (report["files"], report["rewritten_files"], report["new_files"]) == (10, 8, 1)
    assert report["bytes"] == sum(before.values()) and large in after and len(after) == 3
    fresh = spark.read.schema("id bigint, p string").parquet(path)
    assert fresh.count() == 100_210 and fresh.agg(F.sum("id")).first()[0] == sum(range(100_200)) + sum(range(200_000, 200_010))
    assert layout.compact_small(spark, path, "p", target=before[large])["rewritten_files"] == 0


def test_a_file_alone_in_its_bin_joins_the_one_before(spark):
    files = spark.createDataFrame([("a", f"f{i:02}", 40) for i in range(4)], "p string, file string, size bigint")
    assert rows(layout.small_file_plan(files, "p", 100), "file", "bin") == [("f00", 0), ("f01", 0), ("f02", 0), ("f03", 0)]


def test_compaction_refuses_other_content(spark, root, monkeypatch):
    path = f"{root}/c"
    spark.range(50).select("id", F.lit("a").alias("p")).repartition(4).write.partitionBy("p").parquet(path)
    seen = []
    real = layout.fingerprint
    monkeypatch.setattr(layout, "fingerprint", lambda df: real(df if not seen and not seen.append(1) else df.limit(49)))
    with pytest.raises(ReconcileError):
        layout.compact_small(spark, path, "p")
    assert spark.read.parquet(path).count() == 50


@FEW
@given(seen=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from("xy")), max_size=14, unique_by=lambda t: t[:2]))
@pytest.mark.parametrize("closed", [True, False])
def test_closing_history_equals_the_daily_replay(spark, seen, closed):
    days = sorted({day for _, day, _ in seen})
    snaps = spark.createDataFrame([(k, d("2026-01-01") + dt.timedelta(days=day), t) for k, day, t in seen], "id int, snapshot_date date, tier string")
    if closed:
        dim = spark.createDataFrame([], "id int, tier string, effective_date date, expiration_date date, is_current boolean, version int")
    else:
        dim = spark.createDataFrame([], "customer_key bigint, id int, tier string, effective_from date, effective_to date, is_current boolean")
    apply = scd2.apply_scd2_closed if closed else scd2.apply_scd2_open
    for day in days:
        ds = d("2026-01-01") + dt.timedelta(days=day)
        today = snaps.where(F.col("snapshot_date") == F.lit(ds)).select("id", "tier")
        dim = materialize(apply(dim, today, ["id"], ["tier"], ds, close_missing=True), "dim")
    got = scd2.scd2_from_snapshots_closing(snaps, ["id"], ["tier"], closed=closed)
    assert rows(got) == rows(dim.select(got.columns))


def test_draws_are_stable_and_samples_grow(spark):
    df = spark.range(2000).withColumn("k", F.col("id") % 500)
    small = numbering.sample_by_key(df, ["k"], 0.1, 3)
    large = numbering.sample_by_key(df.repartition(13), ["k"], 0.3, 3)
    assert small.exceptAll(large).count() == 0 and 0.2 < large.count() / 2000 < 0.4
    assert rows(small) == rows(numbering.sample_by_key(df.repartition(5), ["k"], 0.1, 3))
    assert small.groupBy("k").count().where("count <> 4").count() == 0
    assert rows(small) != rows(numbering.sample_by_key(df, ["k"], 0.1, 4))


def test_reach_of_days_from_sketches(spark):
    events = spark.range(30_000).select(
        F.date_add(F.lit(d("2026-01-01")), (F.col("id") % 3).cast("int")).alias("event_date"), F.lit("ad_1").alias("ad_id"), (F.col("id") % 7000).cast("string").alias("user_id")
    )
    sketches = materialize(ads.reach_sketches(events), "sketches")
    got = ads.reach(sketches, "2026-01-01", "2026-01-03").first()
    assert got.days == 3 and abs(got.reach - 7000) <= 175
    assert ads.missing_days(sketches, "2026-01-01", "2026-01-03").count() == 0
    holed = sketches.where(F.col("event_date") != F.lit(d("2026-01-02")))
    assert rows(ads.missing_days(holed, "2026-01-01", "2026-01-03")) == [(d("2026-01-02"),)]
    assert ads.reach(holed, "2026-01-01", "2026-01-03").first().days == 2


def test_files_are_hashed_whole_or_in_pieces(spark, root, monkeypatch):
    monkeypatch.setattr(intake, "PIECE", 7)
    spark.createDataFrame([("one,two",), ("three",)], "line string").repartition(2).write.text(f"{root}/a")
    assert intake.write_companions(spark, f"{root}/a/*.txt") == 2
    whole = intake.verify_checksums(spark, f"{root}/a/*.txt")
    pieces = intake.verify_checksums(spark, f"{root}/a/*.txt", largest_value=0)
    assert rows(whole) == rows(pieces) and whole.where("ok").count() == 2
    spoiled = whole.first().path
    intake.put_texts(spark.createDataFrame([(spoiled, "other")], "path string, text string"))
    assert rows(intake.verify_checksums(spark, f"{root}/a/*.txt", largest_value=0).where("NOT ok"), "path") == [(spoiled,)]
