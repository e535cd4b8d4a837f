"""Rules the whole package keeps: no clock, no local checkpoints, no row-wise Python, checked broadcasts."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dayslice.operators import layout
from dayslice.operators.joins import broadcast_dim
from dayslice.session import estimated_bytes, fits_broadcast, materialize

from .conftest import ROOT, rows

SOURCES = sorted(p for p in (ROOT / "dayslice").rglob("*.py") if "llm" not in p.parts) + sorted((ROOT / "workload").rglob("*.py"))
FORBIDDEN = {
    "reads the clock": r"current_timestamp|current_date\(|F\.now\(|datetime\.now|date\.today|time\.time\(",
    "local checkpoint": r"localCheckpoint",
    "row-wise Python": r"F\.udf|@udf|pandas_udf|applyInPandas|mapInPandas|\.rdd\b",
    "cross join": r"crossJoin",
    "whole table on the driver": r"toPandas|toLocalIterator",
    "partition-dependent random": r"F\.rand\(|monotonically_increasing_id",
}


@pytest.mark.parametrize("what", sorted(FORBIDDEN))
def test_sources_keep_the_rule(what):
    hits = [f"{p.name}: {m}" for p in SOURCES for m in re.findall(FORBIDDEN[what], Path(p).read_text())]
    assert not hits


def test_broadcast_only_below_the_limit(spark, root):
    spark.range(10_000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(f"{root}/dim")
    dim = spark.read.parquet(f"{root}/dim")
    fact = spark.range(100).select(F.col("id").alias("k"))
    assert fits_broadcast(dim) and not fits_broadcast(dim, 10) and estimated_bytes(dim) > 10
    # The hint is what differs: with automatic broadcasts off, only the small one is sent.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = layout.plan_text(fact.join(broadcast_dim(dim), "k"), "simple")
        large = layout.plan_text(fact.join(broadcast_dim(dim, 10), "k"), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "SortMergeJoin" in large


def test_materialized_frame_reads_from_the_shared_folder(spark):
    df = materialize(spark.range(5), "five")
    assert rows(df) == [(i,) for i in range(5)] and "Range" not in layout.plan_text(df, "simple")
