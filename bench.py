"""Time the headline queries and three full daily runs; print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the threads.
Each query is written to the no-op sink, so every row and column is computed and none
is brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from dayslice.plans import pipelines  # noqa: E402
from dayslice.session import build_session  # noqa: E402
from workload import all_queries, recipes  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "dedup_keep_first",
    "validate_snapshot",
    "top_order_per_customer",
    "best_slow_sellers",
    "surrogate_numbers",
    "order_sequence",
    "avg_daily_units",
    "eod_stock",
    "ad_daily",
    "campaign_metrics",
    "customer_daily_backfill",
    "state_gmv",
    "status_category_gmv",
    "category_revenue",
    "daily_ops",
    "seller_product_stats",
    "risk_by_status",
    "item_payment_pairs",
    "skew_join",
    "diff_tables",
    "upsert_scd1",
    "upsert_all",
    "apply_cdc",
    "merge_buckets",
    "scd2_from_snapshots",
    "scd2_closed",
    "scd2_open",
    "join_as_of",
    "quality_suite_broken",
    "recon_orders",
    "secure_view_analyst",
    "revenue_by_channel",
    "net_after_refund",
    "delivery_rate",
    "campaign_effect",
    "repeat_rate",
    "compact_files",
    "published_slices",
    "stream_tumbling_append",
    "join_as_of_sorted",
    "ranked_orders",
    "scd2_from_snapshots_closing",
)


def orders_run(spark, root: str) -> None:
    """All items as one day of orders through every layer, with gate and reconciliation."""
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").dropDuplicates(["l_orderkey", "l_linenumber"])
    raw = items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"),
        F.col("l_suppkey").cast("int").alias("customer_id"),
        F.concat(F.lit("Customer "), F.col("l_suppkey").cast("string")).alias("customer_name"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("2026-01-15").cast("date").alias("order_date"),
    )
    pipelines.run_orders_day(spark, raw, root, "2026-01-15", buckets=8)


def campaigns_run(spark, root: str) -> None:
    """All events as one day of campaign impressions: raw, metrics, check, publication, reports."""
    pipelines.run_campaigns_day(spark, recipes.campaign_events(spark, SF_DIR).drop("date"), root, "2024-01-15")


def ads_run(spark, root: str) -> None:
    """All ad events moved to one day: contract, fact, metrics, dimension, reconciliation."""
    moved = F.date_format("event_ts", "HH:mm:ss.SSSSSS")
    # Clicks without a view would break the run's own rules, so each click is also a view.
    raw = recipes.ad_raw(spark, SF_DIR).drop("debug_note").withColumn(
        "event_ts", F.concat(F.lit("2024-01-15 "), moved).cast("timestamp")
    )
    views = raw.where("event_type = 'click'").withColumns(
        {"event_type": F.lit("impression"), "event_id": -F.col("event_id") - 1}
    )
    typed = raw.unionByName(views).withColumn("event_id", F.col("event_id").cast("string"))
    pipelines.run_ads_day(spark, typed, root, "2024-01-15", buckets=8)


DAILY_RUNS = {
    "orders_daily_run": orders_run,
    "campaigns_daily_run": campaigns_run,
    "ads_daily_run": ads_run,
}


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    # Three runs that are not measured, so that the JVM's compilers have started.
    for name in ("dedup_keep_first", "item_payment_pairs", "scd2_from_snapshots"):
        registered[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.time()
        df = registered[name].run(spark, SF_DIR)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    for name, run in DAILY_RUNS.items():
        start = time.time()
        run(spark, tempfile.mkdtemp(prefix="spark-"))
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
