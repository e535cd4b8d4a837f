"""Daily runs: the operators in sequence, each step ending in a sink that can run again.

A run takes the date, writes every layer below `root`, and returns its checks. It raises
before a later layer is touched when a gate fails. Running a date twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day
from ..operators import access, contracts, quality, reconcile
from ..operators.dedup import keep_first
from ..operators.load import upsert_activity, upsert_scd1
from ..operators.shape import in_domain, validate_orders
from ..session import materialize
from ..sources import writers
from ..sources.readers import assert_nonempty, read_json_partition, read_parquet_slice, read_partitioned
from .ads import KNOWN_COLUMNS, ad_daily, ad_daily_rules, campaign_metrics, fact_ad_events
from .ads import low_ctr, over_budget
from .orders import daily_revenue

# Contracts and domains of the sources.
AD_CONTRACT = {
    "event_id": "string",
    "ad_id": "string",
    "campaign_id": "string",
    "user_id": "string",
    "event_type": "string",
    "event_ts": "timestamp",
}
AD_IDS = ("event_id", "ad_id", "campaign_id", "user_id")
ORDER_STATUSES = ("completed", "refunded", "pending")
PII_COLUMNS = ("phone", "email", "cccd")

# Columns of the marketplace's order export.
MARKETPLACE_ORDERS = "order_id string, partner string, customer_email string, amount double, order_ts timestamp, status string"

SILVER_ORDERS_SUITE: Sequence[quality.Rule] = (
    {"expectation_type": quality.ROW_COUNT, "kwargs": {"min_value": 1}},
    {"expectation_type": quality.NOT_NULL, "kwargs": {"column": "order_date"}},
    {"expectation_type": quality.NOT_NULL, "kwargs": {"column": "customer_id"}},
    {"expectation_type": quality.BETWEEN, "kwargs": {"column": "amount", "min_value": 0}},
    {"expectation_type": quality.UNIQUE, "kwargs": {"column": "order_id"}},
)


def run_orders_day(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    ds: str,
    min_amount: float = 0.0,
    inclusive: bool = True,
    max_drift: float = 0.5,
    buckets: int = 256,
    suite: Sequence[quality.Rule] = SILVER_ORDERS_SUITE,
) -> DataFrame:
    """Orders of one date: bronze, gated silver, customer dimension, sales fact, reconciliation."""
    writers.write_slice(raw, f"{root}/bronze/orders", "order_date", ds, packed=True)
    bronze = read_parquet_slice(spark, f"{root}/bronze/orders", "order_date", ds)
    valid = validate_orders(bronze, ds, min_amount, inclusive)
    quality.gate(quality.run_suite(valid, suite))
    writers.write_slice(valid, f"{root}/silver/orders", "order_date", ds, packed=True)

    silver = read_parquet_slice(spark, f"{root}/silver/orders", "order_date", ds)
    # Distinct first: a hash table of the names instead of a sort of all orders in each task.
    seen = silver.select("customer_id", "customer_name").distinct()
    names = keep_first(seen, ["customer_id"], ["customer_name"])
    dim_path = f"{root}/gold/dim_customer"

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert_scd1(old, new, ["customer_id"], ["customer_name"], ds)

    def first(new: DataFrame) -> DataFrame:
        return new.withColumns({"first_seen_date": day(ds), "last_updated_date": day(ds)})

    writers.upsert_table(spark, dim_path, names, "customer_id", merge, first, buckets)
    fact_path = f"{root}/gold/fact_sales"
    writers.write_slice(
        silver.select("order_id", "customer_id", "amount", "order_date"), fact_path, "order_date", ds, packed=True
    )

    fact = read_parquet_slice(spark, fact_path, "order_date", ds)
    checks = reconcile.evaluate(
        reconcile.recon_count(silver, fact),
        reconcile.recon_sum(silver, fact, "amount"),
        reconcile.recon_rules(
            fact, writers.read_buckets(spark, dim_path), "customer_id", "amount", inclusive
        ),
        reconcile.recon_dod(read_partitioned(spark, fact_path), "order_date", ds, max_drift),
    )
    reconcile.require(checks)
    return checks


def run_ads_day(
    spark: SparkSession, raw: DataFrame, root: str, ds: str, max_drift: float = 0.5, buckets: int = 256
) -> DataFrame:
    """Ad events of one date: contract, fact, daily metrics, ad dimension, reconciliation."""
    drift = contracts.check_schema(assert_nonempty(raw, f"ad events {ds}"), AD_CONTRACT)
    contracts.enforce(drift, retyped_ok=AD_IDS)
    fact_path, agg_path = f"{root}/silver/fact_ad_events", f"{root}/gold/agg_ad_daily"
    writers.write_slice(fact_ad_events(raw, ds), fact_path, "event_date", ds, evolving=True, packed=True)

    known = writers.read_evolving(spark, fact_path)
    fact = known.where(F.col("event_date") == day(ds))
    writers.write_slice(ad_daily(fact), agg_path, "event_date", ds, packed=True)

    history = read_partitioned(spark, agg_path)
    daily = history.where(F.col("event_date") == day(ds))
    attrs = {"campaign_id": "campaign_id", "latest_ctr": "ctr"}
    dim_path = f"{root}/gold/dim_ad"

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert_activity(old, new, "ad_id", ds, attrs)

    def first(new: DataFrame) -> DataFrame:
        return new.select(
            "ad_id",
            "campaign_id",
            day(ds).alias("first_seen_date"),
            day(ds).alias("last_active_date"),
            F.col("ctr").alias("latest_ctr"),
        )

    writers.upsert_table(spark, dim_path, daily, "ad_id", merge, first, buckets)
    dim = writers.read_buckets(spark, dim_path)
    checks = reconcile.evaluate(
        reconcile.check_unique(fact, ["event_id"]),
        reconcile.recon_tieout(fact, daily, "impression", "impressions"),
        reconcile.check_rules(daily, ad_daily_rules()),
        reconcile.recon_dod(known, "event_date", ds, max_drift),
        *reconcile.check_activity_dim(dim, history, "ad_id", ds),
    )
    reconcile.require(checks)
    return checks


def read_ads(spark: SparkSession, root: str) -> DataFrame:
    """The ad fact with the columns of all its ages, in contract order."""
    table = writers.read_evolving(spark, f"{root}/silver/fact_ad_events")
    return table.select([c for c in KNOWN_COLUMNS if c in table.columns] + ["event_date"])


def run_marketplace_day(
    spark: SparkSession, raw: DataFrame, root: str, ds: str, fill_missing: bool = False
) -> DataFrame:
    """Partner orders of one date: bronze, de-duplicated and hashed silver, daily revenue, checks.

    A missing column stops the run. With `fill_missing` it loads as NULL, and the value check
    at the end is what still catches it.
    """
    empty = spark.createDataFrame([], MARKETPLACE_ORDERS)
    rows = contracts.align(assert_nonempty(raw, f"marketplace orders {ds}"), empty.schema, fill_missing)
    dated = rows.withColumn("order_date", F.col("order_ts").cast("date"))
    writers.write_slice(dated, f"{root}/bronze/marketplace_orders", "order_date", ds, packed=True)

    bronze = read_parquet_slice(spark, f"{root}/bronze/marketplace_orders", "order_date", ds)
    unique = in_domain(keep_first(bronze, ["order_id"], ["order_ts"]), "status", ORDER_STATUSES)
    silver_rows = access.hash_column(unique, "customer_email").select(
        "order_id", "partner", "amount", "order_date", "status", "customer_email_masked"
    )
    writers.write_slice(silver_rows, f"{root}/silver/orders", "order_date", ds, packed=True)

    silver = read_parquet_slice(spark, f"{root}/silver/orders", "order_date", ds)
    writers.write_slice(
        daily_revenue(silver, ds), f"{root}/gold/fact_daily_revenue", "order_date", ds, packed=True
    )
    gold = read_parquet_slice(spark, f"{root}/gold/fact_daily_revenue", "order_date", ds)
    checks = reconcile.evaluate(
        reconcile.check_positive(silver),
        reconcile.recon_rollup(silver, gold, "order_count"),
        reconcile.check_positive(gold, "total_revenue"),
    )
    reconcile.require(checks)
    return checks


def run_customers_day(
    spark: SparkSession, raw: DataFrame, root: str, ds: str, at: str, buckets: int = 256
) -> DataFrame:
    """Customers of one date: bronze, cleaned silver, tiered gold, and the access trail.

    Only counts leave the tables. `at` is the time stamped on the trail.
    """
    bronze_path, silver_path = f"{root}/bronze/customers", f"{root}/silver/customers"
    n_raw = writers.write_slice(raw.withColumn("ingested_at", day(ds)), bronze_path, "ingested_at", ds, packed=True)
    bronze = read_partitioned(spark, bronze_path)
    batch = access.customers_silver(bronze, None, ds)

    def replace(old: DataFrame, new: DataFrame) -> DataFrame:
        kept = old.join(new.select("customer_id"), "customer_id", "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)

    # The rows of the day are those of the batch; the table as a whole is not read for them.
    today = materialize(batch, "customers-today")
    writers.upsert_table(spark, silver_path, today, "customer_id", replace, lambda b: b, buckets)
    tiers = access.with_tiers(today, "account_balance", "credit_score")
    gold = access.minimize(
        tiers,
        {
            "customer_id", "segment", "region", "registered_at", "phone", "email", "cccd",
            "balance_tier", "credit_tier", "updated_at",
        },
    )
    writers.upsert_table(
        spark, f"{root}/gold/customer_analytics", gold, "customer_id", replace, lambda b: b, buckets
    )
    n_batch = today.count()
    trail = access.audit_row(spark, "ingest_bronze", "raw.customers", PII_COLUMNS, n_raw, ds, at)
    for job, table in (("transform_silver", "silver.customers"), ("transform_gold", "gold.customer_analytics")):
        trail = trail.unionByName(access.audit_row(spark, job, table, PII_COLUMNS, n_batch, ds, at))
    trail.coalesce(1).write.mode("overwrite").json(f"{root}/audit/pii_access/dt={ds}")
    checks = reconcile.evaluate(
        reconcile.check_source(raw),
        reconcile.check_not_null(today, "customer_id"),
        reconcile.check_unique(today, ["customer_id"]),
    )
    reconcile.require(checks)
    return checks


def run_campaigns_day(
    spark: SparkSession,
    events: DataFrame,
    root: str,
    ds: str,
    budget: float = 5.0,
    min_ctr: float = 0.15,
) -> DataFrame:
    """Campaign metrics of one date, published once they add up, and the two alert reports."""
    writers.write_json_partition(events, root, "raw", "ad_events", ds)
    raw = read_json_partition(spark, root, "raw", "ad_events", ds, events.schema)
    metrics = campaign_metrics(raw)
    place = ("staged", "campaign_metrics", ds)
    writers.write_json_partition(metrics, root, *place)
    staged = read_json_partition(spark, root, *place, metrics.schema)
    # What was written is counted against what landed; only then it is published.
    checks = reconcile.evaluate(reconcile.recon_rollup(raw, staged, "impressions"))
    reconcile.require(checks)
    writers.write_json_partition(staged, root, "published", "campaign_metrics", ds)
    writers.write_json_partition(
        over_budget(staged, budget, ds), root, "reports", "campaign_spend", ds
    )
    writers.write_json_partition(
        low_ctr(staged, min_ctr, ds), root, "reports", "campaign_low_ctr", ds
    )
    return checks
