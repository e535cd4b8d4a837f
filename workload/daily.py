"""The daily runs and the guards around them, each over whole tables and then read back."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dayslice.errors import PipelineError
from dayslice.functions import columns as C
from dayslice.operators import contracts, joins, load, quality
from dayslice.plans import pipelines
from dayslice.session import new_dir
from dayslice.sources import writers
from dayslice.sources.readers import read_partitioned

from . import recipes as R
from .recipes import with_tables
from .registry import query

DS = "2026-01-15"
_ITEMS = """items AS (SELECT l_orderkey * 10 + l_linenumber AS order_id, CAST(min(l_suppkey) AS BIGINT) AS customer_id,
  CAST(min(l_extendedprice) AS DOUBLE) AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def item_orders(spark, sf):
    """All lines as one day of orders, the least of repeated ones."""
    items = R.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("supp"), F.min("l_extendedprice").alias("amount")
    )
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"),
        F.col("supp").cast("int").alias("customer_id"),
        F.concat(F.lit("Customer "), F.col("supp").cast("string")).alias("customer_name"),
        "amount",
        C.day(DS).alias("order_date"),
    )


@query("orders_daily_run", f"WITH {_ITEMS} SELECT customer_id, COUNT(*) AS orders, CAST(SUM(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) AS amount FROM items GROUP BY 1")
def orders_daily_run(spark, sf):
    """A day run twice; the fact is read back."""
    root = new_dir(spark, "orders-run")
    for _ in range(2):
        pipelines.run_orders_day(spark, item_orders(spark, sf), root, DS, buckets=16)
    fact = read_partitioned(spark, f"{root}/gold/fact_sales")
    return fact.groupBy("customer_id").agg(F.count("*").alias("orders"), C.total("amount").alias("amount"))


@query(
    "orders_daily_run_dimension",
    f"WITH {_ITEMS} SELECT DISTINCT customer_id, 'Customer ' || customer_id AS customer_name, '{DS}' AS first_seen_date FROM items",
)
def orders_daily_run_dimension(spark, sf):
    root = new_dir(spark, "orders-run")
    pipelines.run_orders_day(spark, item_orders(spark, sf), root, DS, buckets=16)
    return writers.read_buckets(spark, f"{root}/gold/dim_customer").select("customer_id", "customer_name", "first_seen_date")


@query(
    "campaigns_daily_run",
    with_tables(
        """SELECT campaign, COUNT(*) AS impressions, CAST(SUM(CASE WHEN is_click THEN 1 ELSE 0 END) AS BIGINT) AS clicks
FROM campaign_events GROUP BY 1""",
        "campaign_events",
    ),
)
def campaigns_daily_run(spark, sf):
    root = new_dir(spark, "campaigns-run")
    pipelines.run_campaigns_day(spark, R.campaign_events(spark, sf).drop("date"), root, "2024-01-15")
    published = spark.read.schema("campaign string, impressions bigint, clicks bigint").json(f"{root}/published/campaign_metrics")
    return published.select("campaign", "impressions", "clicks")


@query(
    "blocked_publication",
    f"""WITH {_ITEMS} SELECT 'blocked' AS outcome, CAST(0 AS BIGINT) AS written, COUNT(*) AS bad FROM items WHERE order_id % 5 = 0""",
)
def blocked_publication(spark, sf):
    """A suite that fails keeps the slice from being written."""
    path = new_dir(spark, "blocked")
    broken = item_orders(spark, sf).withColumn("customer_id", F.when(F.col("order_id") % 5 != 0, F.col("customer_id")))
    result = quality.run_suite(broken, pipelines.SILVER_ORDERS_SUITE)
    try:
        writers.publish(broken, path, "order_date", DS, result)
        outcome = "written"
    except PipelineError:
        outcome = "blocked"
    bad = result.where(F.col("column") == "customer_id").agg(F.max("unexpected").cast("bigint").alias("bad"))
    written = int(writers.has_slices(spark, path))
    return bad.select(F.lit(outcome).alias("outcome"), F.lit(written).cast("bigint").alias("written"), "bad")


@query(
    "enforced_contract",
    """SELECT 'stopped' AS outcome, COUNT(*) AS n FROM events""",
)
def enforced_contract(spark, sf):
    """Events without one column of their contract are not loaded."""
    events = R.ad_raw(spark, sf).drop("user_id")
    try:
        contracts.enforce(contracts.check_schema(events, pipelines.AD_CONTRACT), retyped_ok=pipelines.AD_IDS)
        outcome = "loaded"
    except PipelineError:
        outcome = "stopped"
    return R.table(spark, sf, "events").agg(F.count("*").alias("n")).withColumn("outcome", F.lit(outcome)).select("outcome", "n")


@query("refused_batch", "SELECT 'refused' AS outcome, COUNT(*) - COUNT(DISTINCT l_orderkey) > 0 AS repeats FROM lineitem")
def refused_batch(spark, sf):
    """An upsert whose source repeats keys fails while its rows flow."""
    source = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("v"))
    target = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("v"))
    try:
        load.upsert_all(target, source, ["id"]).write.format("noop").mode("overwrite").save()
        outcome = "applied"
    except PySparkException:
        outcome = "refused"
    repeats = source.agg((F.count("*") - F.count_distinct("id") > 0).alias("repeats"))
    return repeats.select(F.lit(outcome).alias("outcome"), "repeats")


@query("replaced_table", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def replaced_table(spark, sf):
    """A table written whole, then replaced by a part of it with another layout."""
    path, orders = new_dir(spark, "replaced"), R.table(spark, sf, "orders")
    writers.overwrite_table(orders, path, "o_orderstatus")
    writers.overwrite_table(orders.where("o_orderstatus = 'F'"), path, "o_orderpriority")
    return read_partitioned(spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("largest_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(spark, sf):
    """A limit after a total order, which is the feature here."""
    orders = R.table(spark, sf, "orders")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(
    "marketplace_daily_run",
    with_tables(
        """SELECT partner, COUNT(*) AS order_count, CAST(SUM(amount) AS DOUBLE) AS total_revenue FROM orders_v GROUP BY 1""",
        "orders_v",
    ),
)
def marketplace_daily_run(spark, sf):
    """All orders moved to one day of partner exports."""
    root = new_dir(spark, "market-run")
    raw = R.orders_v(spark, sf).select(
        F.col("order_id").cast("string").alias("order_id"),
        "partner",
        F.concat(F.lit("c"), F.col("customer_id").cast("string"), F.lit("@mail.example")).alias("customer_email"),
        F.col("amount").cast("double").alias("amount"),
        F.lit(f"{DS} 10:00:00").cast("timestamp").alias("order_ts"),
        F.lit("completed").alias("status"),
    )
    for _ in range(2):
        pipelines.run_marketplace_day(spark, raw, root, DS)
    return read_partitioned(spark, f"{root}/gold/fact_daily_revenue").select("partner", "order_count", "total_revenue")


@query("customers_daily_run", "SELECT c_custkey::VARCHAR AS customer_id, c_mktsegment AS segment FROM customer")
def customers_daily_run(spark, sf):
    """All customers as one day, run twice; the minimized table is read back."""
    root = new_dir(spark, "customers-run")
    raw = R.customers_v(spark, sf).withColumns(
        {"customer_id": F.col("customer_id").cast("string"), "registered_at": F.lit("2020-01-01 00:00:00").cast("timestamp")}
    )
    for _ in range(2):
        pipelines.run_customers_day(spark, raw, root, DS, f"{DS}T00:00:00Z", buckets=16)
    return writers.read_buckets(spark, f"{root}/gold/customer_analytics").select("customer_id", "segment")



@query("appended_partitions", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1")
def appended_partitions(spark, sf):
    """Two halves of a table appended to one partitioned folder."""
    path, orders = new_dir(spark, "appended"), R.table(spark, sf, "orders")
    for half in (0, 1):
        writers.append_partitioned(orders.where(F.col("o_orderkey") % 2 == half), path, "o_orderpriority")
    return read_partitioned(spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "small_dimension_join",
    """SELECT n_name, COUNT(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
)
def small_dimension_join(spark, sf):
    """A dimension whose size estimate is checked before it is broadcast."""
    nations = joins.broadcast_dim(R.table(spark, sf, "nation").select("n_nationkey", "n_name"))
    per_nation = R.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return per_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers")
