"""Projection, validation, anomaly flags, set operators, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayslice.functions import columns as C
from dayslice.operators import numbering, shape
from dayslice.sources import catalog
from dayslice.sources.readers import date_series

from . import recipes as R
from .recipes import with_tables
from .registry import query


@query(
    "validate_orders",
    with_tables(
        """SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, CAST(amount AS DOUBLE) AS amount
FROM bronze_orders WHERE customer_id IS NOT NULL AND amount IS NOT NULL AND amount >= 0""",
        "bronze_orders",
    ),
)
def validate_orders(spark, sf):
    return shape.validate_orders(R.bronze_orders(spark, sf))


@query(
    "validate_orders_by_day",
    with_tables(
        """SELECT CAST(order_date AS VARCHAR) AS order_date, COUNT(*) AS n_raw,
  COUNT(*) FILTER (WHERE customer_id IS NOT NULL AND amount >= 0) AS n_kept,
  COUNT(*) FILTER (WHERE customer_id IS NOT NULL AND amount > 0) AS n_positive
FROM bronze_orders GROUP BY 1""",
        "bronze_orders",
    ),
)
def validate_orders_by_day(spark, sf):
    return R.bronze_orders(spark, sf).groupBy("order_date").agg(
        F.count("*").alias("n_raw"),
        C.count_if(shape.valid_order(0.0, True)).alias("n_kept"),
        C.count_if(shape.valid_order(0.0, False)).alias("n_positive"),
    )


@query(
    "stamp_valid_orders",
    with_tables(
        """SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date,
  CAST(amount AS DOUBLE) AS amount, '2001-08-02' AS processed_at
FROM bronze_orders WHERE customer_id IS NOT NULL AND amount > 0""",
        "bronze_orders",
    ),
)
def stamp_valid_orders(spark, sf):
    return shape.stamp_valid(R.bronze_orders(spark, sf), "2001-08-02")


@query(
    "quarantine_orders",
    with_tables(
        """SELECT order_id, CAST(amount AS DOUBLE) AS amount,
  concat_ws(',', CASE WHEN customer_id IS NULL THEN 'customer_known' END,
    CASE WHEN amount < 0 THEN 'amount_not_negative' END) AS reasons
FROM bronze_orders WHERE customer_id IS NULL OR amount < 0""",
        "bronze_orders",
    ),
)
def quarantine_orders(spark, sf):
    rules = {
        "customer_known": F.col("customer_id").isNotNull(),
        "amount_not_negative": F.col("amount") >= 0,
    }
    _, rejected = shape.split_valid(R.bronze_orders(spark, sf), rules)
    return rejected.select("order_id", "amount", F.array_join("reasons", ",").alias("reasons"))


@query(
    "order_anomalies",
    with_tables(
        """SELECT order_id, shipping_fee = 0 AND voucher_code IS NULL AS is_zero_shipping,
  discount_amount > subtotal AS is_over_discounted
FROM shop_orders WHERE (shipping_fee = 0 AND voucher_code IS NULL) OR discount_amount > subtotal""",
        "shop_orders",
    ),
)
def order_anomalies(spark, sf):
    flagged = shape.flag_order_anomalies(R.shop_orders(spark, sf))
    return flagged.where("is_zero_shipping OR is_over_discounted").select(
        "order_id", "is_zero_shipping", "is_over_discounted"
    )


@query(
    "item_anomalies",
    with_tables(
        """SELECT return_flag, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE quantity - 1 = 0) AS cancelled_lines,
  CAST(SUM(quantity - 1) AS BIGINT) AS units
FROM items_v GROUP BY 1""",
        "items_v",
    ),
)
def item_anomalies(spark, sf):
    items = R.items_v(spark, sf).withColumn("quantity", F.col("quantity") - 1)
    flagged = shape.flag_item_anomalies(items)
    return flagged.groupBy("return_flag").agg(
        F.count("*").alias("n_lines"),
        C.count_if(F.col("is_cancelled_line")).alias("cancelled_lines"),
        F.sum(F.when(~F.col("is_cancelled_line"), F.col("quantity"))).alias("units"),
    )


@query(
    "product_flags",
    with_tables(
        """SELECT product_id, CAST(base_price AS DOUBLE) AS base_price, CAST(cost_price AS DOUBLE) AS cost_price,
  cost_price > base_price AS is_loss_making FROM products_v""",
        "products_v",
    ),
)
def product_flags(spark, sf):
    return shape.flag_products(R.products_v(spark, sf)).select(
        "product_id", "base_price", "cost_price", "is_loss_making"
    )


@query(
    "customers_without_phone",
    with_tables(
        """SELECT segment, COUNT(*) AS customers, COUNT(*) FILTER (WHERE phone IS NULL) AS without_phone
FROM customers_v GROUP BY 1""",
        "customers_v",
    ),
)
def customers_without_phone(spark, sf):
    return shape.flag_customers(R.customers_v(spark, sf)).groupBy("segment").agg(
        F.count("*").alias("customers"), C.count_if(F.col("has_no_phone")).alias("without_phone")
    )


@query(
    "events_in_domain",
    """SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""",
)
def events_in_domain(spark, sf):
    known = shape.in_domain(R.table(spark, sf, "events"), "event_type", ["view", "click"])
    return known.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(C.money("value")).alias("total")
    )


@query(
    "events_in_window",
    """SELECT event_type, COUNT(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1""",
)
def events_in_window(spark, sf):
    events = R.table(spark, sf, "events")
    return shape.in_window(events, "ts", C.day("2024-01-08"), C.day("2024-01-22")).groupBy(
        "event_type"
    ).agg(F.count("*").alias("n"))


@query("distinct_customers", "SELECT DISTINCT o_custkey AS customer_id, o_orderstatus AS order_status FROM orders")
def distinct_customers(spark, sf):
    return R.orders_v(spark, sf).select("customer_id", "order_status").distinct()


@query("low_balance_count", "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal < 450")
def low_balance_count(spark, sf):
    return shape.count_where(R.table(spark, sf, "customer"), F.col("c_acctbal") < 450)


@query(
    "column_coverage",
    with_tables(
        """SELECT segment, region, COUNT(*) AS n_rows, COUNT(phone) AS phone_present, COUNT(email) AS email_present
FROM customers_v GROUP BY 1, 2""",
        "customers_v",
    ),
)
def column_coverage(spark, sf):
    return shape.coverage(R.customers_v(spark, sf), ["segment", "region"], ["phone", "email"])


@query(
    "union_evolving",
    """SELECT event_type, COUNT(*) AS n_rows, COUNT(device) AS with_device FROM (
  SELECT event_id, event_type, NULL AS device FROM events WHERE ts < TIMESTAMP '2024-01-16'
  UNION ALL
  SELECT event_id, event_type, CASE WHEN user_id > 50 THEN 'ios' END FROM events WHERE ts >= TIMESTAMP '2024-01-16'
) GROUP BY 1""",
)
def union_evolving(spark, sf):
    events, cut = R.table(spark, sf, "events"), C.day("2024-01-16")
    old = events.where(F.col("ts") < cut).select("event_id", "event_type")
    new = events.where(F.col("ts") >= cut).select(
        "event_id", "event_type", F.when(F.col("user_id") > 50, F.lit("ios")).alias("device")
    )
    return shape.union_evolving(old, new).groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count("device").alias("with_device")
    )


_SETS = """SELECT {cols} FROM (SELECT o_custkey AS customer_id, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F')
{op} ALL
SELECT {cols} FROM (SELECT o_custkey AS customer_id, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'O')"""


def _status_sets(spark, sf):
    years = R.orders_v(spark, sf).select(
        "customer_id", F.year("order_date").cast("bigint").alias("y"), "order_status"
    )
    return [years.where(F.col("order_status") == s).drop("order_status") for s in ("F", "O")]


@query("table_minus", _SETS.format(cols="customer_id, y", op="EXCEPT"))
def table_minus(spark, sf):
    return shape.table_minus(*_status_sets(spark, sf))


@query("table_common", _SETS.format(cols="customer_id, y", op="INTERSECT"))
def table_common(spark, sf):
    return shape.table_common(*_status_sets(spark, sf))


@query(
    "revenue_rollup",
    with_tables(
        """SELECT CASE WHEN GROUPING(order_status) = 1 THEN 'ALL' ELSE order_status END AS order_status,
  CASE WHEN GROUPING(partner) = 1 THEN 'ALL' ELSE partner END AS partner, CAST(SUM(amount) AS DOUBLE) AS revenue
FROM orders_v GROUP BY ROLLUP (order_status, partner)""",
        "orders_v",
    ),
)
def revenue_rollup(spark, sf):
    return shape.rollup_sum(R.orders_v(spark, sf), ["order_status", "partner"], "amount", "revenue")


@query(
    "adhoc_table_query",
    "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1",
)
def adhoc_table_query(spark, sf):
    return catalog.query_table(
        R.table(spark, sf, "orders"),
        sql="SELECT o_orderpriority, count(*) AS n FROM tbl WHERE o_totalprice > 250000 GROUP BY 1",
    )


@query(
    "adhoc_table_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000",
)
def adhoc_table_filter(spark, sf):
    return catalog.query_path(
        spark,
        f"{sf}/orders.parquet",
        where="o_orderpriority = '1-URGENT' AND o_totalprice > 400000",
        columns=["o_orderkey", "o_totalprice"],
        limit=None,
    )


@query(
    "calendar_volume",
    with_tables(
        """SELECT CAST(d.day AS VARCHAR) AS day, COUNT(o.order_id) AS orders
FROM (SELECT CAST(unnest(range(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN orders_v o ON o.order_date = d.day GROUP BY 1""",
        "orders_v",
    ),
)
def calendar_volume(spark, sf):
    per_day = R.orders_v(spark, sf).groupBy(F.col("order_date").alias("day")).agg(
        F.count("*").alias("orders")
    )
    days = date_series(spark, "1995-01-01", "2001-08-01")
    return days.join(per_day, "day", "left").withColumn(
        "orders", F.coalesce(F.col("orders"), F.lit(0))
    )


@query(
    "order_date_keys",
    with_tables(
        """SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS BIGINT) * 1000000 + order_id AS order_key,
  CAST(order_date + INTERVAL 15 DAY AS VARCHAR)[1:10] AS settles_on
FROM orders_v""",
        "orders_v",
    ),
)
def order_date_keys(spark, sf):
    return R.orders_v(spark, sf).select(
        "order_id",
        C.date_key("order_date", "order_id").alias("order_key"),
        C.settlement_date("order_date").alias("settles_on"),
    )


@query(
    "order_json_rows",
    """SELECT '{"order_id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS doc FROM orders""",
)
def order_json_rows(spark, sf):
    rows = R.orders_v(spark, sf).withColumnRenamed("order_status", "status")
    return rows.select(C.json_row("order_id", "status").alias("doc"))


@query(
    "event_property_values",
    """SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k_sum
FROM events GROUP BY 1""",
)
def event_property_values(spark, sf):
    parsed = R.table(spark, sf, "events").withColumn("doc", F.from_json("props", "k bigint"))
    return parsed.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("doc.k").alias("k_sum")
    )


@query(
    "scalar_functions",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(trim('  ' || c_name || ' ')) AS low,
  substr(c_name, 1, 8) AS head, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded,
  'cust_' || c_custkey AS tag, md5(c_name) AS digest, sha256(c_name) AS hashed,
  abs(c_acctbal) AS magnitude, CAST(floor(c_acctbal) AS BIGINT) AS whole,
  least(c_acctbal, 1000.0) AS low_end, greatest(c_acctbal, 1000.0) AS high_end,
  coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment,
  (['bronze', 'silver', 'gold', 'platinum'])[CAST(c_nationkey % 4 AS INTEGER) + 1] AS pick,
  (c_nationkey, c_mktsegment) <> (3, 'MACHINERY') AS row_differs
FROM customer""",
)
def scalar_functions(spark, sf):
    name, balance = F.col("c_name"), F.col("c_acctbal")
    picks = F.array(*[F.lit(v) for v in ("bronze", "silver", "gold", "platinum")])
    return R.table(spark, sf, "customer").select(
        "c_custkey",
        F.upper("c_mktsegment").alias("up"),
        F.lower(F.trim(F.concat(F.lit("  "), name, F.lit(" ")))).alias("low"),
        F.substring(name, 1, 8).alias("head"),
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"),
        F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("tag"),
        F.md5(name).alias("digest"),
        F.sha2(name, 256).alias("hashed"),
        F.abs(balance).alias("magnitude"),
        F.floor(balance).alias("whole"),
        F.least(balance, F.lit(1000.0)).alias("low_end"),
        F.greatest(balance, F.lit(1000.0)).alias("high_end"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("segment"),
        F.element_at(picks, F.pmod("c_nationkey", F.lit(4)) + 1).alias("pick"),
        (~C.same([F.col("c_nationkey"), F.col("c_mktsegment")], [F.lit(3), F.lit("MACHINERY")])).alias(
            "row_differs"
        ),
    )


@query(
    "time_functions",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
  strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS later,
  CAST(CAST(ts - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS day_before
FROM events""",
)
def time_functions(spark, sf):
    ts = F.col("ts")
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return R.table(spark, sf, "events").select(
        "event_id",
        F.to_date(ts).alias("day"),
        epoch.alias("seconds"),
        F.date_format(ts + F.make_interval(secs=F.lit(90)), "yyyy-MM-dd HH:mm:ss").alias("later"),
        F.date_sub(F.to_date(ts), 1).alias("day_before"),
    )


@query(
    "ranked_orders",
    with_tables("SELECT order_id, CAST(amount AS DOUBLE) AS amount, row_number() OVER (ORDER BY amount DESC, order_id) AS rank FROM orders_v", "orders_v"),
)
def ranked_orders(spark, sf):
    """The place of every order by amount, without one task for all."""
    orders = R.orders_v(spark, sf).select("order_id", "amount")
    return numbering.number_in_order(orders, [F.desc("amount"), "order_id"])


@query(
    "sampled_customers",
    """SELECT c_custkey AS customer_id, draw < 0.05 AS in_small FROM (
  SELECT c_custkey, CAST(('0x' || substr(md5('7|' || c_custkey), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS draw FROM customer) WHERE draw < 0.2""",
)
def sampled_customers(spark, sf):
    """A fifth of the customers by a seeded draw, and whether a twentieth would hold them too."""
    customers = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    drawn = numbering.sample_by_key(customers, ["customer_id"], 0.2, seed=7)
    return drawn.withColumn("in_small", numbering.draw(["customer_id"], 7) < 0.05)
