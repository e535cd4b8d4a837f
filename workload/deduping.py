"""One row per key, ranks, numbering, and calendar-ordered calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayslice.operators import dedup, numbering, windows
from dayslice.operators.scd2 import scd2_from_snapshots
from dayslice.plans import inventory, orders as order_plans

from . import recipes as R
from .recipes import with_tables
from .registry import query

_ITEM_COLS = """order_id, line_no, product_id, seller_id, quantity, CAST(price AS DOUBLE) AS price,
  CAST(discount AS DOUBLE) AS discount, CAST(tax AS DOUBLE) AS tax, return_flag, line_status,
  CAST(ship_date AS VARCHAR) AS ship_date"""
_ITEM_TIES = "product_id, seller_id, quantity, price, discount, tax, return_flag, line_status"


@query("dedup_keep_first", with_tables(f"SELECT {_ITEM_COLS} FROM deduped_items", "deduped_items"))
def dedup_keep_first(spark, sf):
    return R.deduped_items(spark, sf)


@query(
    "dedup_keep_latest",
    with_tables(
        f"""SELECT {_ITEM_COLS} FROM items_v QUALIFY row_number() OVER (PARTITION BY order_id, line_no
  ORDER BY ship_date DESC, {_ITEM_TIES}) = 1""",
        "items_v",
    ),
)
def dedup_keep_latest(spark, sf):
    return dedup.keep_latest(R.items_v(spark, sf), ["order_id", "line_no"], ["ship_date"])


@query(
    "validate_snapshot",
    with_tables(
        """SELECT customer_id, tier, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM raw_snapshots
WHERE tier IN ('bronze', 'silver', 'gold')
QUALIFY row_number() OVER (PARTITION BY customer_id, snapshot_date ORDER BY tier) = 1""",
        "raw_snapshots",
    ),
)
def validate_snapshot(spark, sf):
    return dedup.validate_snapshot(
        R.raw_snapshots(spark, sf), ["customer_id"], "tier", ["bronze", "silver", "gold"]
    )


@query(
    "drop_duplicate_customers",
    "SELECT COUNT(DISTINCT o_custkey) AS customers FROM orders",
)
def drop_duplicate_customers(spark, sf):
    distinct = R.orders_v(spark, sf).dropDuplicates(["customer_id"])
    return distinct.agg(F.count("*").alias("customers"))


@query(
    "top_order_per_customer",
    with_tables(
        """SELECT o.order_id AS id, o.customer_id, CAST(o.amount AS DOUBLE) AS amount, s.tier FROM (
  SELECT *, rank() OVER (PARTITION BY customer_id ORDER BY amount DESC) AS rk FROM orders_v) o
JOIN (SELECT customer_id, tier FROM snapshots_v
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_date DESC) = 1) s
  ON s.customer_id = o.customer_id
WHERE o.rk = 1""",
        "orders_v", "snapshots_v",
    ),
)
def top_order_per_customer(spark, sf):
    history = scd2_from_snapshots(R.snapshots_v(spark, sf), ["customer_id"], ["tier"])
    rows = R.orders_v(spark, sf).select(F.col("order_id").alias("id"), "customer_id", "amount")
    joined = order_plans.top_order_per_customer(rows, history)
    return joined.select("id", "customer_id", "amount", "tier")


@query(
    "top_order_no_ties",
    with_tables(
        """SELECT order_id AS id, customer_id, CAST(amount AS DOUBLE) AS amount FROM orders_v
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY amount DESC, order_id) = 1""",
        "orders_v",
    ),
)
def top_order_no_ties(spark, sf):
    rows = R.orders_v(spark, sf).select(F.col("order_id").alias("id"), "customer_id", "amount")
    best = dedup.top_per_group(rows, ["customer_id"], [F.col("amount").desc(), F.col("id").asc()], 1)
    return best.drop("rank")


@query(
    "best_slow_sellers",
    with_tables(
        """WITH u AS (SELECT p.product_id, p.category, CAST(COALESCE(SUM(i.quantity), 0) AS BIGINT) AS units
  FROM products_v p LEFT JOIN items_v i ON i.product_id = p.product_id AND i.quantity > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY units DESC, product_id) AS best,
  row_number() OVER (PARTITION BY category ORDER BY units, product_id) AS slow FROM u)
SELECT product_id, category, units, best AS rank, 'best' AS side FROM r WHERE best <= 5
UNION ALL SELECT product_id, category, units, slow, 'slow' FROM r WHERE slow <= 5""",
        "products_v", "items_v",
    ),
)
def best_slow_sellers(spark, sf):
    return inventory.best_slow_sellers(R.items_v(spark, sf), R.products_v(spark, sf))


@query(
    "surrogate_numbers",
    with_tables(
        """SELECT order_id, row_number() OVER (ORDER BY substr(md5(CAST(order_id AS VARCHAR)), 1, 4), order_id) AS order_no
FROM orders_v""",
        "orders_v",
    ),
)
def surrogate_numbers(spark, sf):
    return numbering.number_rows(R.orders_v(spark, sf).select("order_id"), ["order_id"], "order_no")


@query(
    "batch_ids",
    with_tables(
        """SELECT (pos - 1) // 50 AS batch_id, COUNT(*) AS n_ids, MIN(order_id) AS first_id, MAX(order_id) AS last_id
FROM (SELECT order_id, row_number() OVER (ORDER BY substr(md5(CAST(order_id AS VARCHAR)), 1, 4), order_id) AS pos
      FROM orders_v) GROUP BY 1""",
        "orders_v",
    ),
)
def batch_ids(spark, sf):
    batches = numbering.batch_ids(R.orders_v(spark, sf), "order_id", 50)
    return batches.select(
        "batch_id",
        F.size("ids").alias("n_ids"),
        F.array_min("ids").alias("first_id"),
        F.array_max("ids").alias("last_id"),
    )


@query(
    "avg_daily_units",
    with_tables(
        """WITH d AS (SELECT p.brand, i.ship_date, SUM(i.quantity) AS units
  FROM items_v i JOIN products_v p ON p.product_id = i.product_id GROUP BY 1, 2),
g AS (SELECT brand, CAST(unnest(range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT DISTINCT brand FROM d))
SELECT g.brand, CAST(g.day AS VARCHAR) AS day, CAST(COALESCE(d.units, 0) AS BIGINT) AS units,
  CAST(SUM(COALESCE(d.units, 0)) OVER (PARTITION BY g.brand ORDER BY g.day
    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / 7 AS avg_units
FROM g LEFT JOIN d ON d.brand = g.brand AND d.ship_date = g.day""",
        "items_v", "products_v",
    ),
)
def avg_daily_units(spark, sf):
    brands = R.products_v(spark, sf).select("product_id", "brand")
    sales = R.items_v(spark, sf).join(brands, "product_id")
    return windows.avg_daily_units(
        sales, "brand", "ship_date", "quantity", "1995-01-01", "2001-12-31", entities=brands
    )


@query(
    "avg_daily_units_from_mid_data",
    with_tables(
        """WITH d AS (SELECT p.brand, i.ship_date, SUM(i.quantity) AS units
  FROM items_v i JOIN products_v p ON p.product_id = i.product_id GROUP BY 1, 2),
g AS (SELECT brand, CAST(unnest(range(DATE '1998-03-10', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT DISTINCT brand FROM products_v))
SELECT g.brand, CAST(g.day AS VARCHAR) AS day,
  CAST(COALESCE(SUM(d.units) FILTER (WHERE d.ship_date = g.day), 0) AS BIGINT) AS units,
  CAST(COALESCE(SUM(d.units), 0) AS DOUBLE) / 7 AS avg_units
FROM g LEFT JOIN d ON d.brand = g.brand AND d.ship_date BETWEEN g.day - INTERVAL 6 DAY AND g.day GROUP BY 1, 2""",
        "items_v", "products_v",
    ),
)
def avg_daily_units_from_mid_data(spark, sf):
    """The report starts inside the data: its first days average sales from before it."""
    brands = R.products_v(spark, sf).select("product_id", "brand")
    sales = R.items_v(spark, sf).join(brands, "product_id")
    return windows.avg_daily_units(
        sales, "brand", "ship_date", "quantity", "1998-03-10", "2001-12-31", entities=brands
    )


@query(
    "order_sequence",
    with_tables(
        """SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date,
  row_number() OVER w AS order_no,
  CAST(order_date - lag(order_date) OVER w AS BIGINT) AS gap_days, row_number() OVER w = 1 AS is_first
FROM orders_v WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)""",
        "orders_v",
    ),
)
def order_sequence(spark, sf):
    rows = R.orders_v(spark, sf).select("order_id", "customer_id", "order_date")
    return windows.order_sequence(rows, "customer_id", "order_date", ["order_id"])


@query(
    "order_sequence_split",
    with_tables(
        """SELECT order_id, region_id, CAST(order_date AS VARCHAR) AS order_date, row_number() OVER w AS order_no,
  CAST(order_date - lag(order_date) OVER w AS BIGINT) AS gap_days, row_number() OVER w = 1 AS is_first
FROM (SELECT order_id, customer_id % 2 AS region_id, CAST(date_trunc('quarter', order_date) AS DATE) AS order_date FROM orders_v)
WINDOW w AS (PARTITION BY region_id ORDER BY order_date, order_id)""",
        "orders_v",
    ),
)
def order_sequence_split(spark, sf):
    """Two entities and a day for each quarter: every (entity, day) is hot and cut into ranges of the order id."""
    day = F.trunc("order_date", "QUARTER").alias("order_date")
    rows = R.orders_v(spark, sf).select("order_id", (F.col("customer_id") % 2).alias("region_id"), day)
    return windows.order_sequence_split(rows, "region_id", "order_date", ["order_id"], hot_rows=100, ranges=8)


@query(
    "day_over_day",
    with_tables(
        """WITH d AS (SELECT order_date AS day, COUNT(*) AS n_rows FROM orders_v GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, d.n_rows, p.n_rows AS prior_rows,
  CAST(d.n_rows - p.n_rows AS DOUBLE) / p.n_rows AS change
FROM d LEFT JOIN d p ON p.day = CAST(d.day - INTERVAL 1 DAY AS DATE)""",
        "orders_v",
    ),
)
def day_over_day(spark, sf):
    return windows.dod_change(R.orders_v(spark, sf), "order_date")
