"""Finance, delivery, customer and product marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayslice.functions import columns as C
from dayslice.operators.windows import end_of_day_stock
from dayslice.plans import customers, delivery, inventory, revenue

from . import recipes as R
from .recipes import with_tables
from .registry import query

_RATE = "CASE WHEN {d} > 0 THEN floor({n}::DOUBLE / {d} * 10000 + 0.5) / 10000 ELSE 0.0 END"


def rate(n: str, d: str) -> str:
    return _RATE.format(n=n, d=d)


@query(
    "direct_revenue",
    with_tables(
        """SELECT CAST(order_date AS VARCHAR) AS order_date, COUNT(*) FILTER (WHERE discount_amount <= subtotal) AS orders,
  CAST(SUM(CASE WHEN discount_amount <= subtotal THEN total_amount ELSE 0 END) AS DOUBLE) AS revenue,
  COUNT(*) FILTER (WHERE discount_amount > subtotal) AS excluded_orders,
  COUNT(*) FILTER (WHERE shipping_fee = 0 AND voucher_code IS NULL) AS zero_shipping_orders
FROM shop_orders GROUP BY order_date""",
        "shop_orders",
    ),
)
def direct_revenue(spark, sf):
    return revenue.direct_revenue(R.shop_orders(spark, sf))


_NET = "CAST(floor(CAST(sale_price * quantity_sold AS DECIMAL(18,0)) * (1 - commission_rate)) AS BIGINT)"


@query(
    "marketplace_revenue",
    with_tables(
        f"""SELECT CAST(order_date AS VARCHAR) AS order_date, partner, COUNT(*) AS sales,
  CAST(SUM(sale_price * quantity_sold) AS BIGINT) AS gross_revenue, CAST(SUM({_NET}) AS BIGINT) AS net_revenue,
  CAST(SUM(sale_price * quantity_sold) - SUM({_NET}) AS BIGINT) AS commission_cost,
  COUNT(*) FILTER (WHERE net_revenue <> {_NET}) AS mismatched_rows
FROM market_sales m GROUP BY m.order_date, partner""",
        "market_sales",
    ),
)
def marketplace_revenue(spark, sf):
    return revenue.marketplace_revenue(R.market_sales(spark, sf))


_CHANNEL = f"""chan AS (
SELECT order_date, 'direct' AS channel, 'own' AS partner,
  SUM(CASE WHEN discount_amount <= subtotal THEN total_amount ELSE 0 END) AS revenue FROM shop_orders GROUP BY 1
UNION ALL SELECT order_date, 'marketplace', partner, SUM({_NET}) FROM market_sales GROUP BY order_date, partner)"""


def _by_channel(spark, sf):
    return revenue.revenue_by_channel(
        revenue.direct_revenue(R.shop_orders(spark, sf)),
        revenue.marketplace_revenue(R.market_sales(spark, sf)),
    )


@query(
    "revenue_by_channel",
    with_tables(
        f"""WITH {_CHANNEL} SELECT CAST(order_date AS VARCHAR) AS order_date, channel, partner,
  CAST(revenue AS DOUBLE) AS revenue FROM chan""",
        "shop_orders", "market_sales",
    ),
)
def revenue_by_channel(spark, sf):
    return _by_channel(spark, sf)


@query(
    "channel_totals",
    with_tables(
        f"""WITH {_CHANNEL} SELECT CASE WHEN GROUPING(channel) = 1 THEN 'ALL' ELSE channel END AS channel,
  CASE WHEN GROUPING(partner) = 1 THEN 'ALL' ELSE partner END AS partner, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM chan GROUP BY ROLLUP (channel, partner)""",
        "shop_orders", "market_sales",
    ),
)
def channel_totals(spark, sf):
    return revenue.channel_totals(_by_channel(spark, sf))


def _spend_sql(period: str) -> str:
    return with_tables(
        f"""SELECT CAST(period AS VARCHAR) AS period, COUNT(*) AS customers,
  CAST(SUM(spend) AS DOUBLE) / COUNT(*) AS avg_spend
FROM (SELECT {period} AS period, customer_id, SUM(total_amount) AS spend FROM shop_orders GROUP BY 1, 2) GROUP BY 1""",
        "shop_orders",
    )


@query("avg_customer_spend_daily", _spend_sql("order_date"))
def avg_customer_spend_daily(spark, sf):
    return revenue.avg_customer_spend(R.shop_orders(spark, sf), "day")


@query("avg_customer_spend_monthly", _spend_sql("CAST(date_trunc('month', order_date) AS DATE)"))
def avg_customer_spend_monthly(spark, sf):
    return revenue.avg_customer_spend(R.shop_orders(spark, sf), "month")


@query(
    "discount_impact",
    with_tables(
        """SELECT COALESCE(v.campaign_id, 'none') AS campaign_id, COUNT(*) AS orders,
  CAST(SUM(subtotal) AS DOUBLE) AS subtotal, CAST(SUM(discount_amount) AS DOUBLE) AS discount,
  CAST(SUM(discount_amount) AS DOUBLE) / CAST(SUM(subtotal) AS DOUBLE) AS discount_share
FROM shop_orders o LEFT JOIN vouchers_v v ON v.voucher_code = o.voucher_code GROUP BY 1""",
        "shop_orders", "vouchers_v",
    ),
)
def discount_impact(spark, sf):
    return revenue.discount_impact(R.shop_orders(spark, sf), R.vouchers_v(spark, sf))


_REFUND = "(SELECT order_id, SUM(refund_amount) AS refunded FROM returns_v WHERE status = 'refunded' GROUP BY 1)"


@query(
    "net_after_refund",
    with_tables(
        f"""SELECT o.order_id, CAST(o.order_date AS VARCHAR) AS order_date, CAST(o.total_amount AS DOUBLE) AS total_amount,
  CAST(COALESCE(r.refunded, 0) AS DOUBLE) AS refunded,
  CAST(o.total_amount - COALESCE(r.refunded, 0) AS DOUBLE) AS net_amount
FROM shop_orders o LEFT JOIN {_REFUND} r ON r.order_id = o.order_id""",
        "shop_orders", "returns_v",
    ),
)
def net_after_refund(spark, sf):
    return revenue.net_after_refund(R.shop_orders(spark, sf), R.returns_v(spark, sf))


@query(
    "daily_net_revenue",
    with_tables(
        f"""SELECT CAST(o.order_date AS VARCHAR) AS order_date, CAST(SUM(o.total_amount) AS DOUBLE) AS gross,
  CAST(SUM(COALESCE(r.refunded, 0)) AS DOUBLE) AS refunded,
  CAST(SUM(o.total_amount - COALESCE(r.refunded, 0)) AS DOUBLE) AS net
FROM shop_orders o LEFT JOIN {_REFUND} r ON r.order_id = o.order_id GROUP BY o.order_date""",
        "shop_orders", "returns_v",
    ),
)
def daily_net_revenue(spark, sf):
    return revenue.daily_net_revenue(R.shop_orders(spark, sf), R.returns_v(spark, sf))


@query(
    "earned_vs_received",
    with_tables(
        """SELECT CAST(month AS VARCHAR) AS month, CAST(SUM(earned) AS BIGINT) AS earned, CAST(SUM(received) AS BIGINT) AS received FROM (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, net_revenue AS earned, 0 AS received FROM market_sales
  UNION ALL SELECT CAST(date_trunc('month', settlement_date) AS DATE), 0, net_revenue FROM market_sales) GROUP BY 1""",
        "market_sales",
    ),
)
def earned_vs_received(spark, sf):
    return revenue.earned_vs_received(R.market_sales(spark, sf))


@query(
    "top_customers",
    with_tables(
        """SELECT customer_id, CAST(SUM(total_amount) AS DOUBLE) AS spend, COUNT(*) AS orders FROM shop_orders
GROUP BY 1 ORDER BY SUM(total_amount) DESC, customer_id LIMIT 10""",
        "shop_orders",
    ),
)
def top_customers(spark, sf):
    return revenue.top_customers(R.shop_orders(spark, sf))


@query(
    "delivery_rate",
    with_tables(
        f"""SELECT *, {rate('delivered', 'orders')} AS success_rate, {rate('failed', 'orders')} AS failure_rate FROM (
  SELECT CAST(o.order_date AS VARCHAR) AS order_date, COALESCE(s.carrier, 'unassigned') AS carrier, COUNT(*) AS orders,
    COUNT(*) FILTER (WHERE s.status = 'delivered') AS delivered, COUNT(*) FILTER (WHERE s.status = 'failed') AS failed
  FROM orders_v o LEFT JOIN shipments_v s ON s.order_id = o.order_id GROUP BY 1, 2)""",
        "orders_v", "shipments_v",
    ),
)
def delivery_rate(spark, sf):
    return delivery.delivery_rate(R.orders_v(spark, sf), R.shipments_v(spark, sf))


@query(
    "delivery_time",
    with_tables(
        """SELECT carrier, COUNT(*) AS delivered,
  CAST(SUM(CAST(epoch(delivered_at) - epoch(shipped_at) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 3600) AS avg_hours
FROM shipments_v WHERE status = 'delivered' GROUP BY 1""",
        "shipments_v",
    ),
)
def delivery_time(spark, sf):
    return delivery.delivery_time(R.shipments_v(spark, sf))


@query(
    "redelivery_rate",
    with_tables(
        f"""SELECT *, {rate('redelivered', 'shipments')} AS redelivery_rate FROM (SELECT carrier, COUNT(*) AS shipments,
  COUNT(*) FILTER (WHERE delivery_attempts > 1) AS redelivered FROM shipments_v GROUP BY 1)""",
        "shipments_v",
    ),
)
def redelivery_rate(spark, sf):
    return delivery.redelivery_rate(R.shipments_v(spark, sf))


@query(
    "failure_reasons",
    with_tables(
        f"""SELECT failure_reason, failures, {rate('failures', '(SUM(failures) OVER ())')} AS share
FROM (SELECT failure_reason, COUNT(*) AS failures FROM shipments_v WHERE status = 'failed' GROUP BY 1)""",
        "shipments_v",
    ),
)
def failure_reasons(spark, sf):
    return delivery.failure_reasons(R.shipments_v(spark, sf))


@query(
    "province_failures",
    with_tables(
        f"""SELECT *, {rate('failures', 'shipments')} AS failure_rate FROM (SELECT recipient_province, COUNT(*) AS shipments,
  COUNT(*) FILTER (WHERE status = 'failed') AS failures FROM shipments_v GROUP BY 1)""",
        "shipments_v",
    ),
)
def province_failures(spark, sf):
    return delivery.province_failures(R.shipments_v(spark, sf))


@query(
    "return_rate",
    with_tables(
        f"""SELECT *, {rate('returned', 'orders')} AS return_rate FROM (
  SELECT t.category, o.channel, COUNT(*) AS orders,
    COUNT(*) FILTER (WHERE t.order_id IN (SELECT order_id FROM returns_v)) AS returned
  FROM (SELECT DISTINCT i.order_id, p.category FROM items_v i JOIN products_v p ON p.product_id = i.product_id) t
  JOIN shop_orders o ON o.order_id = t.order_id GROUP BY 1, 2)""",
        "items_v", "products_v", "shop_orders", "returns_v",
    ),
)
def return_rate(spark, sf):
    return delivery.return_rate(
        R.shop_orders(spark, sf), R.items_v(spark, sf), R.returns_v(spark, sf), R.products_v(spark, sf)
    )


@query(
    "tier_spend",
    with_tables(
        """SELECT loyalty_tier, CASE WHEN spend < 500000 THEN 'low' WHEN spend < 1500000 THEN 'mid' ELSE 'high' END AS spend_band,
  COUNT(*) AS customers, CAST(SUM(spend) AS DOUBLE) AS total_spend
FROM (SELECT c.customer_id, c.segment AS loyalty_tier, COALESCE(SUM(o.total_amount), 0) AS spend
  FROM customers_v c LEFT JOIN shop_orders o ON o.customer_id = c.customer_id GROUP BY 1, 2) GROUP BY 1, 2""",
        "customers_v", "shop_orders",
    ),
)
def tier_spend(spark, sf):
    people = R.customers_v(spark, sf).withColumnRenamed("segment", "loyalty_tier")
    return customers.tier_spend(people, R.shop_orders(spark, sf), (500_000, 1_500_000), ("low", "mid", "high"))


@query(
    "campaign_effect",
    with_tables(
        """SELECT v.campaign_id, COUNT(o.order_id) AS uses, CAST(COALESCE(SUM(i.value), 0) AS DOUBLE) AS revenue,
  CAST(COALESCE(SUM(o.discount_amount), 0) AS DOUBLE) AS discount_cost
FROM vouchers_v v LEFT JOIN shop_orders o ON o.voucher_code = v.voucher_code
LEFT JOIN (SELECT order_id, SUM(price) AS value FROM items_v GROUP BY 1) i ON i.order_id = o.order_id GROUP BY 1""",
        "vouchers_v", "shop_orders", "items_v",
    ),
)
def campaign_effect(spark, sf):
    items = R.items_v(spark, sf).withColumnRenamed("price", "total_price")
    return customers.campaign_effect(R.vouchers_v(spark, sf), R.shop_orders(spark, sf), items)


@query(
    "customer_lifecycle",
    with_tables(
        f"""SELECT customer_id, CAST(f AS VARCHAR) AS first_order, CAST(l AS VARCHAR) AS last_order, orders,
  {rate('(l - f)', '(orders - 1)')} AS avg_gap_days, CAST(DATE '2001-08-01' - l AS BIGINT) AS idle_days,
  CASE WHEN DATE '2001-08-01' - l > 180 THEN 'inactive' WHEN orders > 1 THEN 'repeat' ELSE 'new' END AS state
FROM (SELECT customer_id, MIN(order_date) AS f, MAX(order_date) AS l, COUNT(*) AS orders FROM orders_v
  WHERE order_date <= DATE '2001-08-01' GROUP BY 1)""",
        "orders_v",
    ),
)
def customer_lifecycle(spark, sf):
    return customers.lifecycle(R.orders_v(spark, sf), "2001-08-01", 180)


@query(
    "repeat_rate",
    with_tables(
        f"""SELECT *, {rate('repeaters', 'customers')} AS repeat_rate FROM (
  SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE nxt - order_date <= 30) AS repeaters FROM (
    SELECT *, row_number() OVER w AS rn, lead(order_date) OVER w AS nxt FROM orders_v
    WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)) WHERE rn = 1)""",
        "orders_v",
    ),
)
def repeat_rate(spark, sf):
    return customers.repeat_rate(R.orders_v(spark, sf))


@query(
    "product_ratings",
    with_tables(
        """SELECT p.category, o.channel, COUNT(*) AS reviews, COUNT(*) FILTER (WHERE i.line_status = 'O') AS with_text,
  CAST(SUM(1 + CAST(floor(i.tax * 50) AS BIGINT)) AS DOUBLE) / COUNT(*) AS avg_rating
FROM items_v i JOIN products_v p ON p.product_id = i.product_id JOIN shop_orders o ON o.order_id = i.order_id GROUP BY 1, 2""",
        "items_v", "products_v", "shop_orders",
    ),
)
def product_ratings(spark, sf):
    reviews = R.items_v(spark, sf).select(
        "order_id",
        "product_id",
        (F.floor(F.col("tax") * 50).cast("bigint") + 1).alias("rating"),
        F.when(F.col("line_status") == "O", F.lit("text")).alias("comment"),
    )
    return customers.ratings(reviews, R.products_v(spark, sf), R.shop_orders(spark, sf))


def _time_of_day(day: str):
    """A time on the day, another one for each line."""
    seconds = F.pmod(F.col("order_id") * 7919, F.lit(86_400)).cast("int")
    return F.timestamp_seconds(F.unix_timestamp(F.col(day).cast("timestamp")) + seconds)


@query(
    "eod_stock",
    with_tables(
        """WITH s AS (SELECT brand, SUM(stock_qty) AS stock FROM products_v GROUP BY 1),
m AS (SELECT p.brand, i.ship_date AS day, SUM(CASE WHEN return_flag = 'R' THEN quantity ELSE -quantity END) AS qty
  FROM items_v i JOIN products_v p ON p.product_id = i.product_id GROUP BY 1, 2),
g AS (SELECT brand, stock, CAST(unnest(range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT CAST(g.day AS VARCHAR) AS snapshot_date, g.brand AS product_id, CAST(g.stock - COALESCE(SUM(m.qty), 0) AS BIGINT) AS stock_qty
FROM g LEFT JOIN m ON m.brand = g.brand AND m.day > g.day GROUP BY g.day, g.brand, g.stock""",
        "products_v", "items_v",
    ),
)
def eod_stock(spark, sf):
    """Stock per brand on every day of the data."""
    products = R.products_v(spark, sf)
    stock = products.groupBy(F.col("brand").alias("product_id")).agg(F.sum("stock_qty").alias("stock_qty"))
    change = F.when(F.col("return_flag") == "R", F.col("quantity")).otherwise(-F.col("quantity"))
    moves = R.items_v(spark, sf).join(products.select("product_id", "brand"), "product_id").select(
        F.col("brand").alias("product_id"), change.alias("qty_change"), _time_of_day("ship_date").alias("created_at")
    )
    return end_of_day_stock(stock, moves, "1995-01-01", "2001-12-31")


@query(
    "loss_making",
    with_tables(
        """SELECT * FROM (SELECT p.product_id, CAST(cost_price AS DOUBLE) AS cost_price, CAST(base_price AS DOUBLE) AS base_price,
  CAST(m.lowest AS DOUBLE) AS min_sale_price, cost_price > base_price AS is_loss_making,
  COALESCE(cost_price > m.lowest, FALSE) AS is_sold_below_cost
FROM products_v p LEFT JOIN (SELECT product_id, MIN(CAST(floor(price) AS DECIMAL(18,2))) AS lowest FROM items_v WHERE quantity > 0 GROUP BY 1) m
  ON m.product_id = p.product_id) WHERE is_loss_making OR is_sold_below_cost""",
        "products_v", "items_v",
    ),
)
def loss_making(spark, sf):
    items = R.items_v(spark, sf).withColumn("sale_price", F.floor("price"))
    return inventory.loss_making(R.products_v(spark, sf), items)


def _sell_sql(days: str, n: int) -> str:
    return with_tables(
        f"""SELECT product_id, stock_qty, CAST(units AS DOUBLE) / {n} AS avg_daily_units,
  CASE WHEN units > 0 THEN stock_qty / (CAST(units AS DOUBLE) / {n}) END AS days_to_stockout
FROM (SELECT p.product_id, p.stock_qty, COALESCE(SUM(i.quantity), 0) AS units FROM products_v p
  LEFT JOIN items_v i ON i.product_id = p.product_id AND {days} GROUP BY 1, 2)""",
        "products_v", "items_v",
    )


def _sales(spark, sf):
    return R.items_v(spark, sf).select(
        "product_id", F.col("ship_date").alias("sale_date"), F.col("quantity").alias("units")
    )


@query("sell_through", _sell_sql("i.ship_date BETWEEN DATE '2001-06-24' AND DATE '2001-06-30'", 7))
def sell_through(spark, sf):
    return inventory.sell_through(R.products_v(spark, sf), _sales(spark, sf), "2001-06-30")


@query(
    "sell_through_without_spikes",
    _sell_sql(
        "i.ship_date BETWEEN DATE '2001-06-24' AND DATE '2001-06-30' AND i.ship_date <> DATE '2001-06-26'", 6
    ),
)
def sell_through_without_spikes(spark, sf):
    return inventory.sell_through(
        R.products_v(spark, sf), _sales(spark, sf), "2001-06-30", exclude=["2001-06-26"]
    )


@query(
    "daily_volume",
    with_tables(
        """SELECT CAST(order_date AS VARCHAR) AS order_date, orders, orders / m AS ratio, orders / m >= 2.0 AS is_spike
FROM (SELECT order_date, COUNT(*) AS orders FROM orders_v GROUP BY 1) d,
  (SELECT CAST(median(n) AS DOUBLE) AS m FROM (SELECT COUNT(*) AS n FROM orders_v GROUP BY order_date))""",
        "orders_v",
    ),
)
def daily_volume(spark, sf):
    return inventory.daily_volume(R.orders_v(spark, sf))
