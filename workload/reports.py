"""Order, item and ad roll-ups, and joins with a cost of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayslice.functions import columns as C
from dayslice.operators import joins
from dayslice.operators.reconcile import scalars
from dayslice.operators.shape import top_k
from dayslice.plans import ads, inventory, orders as order_plans
from dayslice.session import new_dir
from dayslice.sources.writers import write_slices

from . import recipes as R
from .recipes import with_tables
from .registry import query


@query(
    "fact_ad_events",
    with_tables(
        """SELECT event_id, ad_id, campaign_id, user_id, event_type,
  strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts, CAST(event_date AS VARCHAR) AS event_date FROM fact_ads""",
        "fact_ads",
    ),
)
def fact_ad_events(spark, sf):
    fact = ads.fact_ad_events(R.ad_raw(spark, sf))
    return fact.withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "ad_daily",
    with_tables(
        """SELECT CAST(event_date AS VARCHAR) AS event_date, ad_id, campaign_id, impressions, clicks, unique_users, ctr
FROM agg_ads""",
        "agg_ads",
    ),
)
def ad_daily(spark, sf):
    return ads.ad_daily(ads.fact_ad_events(R.ad_raw(spark, sf)))


@query(
    "ad_daily_approx",
    with_tables(
        """SELECT CAST(event_date AS VARCHAR) AS event_date, ad_id, impressions, clicks, ctr, TRUE AS reach_is_close
FROM agg_ads""",
        "agg_ads",
    ),
)
def ad_daily_approx(spark, sf):
    """The sketched reach next to the exact one: everywhere within 5 %, or one user."""
    fact = ads.fact_ad_events(R.ad_raw(spark, sf))
    keys = ["event_date", "ad_id", "campaign_id"]
    exact = ads.ad_daily(fact).select(*keys, F.col("unique_users").alias("exact"))
    off = F.abs(F.col("unique_users") - F.col("exact"))
    return ads.ad_daily(fact, approx=True).join(exact, keys).select(
        "event_date", "ad_id", "impressions", "clicks", "ctr",
        (off <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)).alias("reach_is_close"),
    )


@query(
    "weekly_reach",
    with_tables(
        """SELECT ad_id, CAST(week AS VARCHAR) AS week, COUNT(DISTINCT user_id) AS exact_reach, COUNT(DISTINCT event_date) AS days, TRUE AS reach_is_close
FROM (SELECT *, CAST(date_trunc('week', event_date) AS DATE) AS week FROM fact_ads) GROUP BY 1, 2""",
        "fact_ads",
    ),
)
def weekly_reach(spark, sf):
    """Reach of each ad and week from stored daily sketches, beside the exact one: within 2.5 % (three standard errors), or one user."""
    path = new_dir(spark, "sketches")
    fact = ads.fact_ad_events(R.ad_raw(spark, sf))
    write_slices(ads.reach_sketches(fact), path, "event_date")
    stored = spark.read.parquet(path).withColumn("week", F.trunc("event_date", "WEEK"))
    far = ads.reach(stored, "1900-01-01", "2999-12-31", ("ad_id", "week"))
    exact = fact.withColumn("week", F.trunc("event_date", "WEEK")).groupBy("ad_id", "week").agg(F.count_distinct("user_id").alias("exact_reach"))
    off = F.abs(F.col("reach") - F.col("exact_reach"))
    return far.join(exact, ["ad_id", "week"]).select(
        "ad_id", "week", "exact_reach", "days", (off <= F.greatest(F.lit(1.0), F.col("exact_reach") * 0.025)).alias("reach_is_close")
    )


@query(
    "campaign_metrics",
    with_tables(
        """SELECT campaign, impressions, clicks, CAST(spend AS DOUBLE) AS spend_usd,
  floor(clicks::DOUBLE / impressions * 10000 + 0.5) / 10000 AS ctr
FROM (SELECT campaign, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks, SUM(cost_usd) AS spend
      FROM campaign_events GROUP BY 1)""",
        "campaign_events",
    ),
)
def campaign_metrics(spark, sf):
    return ads.campaign_metrics(R.campaign_events(spark, sf))


@query(
    "over_budget",
    with_tables(
        """SELECT CAST(date AS VARCHAR) AS date, CAST(SUM(spend_usd) AS DOUBLE) AS total_spend_usd,
  COALESCE(string_agg(campaign, ',' ORDER BY campaign) FILTER (WHERE spend_usd > 500), '') AS over_budget_campaigns,
  500.0::DOUBLE AS budget_usd
FROM campaign_days GROUP BY 1""",
        "campaign_days",
    ),
)
def over_budget(spark, sf):
    metrics = ads.campaign_metrics(R.campaign_events(spark, sf), ("date", "campaign"))
    report = ads.over_budget(metrics, 500.0)
    return report.withColumn("over_budget_campaigns", F.array_join("over_budget_campaigns", ","))


@query(
    "low_ctr",
    with_tables(
        """SELECT CAST(date AS VARCHAR) AS date,
  COALESCE(string_agg(campaign, ',' ORDER BY campaign) FILTER (WHERE ctr < 0.15), '') AS low_ctr_campaigns,
  CAST(COALESCE(SUM(spend_usd) FILTER (WHERE ctr < 0.15), 0) AS DOUBLE) AS wasted_spend_usd, 0.15::DOUBLE AS min_ctr
FROM campaign_days GROUP BY 1""",
        "campaign_days",
    ),
)
def low_ctr(spark, sf):
    metrics = ads.campaign_metrics(R.campaign_events(spark, sf), ("date", "campaign"))
    report = ads.low_ctr(metrics, 0.15)
    return report.withColumn("low_ctr_campaigns", F.array_join("low_ctr_campaigns", ","))


@query(
    "genre_daily",
    """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS dt, p_type AS genre, COUNT(*) AS play_count,
  COUNT(DISTINCT l_suppkey) AS unique_listeners,
  floor(CAST(SUM(CAST(l_quantity AS BIGINT) * 4321) AS DOUBLE) / 60000.0 * 100 + 0.5) / 100 AS minutes_played
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def genre_daily(spark, sf):
    plays = R.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("track_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_shipdate").alias("played_at"),
        (F.col("l_quantity").cast("bigint") * 4321).alias("ms_played"),
    )
    tracks = R.products_v(spark, sf).select(
        F.col("product_id").alias("track_id"), F.col("category").alias("genre")
    )
    return ads.genre_daily(plays, tracks)


@query(
    "daily_revenue",
    with_tables(
        """SELECT CAST(order_date AS VARCHAR) AS order_date, partner, COUNT(*) AS order_count,
  CAST(SUM(amount) AS DOUBLE) AS total_revenue
FROM orders_v GROUP BY order_date, partner""",
        "orders_v",
    ),
)
def daily_revenue(spark, sf):
    return order_plans.daily_revenue(R.orders_v(spark, sf))


def _categorized(spark, sf):
    """Items with their product's category."""
    category = R.products_v(spark, sf).select("product_id", F.col("category").alias("product_category"))
    return R.items_v(spark, sf).join(category, "product_id")


def _sliced_items(spark, sf):
    """Items with the order's date, the slice column that both tables share."""
    return _categorized(spark, sf).join(R.orders_v(spark, sf).select("order_id", "order_date"), "order_id")


_sliced: dict[tuple[str, str], tuple[str, str]] = {}


def sliced_tables(spark, sf):
    """Orders and categorized items on disk in slices of the order's month, as a bronze layer keeps them; written once in a session."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _sliced:
        month = F.trunc("order_date", "MM").alias("order_month")
        orders = R.orders_v(spark, sf).select("*", month)
        items = _categorized(spark, sf).join(R.orders_v(spark, sf).select("order_id", month), "order_id")
        _sliced[name] = new_dir(spark, "orders-by-month"), new_dir(spark, "items-by-month")
        for df, path in zip((orders, items), _sliced[name], strict=True):
            write_slices(df, path, "order_month")
    return tuple(spark.read.parquet(path) for path in _sliced[name])


@query(
    "state_gmv",
    with_tables(
        """SELECT c.region AS customer_state, CAST(SUM(i.price) AS DOUBLE) AS gmv
FROM items_v i JOIN orders_v o ON o.order_id = i.order_id JOIN customers_v c ON c.customer_id = o.customer_id GROUP BY 1""",
        "items_v", "orders_v", "customers_v",
    ),
)
def state_gmv(spark, sf):
    customers = R.customers_v(spark, sf).withColumnRenamed("region", "customer_state")
    return order_plans.state_gmv(R.orders_v(spark, sf), R.items_v(spark, sf), customers)


@query(
    "status_category_gmv",
    with_tables(
        """SELECT o.order_status, p.category AS product_category, CAST(SUM(i.price) AS DOUBLE) AS gmv
FROM orders_v o JOIN items_v i ON i.order_id = o.order_id JOIN products_v p ON p.product_id = i.product_id
WHERE o.order_date >= DATE '1998-01-01' GROUP BY 1, 2""",
        "orders_v", "items_v", "products_v",
    ),
)
def status_category_gmv(spark, sf):
    """On tables in month slices: the condition prunes the slices of both scans."""
    orders, items = sliced_tables(spark, sf)
    recent = F.col("order_month") >= C.day("1998-01-01")
    return order_plans.status_category_gmv(orders, items, recent, "order_month")


@query(
    "category_revenue",
    with_tables(
        """SELECT p.category AS product_category, CAST(SUM(i.price) AS DOUBLE) AS revenue, COUNT(*) AS items_sold,
  COUNT(DISTINCT CASE WHEN o.order_status = 'F' THEN o.partner END) AS coupons_used
FROM orders_v o JOIN items_v i ON i.order_id = o.order_id JOIN products_v p ON p.product_id = i.product_id
WHERE o.order_date + INTERVAL 1 DAY >= DATE '1998-01-01' AND o.order_date + INTERVAL 1 DAY < DATE '1999-01-01' GROUP BY 1""",
        "orders_v", "items_v", "products_v",
    ),
)
def category_revenue(spark, sf):
    orders = R.orders_v(spark, sf).withColumns(
        {
            "approved_at": F.date_add("order_date", 1),
            "coupon_code": F.when(F.col("order_status") == "F", F.col("partner")),
        }
    )
    items = _sliced_items(spark, sf)
    return order_plans.category_revenue(orders, items, "1998-01-01", "1999-01-01", max_lag_days=2)


@query(
    "daily_ops",
    with_tables(
        """SELECT CAST(order_date AS VARCHAR) AS order_date, order_status, COUNT(*) AS orders,
  COUNT(DISTINCT customer_id) AS customers FROM orders_v GROUP BY order_date, order_status""",
        "orders_v",
    ),
)
def daily_ops(spark, sf):
    return order_plans.daily_ops(R.orders_v(spark, sf))


@query(
    "seller_product_stats",
    with_tables(
        """SELECT i.seller_id, p.category AS product_category, i.product_id, CAST(SUM(i.price) AS DOUBLE) AS sum_price,
  COUNT(*) AS n, CAST(SUM(i.price) AS DOUBLE) / COUNT(*) AS avg_price,
  CAST(MAX(i.tax) AS DOUBLE) AS max_ship, CAST(MIN(i.tax) AS DOUBLE) AS min_ship
FROM items_v i JOIN products_v p ON p.product_id = i.product_id GROUP BY 1, 2, 3""",
        "items_v", "products_v",
    ),
)
def seller_product_stats(spark, sf):
    return order_plans.seller_product_stats(
        _categorized(spark, sf).withColumnRenamed("tax", "shipping_charges")
    )


_PAIRS = """FROM orders_v o JOIN items_v i ON i.order_id = o.order_id JOIN payments_v p ON p.order_id = o.order_id"""


@query(
    "risk_by_status",
    with_tables(
        f"""SELECT o.order_status, CAST(SUM(CASE p.payment_type WHEN 'credit_card' THEN 30 WHEN 'debit_card' THEN 10 ELSE 0 END
    + CAST(p.payment_installments AS DECIMAL(10,0)) * 2 + CAST(p.payment_value * 0.01 AS DECIMAL(18,4))) AS DOUBLE) AS total_risk_score,
  COUNT(*) AS n_pairs
{_PAIRS} GROUP BY 1""",
        "orders_v", "items_v", "payments_v",
    ),
)
def risk_by_status(spark, sf):
    return order_plans.risk_by_status(
        R.items_v(spark, sf), R.orders_v(spark, sf), R.payments_v(spark, sf)
    )


@query(
    "item_payment_pairs",
    with_tables(
        f"""SELECT p.payment_type, i.line_no, COUNT(*) AS pairs, CAST(SUM(i.quantity) AS BIGINT) AS units {_PAIRS} GROUP BY 1, 2""",
        "orders_v", "items_v", "payments_v",
    ),
)
def item_payment_pairs(spark, sf):
    pairs = order_plans.item_payment_pairs(
        R.orders_v(spark, sf).select("order_id"),
        R.items_v(spark, sf).select("order_id", "line_no", "quantity"),
        R.payments_v(spark, sf).select("order_id", "payment_type"),
    )
    return pairs.groupBy("payment_type", "line_no").agg(
        F.count("*").alias("pairs"), F.sum("quantity").alias("units")
    )


@query(
    "segment_summary",
    with_tables("SELECT segment, region, COUNT(*) AS customers FROM customers_v GROUP BY 1, 2", "customers_v"),
)
def segment_summary(spark, sf):
    return order_plans.segment_summary(R.customers_v(spark, sf))


@query(
    "busy_customers",
    with_tables(
        "SELECT customer_id, COUNT(*) AS orders FROM orders_v GROUP BY 1 HAVING COUNT(*) > 12", "orders_v"
    ),
)
def busy_customers(spark, sf):
    per_customer = R.orders_v(spark, sf).groupBy("customer_id").agg(F.count("*").alias("orders"))
    return per_customer.where("orders > 12")


@query(
    "top_ads",
    with_tables(
        """SELECT ad_id, CAST(SUM(impressions) AS BIGINT) AS impressions FROM agg_ads GROUP BY 1
ORDER BY impressions DESC, ad_id LIMIT 10""",
        "agg_ads",
    ),
)
def top_ads(spark, sf):
    daily = ads.ad_daily(ads.fact_ad_events(R.ad_raw(spark, sf)))
    per_ad = daily.groupBy("ad_id").agg(F.sum("impressions").alias("impressions"))
    return top_k(per_ad, [F.col("impressions").desc(), F.col("ad_id").asc()], 10)


@query(
    "orders_with_shipments",
    with_tables(
        """SELECT o.order_id, CAST(o.order_date AS VARCHAR) AS order_date, o.order_status, s.carrier, s.status
FROM orders_v o LEFT JOIN shipments_v s ON s.order_id = o.order_id""",
        "orders_v", "shipments_v",
    ),
)
def orders_with_shipments(spark, sf):
    joined = joins.orders_with_shipments(R.orders_v(spark, sf), R.shipments_v(spark, sf))
    return joined.select("order_id", "order_date", "order_status", "carrier", "status")


@query(
    "orders_with_returns",
    with_tables(
        """SELECT order_id, customer_id FROM orders_v o
WHERE EXISTS (SELECT 1 FROM items_v i WHERE i.order_id = o.order_id AND i.return_flag = 'R')""",
        "orders_v", "items_v",
    ),
)
def orders_with_returns(spark, sf):
    hits = joins.matched(R.orders_v(spark, sf), R.returns_v(spark, sf), ["order_id"])
    return hits.select("order_id", "customer_id")


@query(
    "orphan_items",
    with_tables(
        """SELECT i.order_id, COUNT(*) AS n_lines FROM items_v i
WHERE NOT EXISTS (SELECT 1 FROM orders_v o WHERE o.order_id = i.order_id AND o.order_status <> 'P') GROUP BY 1""",
        "orders_v", "items_v",
    ),
)
def orphan_items(spark, sf):
    settled = R.orders_v(spark, sf).where("order_status <> 'P'")
    lost = joins.orphans(R.items_v(spark, sf), settled, ["order_id"])
    return lost.groupBy("order_id").agg(F.count("*").alias("n_lines"))


@query(
    "skew_join",
    with_tables(
        """SELECT c.segment, c.region, COUNT(*) AS orders, CAST(SUM(o.amount) AS DOUBLE) AS amount FROM (
  SELECT CASE WHEN order_status = 'P' THEN 7 ELSE customer_id END AS customer_id, amount FROM orders_v) o
JOIN customers_v c ON c.customer_id = o.customer_id GROUP BY 1, 2""",
        "orders_v", "customers_v",
    ),
)
def skew_join(spark, sf):
    """A third of all orders moved to one customer."""
    hot = F.when(F.col("order_status") == "P", F.lit(7)).otherwise(F.col("customer_id"))
    orders = R.orders_v(spark, sf).withColumn("customer_id", hot.cast("bigint"))
    joined = joins.skew_join(
        orders.select("customer_id", "order_id", "amount"), R.customers_v(spark, sf), "customer_id", 8
    )
    return joined.groupBy("segment", "region").agg(
        F.count("*").alias("orders"), F.sum("amount").alias("amount")
    )


def channel_sides(spark, sf):
    items = R.seller_items(spark, sf).select(
        "region", "product_id", F.col("quantity").alias("units"), F.col("price").alias("amount")
    )
    partner = F.col("region").isin(*R.PARTNER_REGIONS)
    return items.where(~partner), items.where(partner)


@query(
    "channel_sales",
    with_tables(
        """SELECT product_id,
  CAST(COALESCE(SUM(quantity) FILTER (WHERE region NOT IN ('ASIA', 'EUROPE')), 0) AS BIGINT) AS direct_units,
  CAST(COALESCE(SUM(price) FILTER (WHERE region NOT IN ('ASIA', 'EUROPE')), 0) AS DOUBLE) AS direct_amount,
  CAST(COALESCE(SUM(quantity) FILTER (WHERE region IN ('ASIA', 'EUROPE')), 0) AS BIGINT) AS marketplace_units,
  CAST(COALESCE(SUM(price) FILTER (WHERE region IN ('ASIA', 'EUROPE')), 0) AS DOUBLE) AS marketplace_amount
FROM seller_items GROUP BY 1""",
        "seller_items",
    ),
)
def channel_sales(spark, sf):
    return joins.channel_sales(*channel_sides(spark, sf))


@query(
    "channel_volume",
    with_tables(
        """SELECT *, CAST(marketplace_units AS DOUBLE) / (direct_units + marketplace_units) AS marketplace_share FROM (
  SELECT p.category,
    CAST(SUM(CASE WHEN region NOT IN ('ASIA', 'EUROPE') THEN quantity ELSE 0 END) AS BIGINT) AS direct_units,
    CAST(SUM(CASE WHEN region IN ('ASIA', 'EUROPE') THEN quantity ELSE 0 END) AS BIGINT) AS marketplace_units
  FROM seller_items i JOIN products_v p ON p.product_id = i.product_id GROUP BY 1)""",
        "seller_items", "products_v",
    ),
)
def channel_volume(spark, sf):
    return inventory.channel_volume(*channel_sides(spark, sf), R.products_v(spark, sf))


@query(
    "diff_tables",
    with_tables(
        """WITH b AS (SELECT order_id, CASE WHEN partner = '1-URGENT' THEN 'X' ELSE order_status END AS order_status,
    CASE WHEN partner = '2-HIGH' AND order_status = 'O' THEN amount + 1 ELSE amount END AS amount
  FROM orders_v WHERE NOT (partner = '5-LOW' AND order_status = 'P')),
a AS (SELECT order_id, order_status, amount FROM orders_v WHERE NOT (partner = '3-MEDIUM' AND order_status = 'F'))
SELECT COALESCE(a.order_id, b.order_id) AS order_id,
  CASE WHEN b.order_id IS NULL THEN 'only_left' WHEN a.order_id IS NULL THEN 'only_right' ELSE 'changed' END AS kind,
  CASE WHEN a.order_id IS NOT NULL AND b.order_id IS NOT NULL THEN concat_ws(',',
    CASE WHEN a.order_status <> b.order_status THEN 'order_status' END, CASE WHEN a.amount <> b.amount THEN 'amount' END)
    ELSE '' END AS changed_columns
FROM a FULL JOIN b ON a.order_id = b.order_id
WHERE a.order_id IS NULL OR b.order_id IS NULL OR a.order_status <> b.order_status OR a.amount <> b.amount""",
        "orders_v",
    ),
)
def diff_tables(spark, sf):
    base = R.orders_v(spark, sf)
    status, partner = F.col("order_status"), F.col("partner")
    left = base.where(~((partner == "3-MEDIUM") & (status == "F")))
    moved = F.when((partner == "2-HIGH") & (status == "O"), F.col("amount") + 1).otherwise(F.col("amount"))
    right = base.where(~((partner == "5-LOW") & (status == "P"))).select(
        "order_id",
        F.when(partner == "1-URGENT", F.lit("X")).otherwise(status).alias("order_status"),
        moved.alias("amount"),
    )
    diff = joins.diff_tables(left.select("order_id", "order_status", "amount"), right, ["order_id"])
    names = F.coalesce(F.array_join("changed_columns", ","), F.lit(""))
    return diff.withColumn("changed_columns", names)


@query(
    "table_scalars",
    """SELECT (SELECT COUNT(*) FROM orders) AS n_orders, (SELECT COUNT(*) FROM lineitem) AS n_items,
  (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS amount,
  (SELECT COUNT(DISTINCT c_nationkey) FROM customer) AS nations""",
)
def table_scalars(spark, sf):
    return scalars(
        orders=R.orders_v(spark, sf).agg(F.count("*").alias("n_orders"), F.sum("amount").alias("amount")),
        items=R.items_v(spark, sf).agg(F.count("*").alias("n_items")),
        customers=R.table(spark, sf, "customer").agg(F.count_distinct("c_nationkey").alias("nations")),
    )
