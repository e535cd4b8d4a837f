"""The business tables of the operators, derived from the driver's tables.

Each recipe exists twice: as a DataFrame function and as a SQL table expression of the same
name, so that a query and its SQL start from the same rows. All rows of the driver's tables
take part; defects that the operators must handle come from values in the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayslice.functions.columns import money, tier
from dayslice.operators.dedup import keep_first

DIM_TABLES = ("region", "nation")

# Parameters shared by Spark and SQL recipes.
PARTNER_REGIONS = ("ASIA", "EUROPE")
TIER_BOUNDS = (150_000, 300_000, 500_000)
TIER_LABELS = ("bronze", "silver", "gold", "platinum")
CDC_CUT = "2024-01-16"
ORDER_CUT = "2001-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def date_of(c: str) -> Column:
    return F.col(c).cast("date")


def orders_v(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        date_of("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        money("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("partner"),
    )


def items_v(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        money("l_extendedprice").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        date_of("l_shipdate").alias("ship_date"),
    )


def products_v(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.floor(F.col("p_retailprice") * (F.col("p_size") + 60)) / 100.0
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        money("p_retailprice").alias("base_price"),
        money(cost).alias("cost_price"),
        (F.col("p_size").cast("bigint") * 100).alias("stock_qty"),
    )


def bronze_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Raw orders with unknown customers and negative amounts."""
    unknown = (F.col("partner") == "5-LOW") & (F.col("order_status") == "P")
    return orders_v(spark, sf).select(
        "order_id",
        F.when(~unknown, F.col("customer_id")).alias("customer_id"),
        "order_date",
        (F.col("amount") - F.lit(20_000)).cast("decimal(18,2)").alias("amount"),
    )


def regions_of(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """Nation key -> nation and region name; 25 rows by design of the data."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias(key), F.col("n_name").alias("province"), F.col("r_name").alias("region")
    )


def seller_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with the region of their seller."""
    sellers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("nation_key")
    )
    placed = sellers.join(regions_of(spark, sf, "nation_key"), "nation_key").select("seller_id", "region")
    return items_v(spark, sf).join(placed, "seller_id")


def market_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales of partner sellers; some stored net amounts are wrong."""
    price = F.floor(F.col("price").cast("double") / F.col("quantity")).cast("bigint")
    gross = (F.col("sale_price") * F.col("quantity_sold")).cast("decimal(18,0)")
    net = F.floor(gross * (F.lit(1).cast("decimal(2,0)") - F.col("commission_rate"))).cast("bigint")
    wrong = (F.col("return_flag") == "R") & (F.col("discount") == F.lit("0.10").cast("decimal(4,2)"))
    rows = seller_items(spark, sf).where(F.col("region").isin(*PARTNER_REGIONS))
    return rows.select(
        F.lower("region").alias("partner"),
        "product_id",
        F.col("ship_date").alias("order_date"),
        F.col("quantity").alias("quantity_sold"),
        price.alias("sale_price"),
        F.col("tax").cast("decimal(6,4)").alias("commission_rate"),
        "return_flag",
        "discount",
    ).select(
        "partner",
        "product_id",
        "order_date",
        "quantity_sold",
        "sale_price",
        "commission_rate",
        (net + wrong.cast("bigint")).alias("net_revenue"),
        F.date_add("order_date", 15).alias("settlement_date"),
    )


def shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Own-shop orders with fees and discounts; some discounts exceed the subtotal."""
    per_order = items_v(spark, sf).groupBy("order_id").agg(
        F.sum("price").alias("_sub"), F.sum("tax").alias("_tax")
    )
    zero = F.lit(0).cast("decimal(18,2)")
    discount = F.floor(F.col("amount").cast("double") / 4).cast("decimal(18,2)")
    joined = orders_v(spark, sf).join(per_order, "order_id", "left").select(
        "order_id",
        "customer_id",
        "order_date",
        F.col("order_status").alias("status"),
        F.when(F.col("partner").isin("1-URGENT", "2-HIGH"), F.col("partner")).alias("voucher_code"),
        F.when(F.col("order_status") == "P", F.lit("app")).otherwise(F.lit("web")).alias("channel"),
        money(F.coalesce(F.col("_sub"), zero)).alias("subtotal"),
        money(F.coalesce(F.col("_tax") * 1000, zero)).alias("shipping_fee"),
        discount.alias("discount_amount"),
    )
    total = F.col("subtotal") + F.col("shipping_fee") - F.col("discount_amount")
    return joined.withColumn("total_amount", money(F.greatest(total, zero)))


def vouchers_v(spark: SparkSession, sf: str) -> DataFrame:
    codes = orders_v(spark, sf).select(F.col("partner").alias("voucher_code")).distinct()
    return codes.select("voucher_code", F.substring("voucher_code", 3, 20).alias("campaign_id"))


def returns_v(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("line_status") == "F", F.lit("refunded")).otherwise(F.lit("approved"))
    return items_v(spark, sf).where(F.col("return_flag") == "R").select(
        "order_id", status.alias("status"), F.col("price").alias("refund_amount")
    )


def shipments_v(spark: SparkSession, sf: str) -> DataFrame:
    """One shipment per order that has items; other orders have none."""
    reason = (
        F.when(F.col("_line") == 1, F.lit("not_at_home"))
        .when(F.col("_line") == 2, F.lit("wrong_address"))
        .when(F.col("_line") == 3, F.lit("refused"))
        .when(F.col("_line") == 4, F.lit("phone_off"))
        .otherwise(F.lit("cannot_locate"))
    )
    status = (
        F.when(F.col("_flag") == "A", F.lit("delivered"))
        .when(F.col("_flag") == "N", F.lit("in_transit"))
        .otherwise(F.lit("failed"))
    )
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_returnflag").alias("_flag"),
        F.min("l_linenumber").alias("_line"),
        F.max("l_linestatus").alias("_open"),
        F.min("l_shipdate").alias("shipped_at"),
        F.max("l_shipdate").alias("delivered_at"),
        F.count_distinct("l_linestatus").alias("delivery_attempts"),
    )
    place = (
        orders_v(spark, sf).select("order_id", "customer_id")
        .join(
            table(spark, sf, "customer").select(
                F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_key")
            ),
            "customer_id",
        )
        .join(regions_of(spark, sf, "nation_key"), "nation_key")
        .select("order_id", F.col("province").alias("recipient_province"))
    )
    return per_order.join(place, "order_id").select(
        "order_id",
        F.when(F.col("_open") == "O", F.lit("north")).otherwise(F.lit("south")).alias("carrier"),
        status.alias("status"),
        "shipped_at",
        "delivered_at",
        "delivery_attempts",
        F.when(F.col("_flag") == "R", reason).alias("failure_reason"),
        "recipient_province",
    )


def payments_v(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three payments per order."""
    kind = (
        F.when(F.col("return_flag") == "A", F.lit("credit_card"))
        .when(F.col("return_flag") == "N", F.lit("debit_card"))
        .otherwise(F.lit("gift_card"))
    )
    return items_v(spark, sf).groupBy("order_id", "return_flag").agg(
        F.count("*").alias("payment_installments"), F.sum("price").alias("payment_value")
    ).select("order_id", kind.alias("payment_type"), "payment_installments", "payment_value")


def customers_v(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with contact data; low balances have no phone on record."""
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.when(
            F.col("c_acctbal") >= -900,
            F.concat(F.lit("09"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")),
        ).alias("phone"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("cccd"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation_key"),
        money(F.col("c_acctbal") * 25_000).alias("account_balance"),
        (F.floor(F.col("c_acctbal") / 20) + 350).cast("bigint").alias("credit_score"),
    )
    return base.join(regions_of(spark, sf, "nation_key"), "nation_key").drop("nation_key")


def snapshots_v(spark: SparkSession, sf: str) -> DataFrame:
    """Customer tier at each new year, from the spend of the year before."""
    spend = orders_v(spark, sf).groupBy(
        "customer_id", (F.year("order_date") + 1).alias("_year")
    ).agg(F.sum("amount").alias("_spend"))
    return spend.select(
        "customer_id",
        tier("_spend", TIER_BOUNDS, TIER_LABELS).alias("tier"),
        F.make_date(F.col("_year"), F.lit(1), F.lit(1)).alias("snapshot_date"),
    )


def raw_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One tier reading per order: several per customer and day, some outside the domain."""
    return orders_v(spark, sf).select(
        "customer_id",
        tier("amount", TIER_BOUNDS, TIER_LABELS).alias("tier"),
        F.trunc("order_date", "YEAR").alias("snapshot_date"),
    )


def ad_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Ad events; clicks arrive twice, the second time a minute later."""
    number = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "view", F.lit("impression")).otherwise(F.col("event_type"))
    events = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("ad_"), number.cast("string")).alias("ad_id"),
        F.floor(number / 10).cast("bigint").alias("campaign_id"),
        "user_id",
        kind.alias("event_type"),
        F.col("ts").alias("event_ts"),
        F.lit("unlisted").alias("debug_note"),
    )
    again = events.where(F.col("event_type") == "click").withColumn(
        "event_ts", F.col("event_ts") + F.expr("INTERVAL 1 MINUTE")
    )
    return events.unionByName(again)


def campaign_events(spark: SparkSession, sf: str) -> DataFrame:
    """One row per impression, with its cost, and whether it was clicked."""
    number = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.concat(F.lit("campaign_"), F.floor(number / 10).cast("string")).alias("campaign"),
        date_of("ts").alias("date"),
        (F.col("event_type") == "click").alias("is_click"),
        money("value").alias("cost_usd"),
    )


def changes_v(spark: SparkSession, sf: str) -> DataFrame:
    """Change log per user: errors delete, sign-ups insert, all else updates."""
    op = (
        F.when(F.col("event_type") == "error", F.lit("D"))
        .when(F.col("event_type") == "signup", F.lit("I"))
        .otherwise(F.lit("U"))
    )
    return table(spark, sf, "events").select(
        "user_id", "event_id", money("value").alias("amount"), op.alias("op"),
        F.col("ts").alias("updated_at"),
    )


def deduped_items(spark: SparkSession, sf: str) -> DataFrame:
    return keep_first(items_v(spark, sf), ["order_id", "line_no"], ["ship_date"])


def in_regions(regions: tuple[str, ...]) -> str:
    return ", ".join(f"'{r}'" for r in regions)


_TIER_SQL = """CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 150000 THEN 'bronze'
  WHEN {c} < 300000 THEN 'silver' WHEN {c} < 500000 THEN 'gold' ELSE 'platinum' END"""

# Table expressions: name -> (expressions it needs, SELECT).
EXPRESSIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "orders_v": (
        (),
        """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS order_status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS partner
FROM orders""",
    ),
    "items_v": (
        (),
        """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no,
  l_partkey AS product_id, l_suppkey AS seller_id, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount,
  CAST(l_tax AS DECIMAL(4,2)) AS tax, l_returnflag AS return_flag,
  l_linestatus AS line_status, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem""",
    ),
    "products_v": (
        (),
        """SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
  CAST(p_retailprice AS DECIMAL(18,2)) AS base_price,
  CAST(floor(p_retailprice * (p_size + 60)) / 100.0 AS DECIMAL(18,2)) AS cost_price,
  CAST(p_size AS BIGINT) * 100 AS stock_qty
FROM part""",
    ),
    "bronze_orders": (
        ("orders_v",),
        """SELECT order_id,
  CASE WHEN NOT (partner = '5-LOW' AND order_status = 'P') THEN customer_id END AS customer_id,
  order_date, CAST(amount - 20000 AS DECIMAL(18,2)) AS amount
FROM orders_v""",
    ),
    "seller_items": (
        ("items_v",),
        """SELECT i.*, r.r_name AS region
FROM items_v i JOIN supplier s ON s.s_suppkey = i.seller_id
JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    ),
    "market_base": (
        ("seller_items",),
        """SELECT lower(region) AS partner, product_id, ship_date AS order_date,
  quantity AS quantity_sold,
  CAST(floor(CAST(price AS DOUBLE) / quantity) AS BIGINT) AS sale_price,
  CAST(tax AS DECIMAL(6,4)) AS commission_rate, return_flag, discount
FROM seller_items WHERE region IN ('ASIA', 'EUROPE')""",
    ),
    "market_sales": (
        ("market_base",),
        """SELECT partner, product_id, order_date, quantity_sold, sale_price, commission_rate,
  CAST(floor(CAST(sale_price * quantity_sold AS DECIMAL(18,0)) * (1 - commission_rate)) AS BIGINT)
    + CASE WHEN return_flag = 'R' AND discount = 0.10 THEN 1 ELSE 0 END AS net_revenue,
  CAST(order_date + INTERVAL 15 DAY AS DATE) AS settlement_date
FROM market_base""",
    ),
    "order_sums": (
        ("items_v",),
        "SELECT order_id, SUM(price) AS sub, SUM(tax) AS fee FROM items_v GROUP BY order_id",
    ),
    "shop_base": (
        ("orders_v", "order_sums"),
        """SELECT o.order_id, o.customer_id, o.order_date, o.order_status AS status,
  CASE WHEN o.partner IN ('1-URGENT', '2-HIGH') THEN o.partner END AS voucher_code,
  CASE WHEN o.order_status = 'P' THEN 'app' ELSE 'web' END AS channel,
  CAST(COALESCE(s.sub, 0) AS DECIMAL(18,2)) AS subtotal,
  CAST(COALESCE(s.fee * 1000, 0) AS DECIMAL(18,2)) AS shipping_fee,
  CAST(floor(CAST(o.amount AS DOUBLE) / 4) AS DECIMAL(18,2)) AS discount_amount
FROM orders_v o LEFT JOIN order_sums s ON s.order_id = o.order_id""",
    ),
    "shop_orders": (
        ("shop_base",),
        """SELECT *, CAST(greatest(subtotal + shipping_fee - discount_amount, 0) AS DECIMAL(18,2)) AS total_amount
FROM shop_base""",
    ),
    "vouchers_v": (
        ("orders_v",),
        "SELECT DISTINCT partner AS voucher_code, substr(partner, 3, 20) AS campaign_id FROM orders_v",
    ),
    "returns_v": (
        ("items_v",),
        """SELECT order_id, CASE WHEN line_status = 'F' THEN 'refunded' ELSE 'approved' END AS status,
  price AS refund_amount
FROM items_v WHERE return_flag = 'R'""",
    ),
    "shipments_v": (
        ("orders_v",),
        """SELECT l.l_orderkey AS order_id,
  CASE WHEN MAX(l_linestatus) = 'O' THEN 'north' ELSE 'south' END AS carrier,
  CASE MIN(l_returnflag) WHEN 'A' THEN 'delivered' WHEN 'N' THEN 'in_transit' ELSE 'failed' END AS status,
  MIN(l_shipdate) AS shipped_at, MAX(l_shipdate) AS delivered_at,
  COUNT(DISTINCT l_linestatus) AS delivery_attempts,
  CASE WHEN MIN(l_returnflag) = 'R' THEN CASE MIN(l_linenumber) WHEN 1 THEN 'not_at_home'
    WHEN 2 THEN 'wrong_address' WHEN 3 THEN 'refused' WHEN 4 THEN 'phone_off'
    ELSE 'cannot_locate' END END AS failure_reason,
  MIN(n.n_name) AS recipient_province
FROM lineitem l JOIN orders_v o ON o.order_id = l.l_orderkey
JOIN customer c ON c.c_custkey = o.customer_id JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY l.l_orderkey""",
    ),
    "payments_v": (
        ("items_v",),
        """SELECT order_id,
  CASE return_flag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'debit_card' ELSE 'gift_card' END AS payment_type,
  COUNT(*) AS payment_installments, SUM(price) AS payment_value
FROM items_v GROUP BY order_id, return_flag""",
    ),
    "customers_v": (
        (),
        """SELECT c_custkey AS customer_id, c_name AS full_name,
  CASE WHEN c_acctbal >= -900 THEN '09' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
  lower(replace(c_name, '#', '.')) || '@example.com' AS email,
  lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS cccd, c_mktsegment AS segment,
  CAST(c_acctbal * 25000 AS DECIMAL(18,2)) AS account_balance,
  CAST(floor(c_acctbal / 20) + 350 AS BIGINT) AS credit_score,
  n_name AS province, r_name AS region
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    ),
    "snapshots_v": (
        ("orders_v",),
        f"""SELECT customer_id, {_TIER_SQL.format(c="spend")} AS tier, make_date(y, 1, 1) AS snapshot_date
FROM (SELECT customer_id, CAST(year(order_date) AS BIGINT) + 1 AS y, SUM(amount) AS spend
      FROM orders_v GROUP BY ALL)""",
    ),
    "raw_snapshots": (
        ("orders_v",),
        f"""SELECT customer_id, {_TIER_SQL.format(c="amount")} AS tier,
  CAST(date_trunc('year', order_date) AS DATE) AS snapshot_date
FROM orders_v""",
    ),
    "ad_numbers": (
        (),
        """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
  user_id, CASE WHEN event_type = 'view' THEN 'impression' ELSE event_type END AS event_type, ts
FROM events""",
    ),
    "ad_raw": (
        ("ad_numbers",),
        """SELECT event_id, 'ad_' || k AS ad_id, k // 10 AS campaign_id, user_id, event_type, ts AS event_ts
FROM ad_numbers
UNION ALL
SELECT event_id, 'ad_' || k, k // 10, user_id, event_type, ts + INTERVAL 1 MINUTE
FROM ad_numbers WHERE event_type = 'click'""",
    ),
    "fact_ads": (
        ("ad_raw",),
        """SELECT CAST(event_id AS VARCHAR) AS event_id, ad_id, CAST(campaign_id AS VARCHAR) AS campaign_id,
  CAST(user_id AS VARCHAR) AS user_id, event_type, event_ts, CAST(event_ts AS DATE) AS event_date
FROM ad_raw WHERE event_type IN ('impression', 'click')
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_ts) = 1""",
    ),
    "agg_ads": (
        ("fact_ads",),
        """SELECT *, CASE WHEN impressions > 0
    THEN floor(clicks::DOUBLE / impressions * 10000 + 0.5) / 10000 ELSE 0.0 END AS ctr
FROM (SELECT event_date, ad_id, campaign_id,
        COUNT(*) FILTER (WHERE event_type = 'impression') AS impressions,
        COUNT(*) FILTER (WHERE event_type = 'click') AS clicks,
        COUNT(DISTINCT user_id) AS unique_users
      FROM fact_ads GROUP BY ALL)""",
    ),
    "campaign_events": (
        (),
        """SELECT 'campaign_' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) // 10) AS campaign,
  CAST(ts AS DATE) AS date, event_type = 'click' AS is_click, CAST(value AS DECIMAL(18,2)) AS cost_usd
FROM events""",
    ),
    "campaign_days": (
        ("campaign_events",),
        """SELECT *, CASE WHEN impressions > 0
    THEN floor(clicks::DOUBLE / impressions * 10000 + 0.5) / 10000 ELSE 0.0 END AS ctr
FROM (SELECT date, campaign, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks,
        SUM(cost_usd) AS spend_usd FROM campaign_events GROUP BY ALL)""",
    ),
    "changes_v": (
        (),
        """SELECT user_id, event_id, CAST(value AS DECIMAL(18,2)) AS amount,
  CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op, ts AS updated_at
FROM events""",
    ),
    "deduped_items": (
        ("items_v",),
        """SELECT * FROM items_v QUALIFY row_number() OVER (PARTITION BY order_id, line_no
  ORDER BY ship_date, product_id, seller_id, quantity, price, discount, tax, return_flag, line_status) = 1""",
    ),
}


def _needed(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _needed(EXPRESSIONS[name][0], done)
            done.append(name)
    return done


def with_tables(body: str, *names: str) -> str:
    """The body with the named table expressions, and those they need, in front."""
    parts = [f"{n} AS (\n{EXPRESSIONS[n][1]}\n)" for n in _needed(names, [])]
    rest = body.strip()
    if rest[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + rest[5:]
    return "WITH " + ",\n".join(parts) + "\n" + rest
