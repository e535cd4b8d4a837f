"""Order and item roll-ups.

Where a join key can be hot (a customer or seller with a third of all rows), the detail is
reduced to one row per key before the join, so map-side combining absorbs the hot key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import RISK_BASE, count_if, exact, risk_score, total
from ..operators.dedup import top_per_group
from ..operators.joins import join_copartitioned, join_current
from ..operators.layout import lag_prune
from ..operators.shape import on_day


def customer_daily(orders: DataFrame, ds: str | dt.date | None = None) -> DataFrame:
    """Orders and spend per customer and day."""
    rows = orders if ds is None else on_day(orders, "order_date", ds)
    return rows.groupBy("customer_id", "order_date").agg(
        F.count("*").alias("order_count"), total("amount").alias("total_amount")
    )


def daily_revenue(orders: DataFrame, ds: str | dt.date | None = None) -> DataFrame:
    """Orders and revenue per partner and day."""
    rows = orders if ds is None else on_day(orders, "order_date", ds)
    return rows.groupBy("order_date", "partner").agg(
        F.count("*").alias("order_count"), total("amount").alias("total_revenue")
    )


def state_gmv(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """Item value per customer state: summed per order, then per customer, then joined."""
    per_order = items.groupBy("order_id").agg(F.sum(exact("price")).alias("gmv"))
    per_customer = (
        orders.select("order_id", "customer_id")
        .join(per_order, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("gmv").alias("gmv"))
    )
    return (
        per_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(F.sum("gmv").cast("decimal(28,2)").alias("gmv"))
    )


def status_category_gmv(
    orders: DataFrame, items: DataFrame, recent: Column, part: str | None = None
) -> DataFrame:
    """Item value per order status and category for the orders that meet a condition.

    `part` names a slice column that orders and their items share; a condition on it then
    prunes both scans.
    """
    on_slice = [] if part is None else [part]
    kept = orders.where(recent).select("order_id", "order_status", *on_slice)
    return (
        kept.join(items.select("order_id", "product_category", "price", *on_slice), ["order_id", *on_slice])
        .groupBy("order_status", "product_category")
        .agg(total("price").alias("gmv"))
    )


def category_revenue(
    orders: DataFrame,
    items: DataFrame,
    lo: str | dt.date,
    hi: str | dt.date,
    approved: str = "approved_at",
    part: str = "order_date",
    *,
    max_lag_days: int,
) -> DataFrame:
    """Revenue, items and coupons per category for orders approved in lo <= t < hi.

    Approval follows the order by a bounded lag, so the order slices are bounded too, and
    since the join names the slice column the items scan is pruned to the same slices.
    """
    kept = lag_prune(orders, approved, lo, hi, part, max_lag_days)
    joined = join_copartitioned(
        kept.select(part, "order_id", "coupon_code"),
        items.select(part, "order_id", "product_category", "price"),
        ["order_id"],
        part,
    )
    return joined.groupBy("product_category").agg(
        total("price").alias("revenue"),
        F.count("*").alias("items_sold"),
        F.count_distinct("coupon_code").alias("coupons_used"),
    )


def daily_ops(orders: DataFrame) -> DataFrame:
    """Orders and distinct customers per day and status."""
    return orders.groupBy("order_date", "order_status").agg(
        F.count("*").alias("orders"), F.count_distinct("customer_id").alias("customers")
    )


def seller_product_stats(items: DataFrame) -> DataFrame:
    """Price and shipping statistics per seller, category and product."""
    return items.groupBy("seller_id", "product_category", "product_id").agg(
        total("price").alias("sum_price"),
        F.count("*").alias("n"),
        (F.sum(exact("price")).cast("double") / F.count("*")).alias("avg_price"),
        F.max("shipping_charges").alias("max_ship"),
        F.min("shipping_charges").alias("min_ship"),
    )


def risk_by_status(
    items: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    base: Mapping[str, float] = RISK_BASE,
) -> DataFrame:
    """Total risk over all (item, payment) pairs of each order, per order status.

    The pairs are not built: an order's total is its number of items times the sum of its
    payment scores. Scores have at most four decimals and are summed exactly.
    """
    score = risk_score("payment_type", "payment_installments", "payment_value", base)
    per_order_items = items.groupBy("order_id").agg(F.count("*").alias("n_items"))
    per_order_score = payments.groupBy("order_id").agg(
        F.sum(score.cast("decimal(18,4)")).alias("score"), F.count("*").alias("n_payments")
    )
    joined = (
        orders.select("order_id", "order_status")
        .join(per_order_items, "order_id")
        .join(per_order_score, "order_id")
    )
    return joined.groupBy("order_status").agg(
        F.sum(F.col("score") * F.col("n_items").cast("decimal(10,0)")).alias("total_risk_score"),
        F.sum(F.col("n_items") * F.col("n_payments")).alias("n_pairs"),
    )


def item_payment_pairs(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders joined to all their items and all their payments; the fan-out is the answer."""
    return orders.join(items, "order_id").join(payments, "order_id")


def segment_summary(customers: DataFrame) -> DataFrame:
    """Customers per segment and region."""
    return customers.groupBy("segment", "region").agg(F.count("*").alias("customers"))


def top_order_per_customer(
    orders: DataFrame, customers_scd2: DataFrame, ties: bool = True
) -> DataFrame:
    """Largest order of each customer with the customer's current attributes.

    Ranking first leaves one row per customer to join. With `ties`, orders of equal amount
    all stay; without, the lowest id does.
    """
    order = [F.col("amount").desc()] if ties else [F.col("amount").desc(), F.col("id").asc()]
    best = top_per_group(orders, ["customer_id"], order, 1, ties)
    return join_current(best, customers_scd2, ["customer_id"])


def order_counts(orders: DataFrame, flag: Column, by: str) -> DataFrame:
    """All orders and flagged orders per group."""
    return orders.groupBy(by).agg(F.count("*").alias("orders"), count_if(flag).alias("flagged"))
