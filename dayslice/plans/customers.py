"""Marketing: tiers, campaigns, lifecycle and ratings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, day, ratio, safe_ratio, tier, total
from ..operators.scd2 import scd2_from_snapshots


def tier_spend(
    customers: DataFrame,
    orders: DataFrame,
    bounds: Sequence[float],
    labels: Sequence[str],
) -> DataFrame:
    """Loyalty tier against what customers really spend; customers without orders count as 0."""
    spend = orders.groupBy("customer_id").agg(total("total_amount").alias("spend"))
    known = customers.select("customer_id", "loyalty_tier").join(spend, "customer_id", "left")
    amount = F.coalesce(F.col("spend"), F.lit(0).cast("decimal(28,2)"))
    return (
        known.withColumn("spend", amount)
        .withColumn("spend_band", tier("spend", bounds, labels))
        .groupBy("loyalty_tier", "spend_band")
        .agg(F.count("*").alias("customers"), F.sum("spend").alias("total_spend"))
    )


def tier_history(snapshots: DataFrame, key: str = "customer_id", attr: str = "loyalty_tier") -> DataFrame:
    """Tier versions per customer, from daily snapshots since the pipeline went live."""
    return scd2_from_snapshots(snapshots, [key], [attr])


def campaign_effect(vouchers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Uses, item revenue and discount cost per campaign.

    Items are summed per order, orders per voucher, and only then is the campaign joined, so
    no step multiplies rows. Campaigns nobody used appear with zeros.
    """
    value = items.groupBy("order_id").agg(total("total_price").alias("value"))
    used = orders.where(F.col("voucher_code").isNotNull())
    per_voucher = (
        used.select("order_id", "voucher_code", "discount_amount")
        .join(value, "order_id", "left")
        .groupBy("voucher_code")
        .agg(
            F.count("*").alias("uses"),
            F.sum("value").alias("revenue"),
            total("discount_amount").alias("discount_cost"),
        )
    )
    zero = F.lit(0)
    return (
        vouchers.select("voucher_code", "campaign_id")
        .join(per_voucher, "voucher_code", "left")
        .groupBy("campaign_id")
        .agg(
            F.coalesce(F.sum("uses"), zero).alias("uses"),
            F.coalesce(F.sum("revenue"), zero).alias("revenue"),
            F.coalesce(F.sum("discount_cost"), zero).alias("discount_cost"),
        )
    )


def lifecycle(orders: DataFrame, asof: str | dt.date, inactive_days: int = 60) -> DataFrame:
    """State of each customer on a date: new, repeat, or inactive, from orders up to that date.

    The mean gap between orders is (last - first) / (n - 1), so no ordering is needed.
    """
    per_customer = (
        orders.where(F.col("order_date") <= day(asof))
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            F.count("*").alias("orders"),
        )
    )
    idle = F.datediff(day(asof), F.col("last_order"))
    span = F.datediff(F.col("last_order"), F.col("first_order"))
    state = (
        F.when(idle > inactive_days, F.lit("inactive"))
        .when(F.col("orders") > 1, F.lit("repeat"))
        .otherwise(F.lit("new"))
    )
    return per_customer.withColumns(
        {
            "avg_gap_days": safe_ratio(span, F.col("orders") - 1),
            "idle_days": idle,
            "state": state,
        }
    )


def repeat_rate(orders: DataFrame, days: int = 30) -> DataFrame:
    """Share of customers who ordered again within some days of their first order.

    Orders are reduced to one row per customer and day before the ordered window.
    """
    per_day = orders.groupBy("customer_id", "order_date").agg(F.count("*").alias("_n"))
    per_customer = Window.partitionBy("customer_id").orderBy("order_date")
    first_days = per_day.withColumns(
        {
            "_rn": F.row_number().over(per_customer),
            "_next": F.lead("order_date").over(per_customer),
        }
    ).where(F.col("_rn") == 1)
    again = (F.col("_n") > 1) | (F.datediff(F.col("_next"), F.col("order_date")) <= days)
    return first_days.agg(
        F.count("*").alias("customers"), count_if(again).alias("repeaters")
    ).withColumn("repeat_rate", safe_ratio("repeaters", "customers"))


def ratings(reviews: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Mean rating per category and channel; reviews without a text count too.

    Ratings are small integers, so they are summed per order and product before the joins.
    """
    summed = reviews.groupBy("order_id", "product_id").agg(
        F.sum("rating").alias("_sum"), F.count("rating").alias("_n"), F.count("comment").alias("_texts")
    )
    return (
        summed.join(products.select("product_id", "category"), "product_id")
        .join(orders.select("order_id", "channel"), "order_id")
        .groupBy("category", "channel")
        .agg(
            F.sum("_n").alias("reviews"),
            F.sum("_texts").alias("with_text"),
            ratio(F.sum("_sum"), F.sum("_n")).alias("avg_rating"),
        )
    )
