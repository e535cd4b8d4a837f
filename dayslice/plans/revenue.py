"""Finance: revenue per channel, spend, discounts, refunds, and cash."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, day, exact, money, ratio, total
from ..operators.shape import flag_order_anomalies, rollup_sum, top_k


def _sum_when(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast("decimal(28,6)"))).cast("decimal(28,2)")


def direct_revenue(orders: DataFrame, ds: str | dt.date | None = None) -> DataFrame:
    """Own-shop revenue per day.

    Orders whose discount exceeds their subtotal carry a source bug; they are counted but
    not summed, since their stored total of zero is not a free order.
    """
    rows = orders if ds is None else orders.where(F.col("order_date") == day(ds))
    flagged = flag_order_anomalies(rows)
    good = ~F.col("is_over_discounted")
    return flagged.groupBy("order_date").agg(
        count_if(good).alias("orders"),
        _sum_when(good, exact("total_amount")).alias("revenue"),
        count_if(F.col("is_over_discounted")).alias("excluded_orders"),
        count_if(F.col("is_zero_shipping")).alias("zero_shipping_orders"),
    )


def net_revenue() -> Column:
    """What a partner pays for a sale, rounded down to whole units; exact decimal arithmetic."""
    gross = (F.col("sale_price") * F.col("quantity_sold")).cast("decimal(18,0)")
    kept = F.lit(1).cast("decimal(2,0)") - F.col("commission_rate").cast("decimal(6,4)")
    return F.floor(gross * kept).cast("bigint")


def marketplace_revenue(sales: DataFrame, ds: str | dt.date | None = None) -> DataFrame:
    """Partner revenue per day: gross, commission, net, and rows whose stored net disagrees."""
    rows = sales if ds is None else sales.where(F.col("order_date") == day(ds))
    gross = F.col("sale_price") * F.col("quantity_sold")
    return (
        rows.withColumns({"_gross": gross.cast("bigint"), "_net": net_revenue()})
        .groupBy("order_date", "partner")
        .agg(
            F.count("*").alias("sales"),
            F.sum("_gross").alias("gross_revenue"),
            F.sum("_net").alias("net_revenue"),
            (F.sum("_gross") - F.sum("_net")).alias("commission_cost"),
            count_if(~F.col("net_revenue").eqNullSafe(F.col("_net"))).alias("mismatched_rows"),
        )
    )


def revenue_by_channel(direct: DataFrame, marketplace: DataFrame) -> DataFrame:
    """Day, channel, partner, revenue: both channels modelled apart, then put together."""
    own = direct.select(
        "order_date",
        F.lit("direct").alias("channel"),
        F.lit("own").alias("partner"),
        F.col("revenue").cast("decimal(28,2)").alias("revenue"),
    )
    partners = marketplace.select(
        "order_date",
        F.lit("marketplace").alias("channel"),
        "partner",
        F.col("net_revenue").cast("decimal(28,2)").alias("revenue"),
    )
    return own.unionByName(partners)


def channel_totals(by_channel: DataFrame) -> DataFrame:
    """Revenue per channel and partner with sub-totals and a grand total."""
    return rollup_sum(by_channel, ["channel", "partner"], "revenue", "revenue")


def avg_customer_spend(orders: DataFrame, grain: str = "day") -> DataFrame:
    """Mean of what each active customer spent per day or month."""
    period = F.trunc("order_date", "MM") if grain == "month" else F.col("order_date")
    per_customer = orders.groupBy(period.alias("period"), "customer_id").agg(
        total("total_amount").alias("spend")
    )
    return per_customer.groupBy("period").agg(
        F.count("*").alias("customers"),
        (F.sum("spend").cast("double") / F.count("*")).alias("avg_spend"),
    )


def discount_impact(orders: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Gross value, discount and their ratio per campaign; orders without a voucher are one group."""
    per_voucher = orders.groupBy("voucher_code").agg(
        F.count("*").alias("orders"),
        total("subtotal").alias("subtotal"),
        total("discount_amount").alias("discount"),
    )
    named = per_voucher.join(vouchers.select("voucher_code", "campaign_id"), "voucher_code", "left")
    return (
        named.groupBy(F.coalesce("campaign_id", F.lit("none")).alias("campaign_id"))
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("subtotal").alias("subtotal"),
            F.sum("discount").alias("discount"),
        )
        .withColumn("discount_share", ratio("discount", "subtotal"))
    )


def net_after_refund(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Each order's total less the refunds actually paid out.

    Refunds are summed per order first, so an order with two returns is not counted twice.
    """
    paid = (
        returns.where(F.col("status") == "refunded")
        .groupBy("order_id")
        .agg(total("refund_amount").alias("refunded"))
    )
    refunded = F.coalesce(F.col("refunded"), F.lit(0).cast("decimal(18,2)"))
    return orders.join(paid, "order_id", "left").select(
        "order_id",
        "order_date",
        money("total_amount").alias("total_amount"),
        refunded.alias("refunded"),
        (money("total_amount") - refunded).alias("net_amount"),
    )


def daily_net_revenue(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Gross, refunded and net amount by order date, restated whenever refunds are paid."""
    return net_after_refund(orders, returns).groupBy("order_date").agg(
        F.sum("total_amount").alias("gross"),
        F.sum("refunded").alias("refunded"),
        F.sum("net_amount").alias("net"),
    )


def earned_vs_received(sales: DataFrame) -> DataFrame:
    """Partner revenue per month by sale date and by payout date.

    One aggregation: each sale is emitted once per view before grouping.
    """
    views = F.array(
        F.struct(F.trunc("order_date", "MM").alias("month"), F.lit("earned").alias("view")),
        F.struct(F.trunc("settlement_date", "MM").alias("month"), F.lit("received").alias("view")),
    )
    net = F.col("net_revenue").cast("bigint")
    per_day = sales.groupBy("order_date", "settlement_date").agg(F.sum(net).alias("net"))
    rows = per_day.select(F.explode(views).alias("v"), "net")

    def view(name: str) -> Column:
        return F.sum(F.when(F.col("v.view") == name, F.col("net")).otherwise(F.lit(0)))

    return rows.groupBy(F.col("v.month").alias("month")).agg(
        view("earned").alias("earned"), view("received").alias("received")
    )


def top_customers(orders: DataFrame, k: int = 10) -> DataFrame:
    """Customers with the highest spend; ties go to the lower id."""
    spend = orders.groupBy("customer_id").agg(
        total("total_amount").alias("spend"), F.count("*").alias("orders")
    )
    return top_k(spend, [F.col("spend").desc(), F.col("customer_id").asc()], k)
