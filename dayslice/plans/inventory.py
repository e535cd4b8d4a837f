"""Products: stock, sellers, losses, channels, and volume."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day, money, ratio, shift
from ..operators.dedup import top_bottom_per_group
from ..operators.joins import channel_sales
from ..operators.shape import flag_products


def best_slow_sellers(items: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """Best and slowest selling products per category; unsold products count as 0."""
    units = items.where(F.col("quantity") > 0).groupBy("product_id").agg(
        F.sum("quantity").alias("units")
    )
    rows = products.select("product_id", "category").join(units, "product_id", "left")
    filled = rows.withColumn("units", F.coalesce(F.col("units"), F.lit(0)))
    return top_bottom_per_group(filled, ["category"], "units", ["product_id"], k)


def loss_making(products: DataFrame, items: DataFrame) -> DataFrame:
    """Products whose cost is above their list price or above a price they were really sold at."""
    lowest = items.where(F.col("quantity") > 0).groupBy("product_id").agg(
        F.min(money("sale_price")).alias("min_sale_price"), F.count("*").alias("sales")
    )
    joined = flag_products(products).join(lowest, "product_id", "left")
    below = F.coalesce(F.col("cost_price") > F.col("min_sale_price"), F.lit(False))
    return (
        joined.withColumn("is_sold_below_cost", below)
        .where(F.col("is_loss_making") | F.col("is_sold_below_cost"))
        .select(
            "product_id",
            "cost_price",
            "base_price",
            "min_sale_price",
            "is_loss_making",
            "is_sold_below_cost",
        )
    )


def channel_volume(direct: DataFrame, marketplace: DataFrame, products: DataFrame) -> DataFrame:
    """Units per category in both channels and the marketplace share."""
    per_product = channel_sales(direct, marketplace)
    return (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(
            F.sum("direct_units").alias("direct_units"),
            F.sum("marketplace_units").alias("marketplace_units"),
        )
        .withColumn(
            "marketplace_share",
            ratio("marketplace_units", F.col("direct_units") + F.col("marketplace_units")),
        )
    )


def sell_through(
    stock: DataFrame,
    sales: DataFrame,
    asof: str | dt.date,
    days: int = 7,
    exclude: Sequence[str | dt.date] = (),
) -> DataFrame:
    """Mean daily units over the last days and the days until stock runs out.

    Days in `exclude`, such as sales events, leave both the sum and the number of days.
    No sale in the period means no forecast.
    """
    first = shift(asof, -(days - 1))
    period = [first + dt.timedelta(days=i) for i in range(days)]
    out = {d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in exclude}
    counted = [d for d in period if d not in out]
    if not counted:
        raise ValueError("every day of the period is excluded")
    recent = (
        sales.where(F.col("sale_date").between(day(first), day(asof)))
        .where(F.col("sale_date").isin(counted))
        .groupBy("product_id")
        .agg(F.sum("units").alias("units"))
    )
    joined = stock.select("product_id", "stock_qty").join(recent, "product_id", "left")
    average = F.coalesce(F.col("units"), F.lit(0)).cast("double") / float(len(counted))
    return joined.withColumn("avg_daily_units", average).select(
        "product_id",
        "stock_qty",
        "avg_daily_units",
        F.when(F.col("avg_daily_units") > 0, F.col("stock_qty") / F.col("avg_daily_units")).alias(
            "days_to_stockout"
        ),
    )


def daily_volume(orders: DataFrame, spike: float = 2.0) -> DataFrame:
    """Orders per day against the median day, with spikes marked.

    The window for the median sees one row per calendar day.
    """
    daily = orders.groupBy("order_date").agg(F.count("*").alias("orders"))
    median = F.percentile("orders", F.lit(0.5)).over(Window.partitionBy(F.lit(0)))
    return daily.withColumn("ratio", F.col("orders") / median).withColumn(
        "is_spike", F.col("ratio") >= F.lit(float(spike))
    )
