"""Operations: how well orders are delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, ratio, safe_ratio
from ..operators.joins import orders_with_shipments

NO_CARRIER = "unassigned"


def delivery_rate(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Delivered and failed orders per day and carrier; orders without a shipment are their own group."""
    joined = orders_with_shipments(
        orders.select("order_id", "order_date"),
        shipments.select("order_id", "carrier", F.col("status").alias("delivery_status")),
    )
    return (
        joined.groupBy(
            "order_date", F.coalesce("carrier", F.lit(NO_CARRIER)).alias("carrier")
        )
        .agg(
            F.count("*").alias("orders"),
            count_if(F.col("delivery_status") == "delivered").alias("delivered"),
            count_if(F.col("delivery_status") == "failed").alias("failed"),
        )
        .withColumns(
            {
                "success_rate": safe_ratio("delivered", "orders"),
                "failure_rate": safe_ratio("failed", "orders"),
            }
        )
    )


def delivery_time(shipments: DataFrame) -> DataFrame:
    """Mean hours from pickup to delivery per carrier; delivered shipments only.

    Summed as whole seconds, so the result does not depend on row order.
    """
    seconds = F.unix_timestamp(F.col("delivered_at").cast("timestamp")) - F.unix_timestamp(
        F.col("shipped_at").cast("timestamp")
    )
    done = shipments.where((F.col("status") == "delivered") & F.col("delivered_at").isNotNull())
    return done.groupBy("carrier").agg(
        F.count("*").alias("delivered"),
        ratio(F.sum(seconds), F.count("*") * 3600).alias("avg_hours"),
    )


def redelivery_rate(shipments: DataFrame) -> DataFrame:
    """Share of shipments per carrier that needed more than one attempt."""
    return (
        shipments.groupBy("carrier")
        .agg(
            F.count("*").alias("shipments"),
            count_if(F.col("delivery_attempts") > 1).alias("redelivered"),
        )
        .withColumn("redelivery_rate", safe_ratio("redelivered", "shipments"))
    )


def failure_reasons(shipments: DataFrame) -> DataFrame:
    """Failed shipments per reason with their share; the window sees one row per reason."""
    counts = (
        shipments.where(F.col("status") == "failed")
        .groupBy(F.coalesce("failure_reason", F.lit("unknown")).alias("failure_reason"))
        .agg(F.count("*").alias("failures"))
    )
    total = F.sum("failures").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", safe_ratio(F.col("failures"), total))


def province_failures(shipments: DataFrame) -> DataFrame:
    """Failure rate per province, to rank the worst."""
    return (
        shipments.groupBy("recipient_province")
        .agg(
            F.count("*").alias("shipments"),
            count_if(F.col("status") == "failed").alias("failures"),
        )
        .withColumn("failure_rate", safe_ratio("failures", "shipments"))
    )


def return_rate(
    orders: DataFrame, items: DataFrame, returns: DataFrame, products: DataFrame
) -> DataFrame:
    """Share of orders with a return, per category and channel.

    An order counts once per category it touches, however many lines or returns it has.
    """
    touched = (
        items.select("order_id", "product_id")
        .join(products.select("product_id", "category"), "product_id")
        .select("order_id", "category")
        .distinct()
    )
    returned = returns.select("order_id").distinct().withColumn("_returned", F.lit(True))
    return (
        touched.join(orders.select("order_id", "channel"), "order_id")
        .join(returned, "order_id", "left")
        .groupBy("category", "channel")
        .agg(
            F.count("*").alias("orders"),
            count_if(F.col("_returned").isNotNull()).alias("returned"),
        )
        .withColumn("return_rate", safe_ratio("returned", "orders"))
    )
