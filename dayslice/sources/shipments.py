"""Nested carrier documents to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a shipment and of the answer to a request for several orders.
SHIPMENT = (
    "struct<order_id:string,carrier:string,tracking_code:string,status:string,"
    "actual_shipping_fee:bigint,shipped_at:string,actual_delivery_date:string,"
    "estimated_delivery_date:string,recipient_province:string,recipient_district:string,"
    "delivery_attempts:int,failure_reason:string>"
)
ENVELOPE = (
    f"shipments array<{SHIPMENT}>, count int, not_found array<string>, not_found_count int"
)


def read_shipment_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers, one JSON document per line."""
    return spark.read.schema(ENVELOPE).json(path)


def shipment_rejects(docs: DataFrame, json_col: str) -> DataFrame:
    """Documents that are no answer of a carrier: cut off, no JSON, or with neither list."""
    parsed = F.from_json(F.col(json_col), f"{ENVELOPE}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    judged = docs.withColumn("_d", parsed)
    broken = F.col("_d._corrupt_record").isNotNull() | (F.col("_d.shipments").isNull() & F.col("_d.not_found").isNull())
    return judged.where(F.coalesce(broken, F.lit(True))).drop("_d")


def parse_shipments(docs: DataFrame, json_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Shipments, one row each with real timestamps and dates, and the order ids not found.

    Documents that cannot be read give no row here; `shipment_rejects` returns them.

    Texts carry an offset; as timestamps they are instants, so carriers in different zones
    compare. A text that is no time gives NULL and keeps the row.
    """
    parsed = docs
    if json_col is not None:
        parsed = docs.select(F.from_json(F.col(json_col), ENVELOPE).alias("d")).select("d.*")
    rows = parsed.select(F.explode("shipments").alias("s")).select("s.*")
    typed = rows.withColumns(
        {
            "shipped_at": F.try_to_timestamp("shipped_at"),
            "actual_delivery_date": F.try_to_timestamp("actual_delivery_date"),
            "estimated_delivery_date": F.col("estimated_delivery_date").try_cast("date"),
        }
    ).withColumnRenamed("actual_delivery_date", "delivered_at")
    missing = parsed.select(F.explode("not_found").alias("order_id")).distinct()
    return typed, missing
