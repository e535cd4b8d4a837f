"""Layer schemas, typed tables, and ad-hoc queries on a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .readers import read_table


@dataclass(frozen=True)
class TableSpec:
    """Name as schema.table, columns as DDL, and the partition columns."""

    name: str
    columns: str
    partitions: Sequence[str] = ()
    location: str | None = None


def ensure_tables(spark: SparkSession, specs: Iterable[TableSpec]) -> None:
    """Create missing schemas and tables; existing ones keep their data."""
    for spec in specs:
        schema = spec.name.rpartition(".")[0]
        if schema:
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        parts = f" PARTITIONED BY ({', '.join(spec.partitions)})" if spec.partitions else ""
        place = f" LOCATION '{spec.location}'" if spec.location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {spec.name} ({spec.columns}) USING parquet{parts}{place}"
        )


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A typed frame without rows, the start state of a load pattern."""
    return spark.createDataFrame([], schema)


def query_table(
    df: DataFrame,
    where: str | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    sql: str | None = None,
) -> DataFrame:
    """Look into a table: filter, columns and, if asked, a limit, or a SELECT over the alias `tbl`."""
    if sql is not None:
        df.createOrReplaceTempView("tbl")
        return df.sparkSession.sql(sql)
    rows = df if where is None else df.where(where)
    rows = rows if columns is None else rows.select(*columns)
    return rows if limit is None else rows.limit(limit)


def describe_table(df: DataFrame) -> DataFrame:
    """Column names and types as rows."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean")


def query_path(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """`query_table` on a table given by path."""
    return query_table(read_table(spark, path, fmt), **options)
