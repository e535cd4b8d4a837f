"""Name -> (Spark callable, SQL text). Modules add to it with the `query` decorator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: dates as text, amounts as double, counts as bigint."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(fn: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        QUERIES[name] = Query(name, run, sql)
        return fn

    return add
