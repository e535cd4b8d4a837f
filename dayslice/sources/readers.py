"""Readers. Schemas are given, not inferred, except where drift is to be found."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmptySourceError, SchemaDriftError
from ..functions.columns import day

# Columns of a marketplace export.
MARKETPLACE_SCHEMA = (
    "external_order_id string, product_id bigint, seller_sku string, partner string, "
    "order_date date, quantity_sold int, sale_price bigint, platform_discount bigint, "
    "commission_rate decimal(6,4), net_revenue bigint, settlement_date date, status string"
)


BAD_LINE = "_corrupt_record"
REASON = "reject_reason"
FILE = "source_file"


def struct_of(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, renames: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files by the names in their header, and the lines that do not fit.

    Columns are chosen by name, in any order; more columns than asked for are ignored, a missing one is named in
    an error. `renames` maps header names to schema names. All files below `path` must have the header of the
    first: Spark stops at one that differs. A line with too many or too few fields, or a value that is not of its
    type, comes back in the second frame as text with the reason, and not in the first. Both frames
    name the file of each row in `source_file`.
    """
    wanted, renames = struct_of(spark, schema), renames or {}
    header = spark.read.option("header", True).csv(path).columns
    names = [renames.get(c, c) for c in header]
    missing = [f.name for f in wanted if f.name not in names]
    if missing:
        raise SchemaDriftError(f"{path} lacks the columns {missing}; it has {header}")
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD_LINE]])
    lines = (
        spark.read.schema(texts)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        # Else a line is judged by the columns that are selected, not by all its fields.
        .option("columnPruning", False)
        .csv(path)
        .withColumnsRenamed({c: n for c, n in zip(header, names, strict=True) if c != n})
        .withColumn(FILE, F.col("_metadata.file_path"))
    )
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in wanted}
    odd = [
        F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
        for f in wanted
    ]
    reason = F.coalesce(F.when(F.col(BAD_LINE).isNotNull(), F.lit("wrong number of fields")), *odd)
    judged = lines.withColumn(REASON, reason)
    rows = judged.where(F.col(REASON).isNull()).select(*[typed[f.name].alias(f.name) for f in wanted], FILE)
    kept = F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in names])
    rejects = judged.where(F.col(REASON).isNotNull()).select(F.coalesce(BAD_LINE, kept).alias("line"), REASON, FILE)
    return rows, rejects


def read_csv_day(
    spark: SparkSession, root: str, ds: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One landing file named after its date, columns by name; a line that does not fit fails the job.

    Use `read_csv_checked` to keep such lines aside. Without a schema it is inferred, for drift checks only.
    """
    path = f"{root}/{ds}.csv"
    if schema is None:
        return spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").csv(path)
    rows, rejects = read_csv_checked(spark, path, schema)
    broken = F.raise_error(F.concat_ws(": ", FILE, REASON, "line"))
    failing = rejects.select(*[broken.cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.union(failing).drop(FILE)


def read_parquet_slice(spark: SparkSession, path: str, col: str, ds: str | dt.date) -> DataFrame:
    """One date of a parquet table; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(col) == day(ds))


def read_partitioned(
    spark: SparkSession, root: str, schema: T.StructType | str | None = None, merge: bool = False
) -> DataFrame:
    """A table laid out as col=value folders. `merge` reads files of different age as one schema."""
    reader = spark.read.option("mergeSchema", merge)
    return (reader if schema is None else reader.schema(schema)).parquet(root)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table by path, in any format on the classpath."""
    return spark.read.format(fmt).load(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    props: Mapping[str, str],
    part_col: str | None = None,
    bounds: tuple[object, object] | None = None,
    n: int | None = None,
) -> DataFrame:
    """A database table. With a numeric or date column and its bounds, n connections read in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, props, part_col, bounds, n)).load()


def jdbc_options(
    url: str,
    table: str,
    props: Mapping[str, str],
    part_col: str | None = None,
    bounds: tuple[object, object] | None = None,
    n: int | None = None,
) -> dict[str, str]:
    """Reader options, split over n ranges only when column, bounds and n are all given."""
    options = {"url": url, "dbtable": table, **props}
    parts = (part_col, bounds, n)
    if all(p is None for p in parts):
        return options
    if any(p is None for p in parts):
        raise ValueError("a parallel read needs part_col, bounds and n together")
    return options | {
        "partitionColumn": part_col,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(n),
    }


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def has_slices(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned table has been written: at least one col=value folder exists."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0


def partition_path(root: str, layer: str, table: str, ds: str) -> str:
    return f"{root}/{layer}/{table}/dt={ds}"


def read_json_partition(
    spark: SparkSession, root: str, layer: str, table: str, ds: str, schema: T.StructType | str
) -> DataFrame:
    """One date of a JSON table; a date never written reads as an empty frame."""
    path = partition_path(root, layer, table, ds)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_marketplace(
    spark: SparkSession, root: str, schema: T.StructType | str = MARKETPLACE_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Exports of all partners, one folder each, named `partner` or `any=partner`.

    A new partner is a new folder, not new code. Columns are matched by name, each folder by its own header; a
    header may put a shop's name before `product_id`. Returns the rows and, apart from them, the lines that do not
    fit, both with their `source_file`.
    """
    good, bad = [], []
    for path in partner_folders(spark, root):
        header = spark.read.option("header", True).csv(f"{path}/*.csv").columns
        renames = {c: "product_id" for c in header if c.endswith("_product_id")}
        # The partner may stand in the file or only in the folder's name.
        wanted = struct_of(spark, schema)
        own = T.StructType([f for f in wanted if f.name != "partner" or "partner" in header])
        rows, rejects = read_csv_checked(spark, f"{path}/*.csv", own, renames)
        folder = F.lit(path.rstrip("/").rsplit("/", 1)[-1].rsplit("=", 1)[-1])
        named = F.coalesce(F.col("partner"), folder) if "partner" in header else folder
        good.append(rows.withColumn("partner", named).select(*wanted.names, FILE))
        bad.append(rejects.withColumn("partner", folder))
    if not good:
        raise EmptySourceError(f"{root} holds no export")
    return reduce(DataFrame.union, good), reduce(DataFrame.union, bad)


def partner_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders directly below a root that hold CSV files: one for each partner."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*.csv")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted({status.getPath().getParent().toString() for status in found})


def assert_nonempty(df: DataFrame, label: str) -> DataFrame:
    """Raise when there is no row. Stops at the first row found instead of counting."""
    if df.isEmpty():
        raise EmptySourceError(f"{label} holds no rows")
    return df


def date_series(spark: SparkSession, d0: str | dt.date, d1: str | dt.date, out: str = "day") -> DataFrame:
    """One row per calendar day d0..d1."""
    return spark.range(1).select(F.explode(F.sequence(day(d0), day(d1))).alias(out))
