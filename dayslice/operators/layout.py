"""File layout jobs and plan evidence."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ReconcileError
from ..functions.columns import count_if, day, shift
from ..session import materialize, new_dir
from .reconcile import Check


def write_compact(df: DataFrame, path: str, part: str, mode: str = "overwrite") -> None:
    """Write few files per slice.

    REBALANCE groups rows by slice like `repartition(part)`, but AQE cuts a slice that is
    larger than the advisory size into several tasks and files.
    """
    (
        df.hint("rebalance", F.col(part))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )


def file_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, bytes, mean file size and rows of a file-based table, per slice if asked."""
    files = df.groupBy(
        *by, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size")
    ).agg(F.count("*").alias("_rows"))
    return files.groupBy(*by).agg(
        F.count("*").alias("n_files"),
        F.sum("_size").alias("n_bytes"),
        (F.sum("_size") / F.count("*")).cast("double").alias("avg_bytes"),
        F.sum("_rows").alias("n_rows"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent checksum of the content, in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"),
    )


def compact(
    spark: SparkSession, src: str, dst: str, target_mb: int = 128, part: str | None = None, n_files: int | None = None
) -> DataFrame:
    """Rewrite many small files as few large ones in a new folder and report before and after.

    Files of about `target_mb`, or exactly `n_files` of them where a reader needs that number; each is written by one task, row
    group by row group. The source is left alone; point the table at `dst` with `switch_location` once the
    report is accepted. Raises when the content differs.
    """
    if part is not None and n_files is not None:
        raise ValueError("the number of files is stated for tables without slices only")
    before = spark.read.parquet(src)
    if part is None and n_files is None:
        stats = file_stats(before).first()
        n_files = max(1, math.ceil((stats["n_bytes"] or 0) / (target_mb * 1024 * 1024)))
    if part is None:
        before.repartition(n_files).write.parquet(dst)
    else:
        write_compact(before, dst, part)
    after = spark.read.parquet(dst)
    a, b = fingerprint(before).first(), fingerprint(after.select(before.columns)).first()
    if (a["n_rows"], a["checksum"]) != (b["n_rows"], b["checksum"]):
        raise ReconcileError(f"compaction changed the content: {a} became {b}")
    return (
        file_stats(before).withColumn("stage", F.lit("before"))
        .unionByName(file_stats(after).withColumn("stage", F.lit("after")))
    )


def switch_location(spark: SparkSession, table: str, path: str) -> None:
    """Point a catalog table at a new folder: readers see the old files or the new, never both."""
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")


def cluster_by(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    """Order a table so that files and row groups cover narrow ranges of the lookup columns.

    Range partitioning samples the data, so hot ranges get more partitions.
    """
    keys = [F.col(c) for c in cols]
    ranged = df.repartitionByRange(*keys) if n is None else df.repartitionByRange(n, *keys)
    return ranged.sortWithinPartitions(*keys)


#: Bits of a column's rank in a Z-order; 2^bits - 1 quantiles are kept for each column.
RANK_BITS = 8
RANGES = "_ranges"


def _as_number(df: DataFrame, c: str) -> Column:
    """A value's place in its order as a number; of a text, its first six bytes."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    return F.col(c).cast("double")


def _rank(value: Column, cuts: Sequence[float], bits: int) -> Column:
    """How many cuts do not exceed the value, by halving; a NULL comes first."""
    padded = F.array(*[F.lit(float(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(padded, at + step - 1) <= value, step).otherwise(F.lit(0)))
    return F.coalesce(found, F.lit(0))


def zorder(df: DataFrame, cols: Sequence[str], n: int | None = None, bits: int = RANK_BITS) -> DataFrame:
    """Order a table along a Z curve, so that files cover narrow ranges of every one of the columns.

    Each column counts by its rank among 2^bits - 1 approximate quantiles (one pass, a bounded result), so skew and units do not
    matter. The ranks' bits are interleaved, the first column's highest, and the result is the key of a range partitioning.
    Equal rows of a hot value differ in the other columns; a value hot in all of them is spread by the range sample of Spark.
    """
    if len(cols) * bits > 62:
        raise ValueError(f"{len(cols)} columns of {bits} bits do not fit a long")
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = {c: _as_number(df, c) for c in cols}
    found = df.agg(*[F.percentile_approx(v, share, 10 << bits).alias(f"_{i}") for i, v in enumerate(numbers.values())]).first()
    cuts = [found[i] or [math.inf] * len(share) for i in range(len(cols))]
    names = [f"_rank_{i}" for i in range(len(cols))]
    ranked = df.withColumns({name: _rank(v, own, bits) for name, v, own in zip(names, numbers.values(), cuts, strict=True)})
    z = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for name in names:
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(F.col(name).cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint")))
    placed = ranked.withColumn("_z", z).drop(*names)
    ranged = placed.repartitionByRange("_z") if n is None else placed.repartitionByRange(n, "_z")
    return ranged.sortWithinPartitions("_z").drop("_z")


def file_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, and the least and greatest value of each column, of every file of a table."""
    ends = [f(c).alias(f"{name}_{c}") for c in cols for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"), *ends)


def write_ranged(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Write a clustered table and, beside its files, the ranges of its lookup columns."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    file_ranges(spark.read.schema(df.schema).parquet(path), cols).coalesce(1).write.mode("overwrite").parquet(f"{path}/{RANGES}")


def files_for(spark: SparkSession, path: str, col: str, lo: object, hi: object) -> list[str]:
    """Files of a table of `write_ranged` that can hold lo <= col <= hi."""
    ranges = spark.read.parquet(f"{path}/{RANGES}")
    inside = (F.col(f"max_{col}") >= F.lit(lo)) & (F.col(f"min_{col}") <= F.lit(hi))
    return sorted(r["file"] for r in ranges.where(inside).select("file").collect())


def lookup(spark: SparkSession, path: str, schema: T.StructType, col: str, lo: object, hi: object) -> DataFrame:
    """Rows with lo <= col <= hi; only files whose range meets it are opened, and none are listed."""
    files = files_for(spark, path, col, lo, hi)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def small_file_plan(files: DataFrame, part: str, target: int, small: float = 0.75) -> DataFrame:
    """Which files to rewrite together: (part, file, size, bin), bins of about `target` bytes for each slice.

    `files` has a row (part, file, size) for each file. Those of at least `small` of the target stay, and so does a slice with one small
    file. Bins follow the running sum of sizes and a file alone in its bin goes into the one before, so a bin is at most two files over the target.
    """
    little = files.where(F.col("size") < small * target)
    one = Window.partitionBy(part)
    before = one.orderBy("size", "file").rowsBetween(Window.unboundedPreceding, -1)
    binned = little.withColumn("bin", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / target).cast("int"))
    mates = F.count("*").over(Window.partitionBy(part, "bin"))
    joined = binned.withColumns({"_files": mates, "_last": F.lag("bin").over(one.orderBy("size", "file"))})
    joined = joined.withColumn("bin", F.when(F.col("_files") > 1, F.col("bin")).otherwise(F.coalesce("_last", "bin"))).drop("_last")
    return joined.withColumn("_files", mates).where("_files > 1").drop("_files")


def compact_small(spark: SparkSession, path: str, part: str, target: int = 128 << 20) -> dict[str, int]:
    """Rewrite only the small files of a partitioned table in place, and report what was done.

    New files are written aside and counted, then moved into their slice, and only then the old ones are deleted. `files` and `bytes` are those in
    place before, `rewritten_files` and `rewritten_bytes` what the plan touches, `rows` and `rewritten_rows` the same in rows, `new_files` what replaces them. A plan
    over files is a list: its size follows the number of small files. One writer at a time; a reader that starts between move and
    delete sees rows twice, so point a catalog table at a copy with `switch_location` where readers cannot wait.
    """
    table = spark.read.parquet(path)
    listed = table.select(part, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    total = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    n_rows = table.count()
    plan = materialize(small_file_plan(listed, part, target), "compaction-plan")
    done = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    report = {"files": total["n"], "bytes": total["b"], "rewritten_files": done["n"], "rewritten_bytes": done["b"], "rows": n_rows, "rewritten_rows": 0, "new_files": 0}
    if not done["n"]:
        return report
    old = [r["file"] for r in plan.select("file").collect()]
    rows = spark.read.option("basePath", path).schema(table.schema).parquet(*old).withColumn("file", F.col("_metadata.file_path"))
    aside = new_dir(spark, "compacted")
    bins = plan.select(F.col("file").alias("_file"), "bin")
    placed = rows.join(bins, F.col("file") == F.col("_file")).drop("file", "_file")
    # One task for each bin, so one file for each.
    placed.repartition(F.col(part), F.col("bin")).write.partitionBy(part, "bin").parquet(aside)
    a, b = fingerprint(rows.drop("file")).first(), fingerprint(spark.read.schema(table.schema).parquet(aside).select(table.columns)).first()
    if (a["n_rows"], a["checksum"]) != (b["n_rows"], b["checksum"]):
        raise ReconcileError(f"compaction changed the content: {a} became {b}")
    new = [s.getPath() for s in _statuses(spark, f"{aside}/*/*/*.parquet")]
    files = new[0].getFileSystem(spark._jsc.hadoopConfiguration())
    for source in new:
        slice_name = source.getParent().getParent().getName()
        files.rename(source, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{slice_name}/{source.getParent().getName()}-{source.getName()}"))
    for gone in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(gone)), False)
    return report | {"rewritten_rows": a["n_rows"], "new_files": len(new)}


def _statuses(spark: SparkSession, pattern: str) -> list:
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or [])


def partition_flat(df: DataFrame, path: str, ts: str, out: str = "order_date") -> None:
    """Rewrite files with opaque names into one folder per day, so a day's query opens one folder."""
    write_compact(df.withColumn(out, F.col(ts).cast("date")), path, out)


def lag_prune(
    df: DataFrame,
    ts: str,
    lo: str | dt.date,
    hi: str | dt.date,
    part: str,
    max_lag_days: int,
) -> DataFrame:
    """Filter lo <= ts < hi and add the slices that can hold such rows.

    If ts is never before the slice date and at most `max_lag_days` after it, only the slices from lo minus
    the lag to hi can match; the optimizer cannot know that, so the bound is stated. A row of a scanned slice that
    breaks it fails the job; `lag_violations` finds such rows in all slices.
    """
    slices = F.col(part).between(day(shift(lo, -max_lag_days)), day(hi))
    broken = F.raise_error(F.concat(F.lit(f"{ts} is outside 0..{max_lag_days} days after slice "), F.col(part).cast("string")))
    inside = (F.col(ts) >= day(lo)) & (F.col(ts) < day(hi))
    checked = F.when(_outside_lag(ts, part, max_lag_days), broken.cast("boolean")).otherwise(inside)
    return df.where(slices).where(checked)


def _outside_lag(ts: str, part: str, max_lag_days: int) -> Column:
    lag = F.datediff(F.col(ts).cast("date"), F.col(part))
    return F.coalesce(~lag.between(0, max_lag_days), F.lit(False))


def lag_violations(df: DataFrame, ts: str, part: str, max_lag_days: int) -> DataFrame:
    """Rows whose time is before their slice or more than the lag after it; a missing time breaks nothing."""
    return df.where(_outside_lag(ts, part, max_lag_days))


def check_lag(df: DataFrame, ts: str, part: str, max_lag_days: int) -> Check:
    """No row breaks the bound that `lag_prune` relies on."""
    figures = {"broken": count_if(_outside_lag(ts, part, max_lag_days))}
    return Check("lag", [(df, figures)], lambda f: (f("broken") == 0, F.lit(0), f("broken")))


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text, for tests that assert pruning or a join strategy."""
    return str(
        df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
    )


