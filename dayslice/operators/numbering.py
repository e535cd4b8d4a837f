"""Gap-free row numbers without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def hash_bucket(keys: Sequence[str], digits: int = 4):
    """16**digits buckets by a hash of the key that any engine can compute."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.substring(F.md5(text), 1, digits)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    out: str,
    after: DataFrame | None = None,
    digits: int = 4,
) -> DataFrame:
    """Number rows 1..n by (hash bucket of the key, key), starting after an existing maximum.

    `keys` must be unique per row. `after` is a one-row, one-column frame with the highest
    number in use. Rows are ranked inside their bucket; the bucket offsets come from a count
    per bucket, a table of at most 16**digits rows (65,536 by default, about 2 MB), which is
    therefore safe to broadcast; one digit more makes the tasks 16 times smaller.
    The result depends on the data alone, not on how it is partitioned.
    """
    bucketed = df.withColumn("_bucket", hash_bucket(keys, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    if after is not None:
        highest = after.select(
            F.lit("").alias("_bucket"),
            F.coalesce(F.col(after.columns[0]).cast("bigint"), F.lit(0)).alias("_n"),
        )
        counts = counts.unionByName(highest)
    # At most 16**digits + 1 rows reach this single ordered window.
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, (F.col("_offset") + F.col("_rn")).cast("bigint"))
        .drop("_bucket", "_rn", "_offset")
    )


def number_in_order(
    df: DataFrame, order: Sequence[str | Column], out: str = "rank", partitions: int | None = None
) -> DataFrame:
    """Number all rows 1..n in a total order, without bringing them into one task.

    Rows are dealt by ranges of the order, sorted in their range, and written; the rows of the ranges before are added to
    the place inside a range. The rest of the columns break ties, so the numbers depend on the data alone and a hot value is
    cut by them; only rows that are alike in all columns share a range. The offsets are one number for each range.
    """
    spark = df.sparkSession
    given = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [F.col(f.name) for f in df.schema if _orderable(f.dataType)]
    ranged = df.repartitionByRange(*given, *rest) if partitions is None else df.repartitionByRange(partitions, *given, *rest)
    # Written, since a range sample may differ from run to run: a file is a range, its rows lie in their order.
    stored = materialize(ranged.sortWithinPartitions(*given, *rest), "ranges")
    placed = stored.select("*", F.col("_metadata.file_name").alias("_range"), F.col("_metadata.row_index").alias("_place"))
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for name in sorted(counts):  # part-00000, part-00001, ...
        offsets.append((name, before))
        before += counts[name]
    known = spark.createDataFrame(offsets, "_range string, _before bigint")
    numbered = placed.join(F.broadcast(known), "_range").withColumn(out, F.col("_before") + F.col("_place") + 1)
    return numbered.drop("_range", "_place", "_before")


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType)) and all(
        _orderable(f.dataType) for f in (kind.fields if isinstance(kind, T.StructType) else [])
    ) and (not isinstance(kind, T.ArrayType) or _orderable(kind.elementType))


def draw(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) for each row, from a hash of its key and a seed: the same on any engine and in any partitioning.

    The first 13 hexadecimal digits of md5('seed|key|...') over 16^13, which a double holds exactly.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def sample_by_key(df: DataFrame, keys: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Rows whose draw is below `share`. All rows of a key stay or go together, and a larger share holds every smaller one."""
    return df.where(draw(keys, seed) < F.lit(float(share)))


def batch_ids(df: DataFrame, key: str, size: int = 50, digits: int = 4) -> DataFrame:
    """Distinct ids in full batches of at most `size`, for requests that take a list of ids."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    numbered = number_rows(ids, [key], "_pos", digits=digits)
    return (
        numbered.withColumn("batch_id", F.floor((F.col("_pos") - 1) / size).cast("bigint"))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(key)).alias("ids"))
    )
