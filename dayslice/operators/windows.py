"""Time-ordered calculations per entity.

Rows are first reduced to one per entity and day. An ordered window then holds at most one
row per calendar day, however many rows a hot entity has.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_col, day, ratio, shift
from ..session import fits_broadcast, materialize


def day_grid(
    entities: DataFrame, key: str, d0: str | dt.date, d1: str | dt.date, out: str = "day"
) -> DataFrame:
    """One row per entity and calendar day d0..d1; `entities` must be unique by key."""
    return entities.withColumn(out, F.explode(F.sequence(day(d0), day(d1))))


def daily_units(sales: DataFrame, key: str, date_col: str, units: str) -> DataFrame:
    """Units per entity and day; a time counts for its day."""
    return sales.groupBy(key, F.col(date_col).cast("date").alias("day")).agg(F.sum(units).alias("units"))


def avg_daily_units(
    sales: DataFrame,
    key: str,
    date_col: str,
    units: str,
    d0: str | dt.date,
    d1: str | dt.date,
    days: int = 7,
    entities: DataFrame | None = None,
) -> DataFrame:
    """Trailing average of units for every entity and day in d0..d1; idle days count as zero.

    Sales of the `days - 1` days before d0 are read too, so the first days have full averages. The entities
    are those of a dimension table if given, else those with a sale in the days that are read.
    """
    start = shift(d0, -(days - 1))
    read = sales.where((F.col(date_col) >= day(start)) & (F.col(date_col) < day(shift(d1, 1))))
    daily = daily_units(read, key, date_col, units)
    keys = (daily if entities is None else entities).select(key).distinct()
    grid = day_grid(keys, key, start, d1)
    trailing = Window.partitionBy(key).orderBy("day").rowsBetween(-(days - 1), 0)
    return (
        grid.join(daily, [key, "day"], "left")
        .withColumn("units", F.coalesce(F.col("units"), F.lit(0)))
        .withColumn("avg_units", F.sum("units").over(trailing).cast("double") / days)
        .where(F.col("day") >= day(d0))
    )


def end_of_day_stock(
    inventory: DataFrame,
    movements: DataFrame,
    d0: str | dt.date,
    d1: str | dt.date,
    key: str = "product_id",
    qty: str = "qty_change",
    ts: str = "created_at",
) -> DataFrame:
    """Stock at the end of each day d0..d1: the current stock minus all later movements.

    `ts` is a date or a time; a movement belongs to the day it falls on.
    """
    moved_on = F.col(ts).cast("date")
    # Movements after d1 all count for every reported day, so they are one bucket.
    bucket = F.when(moved_on > day(d1), day(shift(d1, 1))).otherwise(moved_on)
    daily = (
        movements.where(F.col(ts) >= day(shift(d0, 1)))
        .groupBy(key, bucket.alias("day"))
        .agg(F.sum(qty).alias("_moved"))
    )
    grid = day_grid(inventory.select(key), key, d0, shift(d1, 1))
    later = Window.partitionBy(key).orderBy(F.col("day").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    moved = grid.join(daily, [key, "day"], "left").withColumn(
        "_later", F.coalesce(F.sum("_moved").over(later), F.lit(0))
    )
    return (
        moved.where(F.col("day") <= day(d1))
        .join(inventory.select(key, "stock_qty"), key)
        .select(
            F.col("day").alias("snapshot_date"),
            key,
            (F.col("stock_qty") - F.col("_later")).alias("stock_qty"),
        )
    )


def order_sequence(
    orders: DataFrame, entity: str, date_col: str, tie: Sequence[str]
) -> DataFrame:
    """Number each order of an entity and give the days since its previous order.

    Two levels, so that a hot entity is not one window: positions inside a day come from a
    window on (entity, day), and the counts of earlier days from one row per entity and day.
    """
    per_day = orders.groupBy(entity, date_col).agg(F.count("*").alias("_n"))
    by_day = Window.partitionBy(entity).orderBy(date_col)
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    starts = per_day.select(
        entity,
        date_col,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.datediff(F.col(date_col), F.lag(date_col).over(by_day)).alias("_gap"),
    )
    inside = Window.partitionBy(entity, date_col).orderBy(*tie)
    return (
        orders.withColumn("_rn", F.row_number().over(inside))
        .join(starts, [entity, date_col])
        .withColumns(
            {
                "order_no": F.col("_before") + F.col("_rn"),
                "gap_days": F.when(F.col("_rn") > 1, F.lit(0)).otherwise(F.col("_gap")),
            }
        )
        .withColumn("is_first", F.col("order_no") == 1)
        .drop("_rn", "_before", "_gap")
    )


def order_sequence_split(
    orders: DataFrame, entity: str, date_col: str, tie: Sequence[str], hot_rows: int = 1_000_000, ranges: int = 64
) -> DataFrame:
    """`order_sequence` for data in which one (entity, day) may hold a large part of all rows.

    Days of an entity with more rows than `hot_rows` are cut at approximate quantiles of the first tie column, which must be a number, a date or
    a time; rows get their place inside a range and the rows of the ranges before are added. Ranges are a function of the value, so
    equal values stay together and the numbers equal those of one window.
    """
    group = [entity, date_col]
    first = tie[0]
    kind = orders.schema[first].dataType
    dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    value = F.unix_micros(F.col(first).cast("timestamp")) if dated else F.col(first)
    counts = orders.groupBy(*group).agg(F.count("*").alias("_n"))
    hot = materialize(counts.where(F.col("_n") > hot_rows).select(*group), "hot-days")
    near = F.broadcast(hot) if fits_broadcast(hot) else hot
    share = [i / ranges for i in range(1, ranges)]
    cuts = orders.join(near, group, "left_semi").groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, share, 1000)).alias("_cuts"))
    cuts = materialize(cuts, "day-cuts")
    known = F.broadcast(cuts) if fits_broadcast(cuts) else cuts
    place = F.when(F.col("_cuts").isNull() | value.isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c <= value)))
    placed = orders.join(known, group, "left").withColumn("_range", place).drop("_cuts")
    per_range = placed.groupBy(*group, "_range").agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy(entity).orderBy(date_col, "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(*group, "_range", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    days = counts.select(*group, F.datediff(F.col(date_col), F.lag(date_col).over(Window.partitionBy(entity).orderBy(date_col))).alias("_gap"))
    firsts = per_range.groupBy(*group).agg(F.min("_range").alias("_first"))
    about = starts.join(days, group).join(firsts, group)
    inside = Window.partitionBy(*group, "_range").orderBy(*tie)
    opens = (F.col("_rn") == 1) & (F.col("_range") == F.col("_first"))
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(about, [*group, "_range"])
        .withColumns({"order_no": F.col("_before") + F.col("_rn"), "gap_days": F.when(opens, F.col("_gap")).otherwise(F.lit(0))})
        .withColumn("is_first", F.col("order_no") == 1)
        .select(*orders.columns, "order_no", "gap_days", "is_first")
    )


def dod_change(fact: DataFrame, date_col: str) -> DataFrame:
    """Rows per day next to those of the calendar day before; a gap means no prior day."""
    daily = fact.groupBy(F.col(date_col).alias("day")).agg(F.count("*").alias("n_rows"))
    prior = daily.select(F.date_add("day", 1).alias("day"), F.col("n_rows").alias("prior_rows"))
    joined = daily.join(prior, "day", "left")
    return joined.withColumn(
        "change", ratio(F.col("n_rows") - F.col("prior_rows"), as_col("prior_rows"))
    )
