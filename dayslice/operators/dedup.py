"""One row per key.

`row_number() = 1` makes Spark put a group limit below the shuffle: each map task keeps
one row per key, so a key that holds a third of all rows sends one row per task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shape import in_domain, on_day


def total_order(df: DataFrame, key: Sequence[str], order: Sequence[str], desc: bool) -> list[Column]:
    """The wanted order, then every other sortable column, so equal rows are the only ties."""
    first = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
    rest = [
        F.col(f.name).asc()
        for f in df.schema.fields
        if f.name not in {*key, *order} and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return first + rest


def _first_per_key(df: DataFrame, key: Sequence[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key."""
    return _first_per_key(df, key, total_order(df, key, order, desc=False))


def keep_latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key."""
    return _first_per_key(df, key, total_order(df, key, order, desc=True))


def validate_snapshot(
    df: DataFrame,
    key: Sequence[str],
    attr: str,
    domain: Sequence[str],
    date_col: str = "snapshot_date",
    ds: str | dt.date | None = None,
) -> DataFrame:
    """Snapshot rows with an allowed attribute, one per key and date, smallest attribute first."""
    sliced = df if ds is None else on_day(df, date_col, ds)
    return keep_first(in_domain(sliced, attr, domain), [*key, date_col], [attr])


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, ties: bool = False
) -> DataFrame:
    """The k best rows of each group; with `ties`, also rows level with the k-th."""
    rank = F.rank() if ties else F.row_number()
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", rank.over(window)).where(F.col("rank") <= k)


def top_bottom_per_group(
    df: DataFrame, group: Sequence[str], by: str, tie: Sequence[str], k: int
) -> DataFrame:
    """The k best and k slowest rows of each group, labelled by `side`.

    Two ranked branches instead of one with an OR, so each gets its own map-side limit.
    """
    ties = [F.col(c).asc() for c in tie]
    best = top_per_group(df, group, [F.col(by).desc(), *ties], k).withColumn("side", F.lit("best"))
    slow = top_per_group(df, group, [F.col(by).asc(), *ties], k).withColumn("side", F.lit("slow"))
    return best.unionByName(slow)
