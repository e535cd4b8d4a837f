"""Load patterns as functions (target, source) -> new target.

The functions only describe the new table; `sources.writers` decides which part of it is
written. Upserts that replace whole rows use an anti join, so a batch that fits a
broadcast leaves the target unshuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKeyError
from ..functions.columns import day
from .dedup import keep_first, keep_latest
from .shape import union_evolving


def only_slice(src: DataFrame, col: str, ds: str | dt.date) -> DataFrame:
    """Fail, while the rows flow, on a row that does not belong to the slice.

    The guard is a filter, which no column pruning can remove.
    """
    message = F.concat(
        F.lit(f"row outside slice {col}={ds}: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL"))
    )
    inside = F.col(col).eqNullSafe(day(ds))
    return src.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def unique_source(src: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fail, while the rows flow, on a key with several rows.

    Grouping by the key is the shuffle the following join needs anyway, and copies
    of a hot key are merged before it.
    """
    rest = [c for c in src.columns if c not in key]
    grouped = src.groupBy(*key).agg(
        F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in rest]
    )
    message = F.concat(
        F.lit("several source rows for key "), F.to_json(F.struct(*key)), F.lit("; de-duplicate first")
    )
    checked = F.when(F.col("_copies") == 1, F.col("_copies")).otherwise(F.raise_error(message))
    return grouped.where(checked == 1).select(src.columns)


def assert_unique_source(src: DataFrame, key: Sequence[str]) -> None:
    """Run the key check now and raise with the number of keys that repeat."""
    repeated = src.groupBy(*key).count().where("count > 1").count()
    if repeated:
        raise DuplicateKeyError(f"{repeated} keys of {list(key)} have several source rows")


def replace_slice(tgt: DataFrame, src: DataFrame, col: str, ds: str | dt.date) -> DataFrame:
    """The target with one date slice replaced; rows without a date stay."""
    kept = tgt.where(~F.col(col).eqNullSafe(day(ds)))
    return union_evolving(kept, only_slice(src, col, ds))


def delete_range(tgt: DataFrame, col: str, lo: str | dt.date, hi: str | dt.date) -> DataFrame:
    """The target without the dates lo..hi, both included; rows without a date stay."""
    gone = F.coalesce(F.col(col).between(day(lo), day(hi)), F.lit(False))
    return tgt.where(~gone)


def upsert_all(tgt: DataFrame, src: DataFrame, key: Sequence[str]) -> DataFrame:
    """Update every column of matched keys and insert the rest."""
    batch = unique_source(src, key)
    kept = tgt.join(src.select(*key), list(key), "left_anti")
    return union_evolving(kept.select(tgt.columns), batch)


def upsert_dedup(
    tgt: DataFrame,
    src: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    latest: bool = False,
) -> DataFrame:
    """Upsert of a day that may hold copies: the first, or latest, row of each key is applied."""
    batch = keep_latest(src, keys, order) if latest else keep_first(src, keys, order)
    kept = tgt.join(src.select(*keys).distinct(), list(keys), "left_anti")
    return union_evolving(kept.select(tgt.columns), batch)


def insert_missing(
    tgt: DataFrame, src: DataFrame, key: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Insert keys the target lacks and leave present rows as they are."""
    new = keep_first(src, key, order).join(tgt.select(*key), list(key), "left_anti")
    return union_evolving(tgt, new.select(src.columns))


def update_where(
    tgt: DataFrame, matched: DataFrame, key: Sequence[str], changes: Mapping[str, Column]
) -> DataFrame:
    """Change some columns of the rows whose key appears in another table."""
    hits = matched.select(*key).distinct().withColumn("_hit", F.lit(True))
    joined = tgt.join(hits, list(key), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    cols = [
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in tgt.columns
    ]
    return joined.select(cols)


def upsert_scd1(
    tgt: DataFrame,
    src: DataFrame,
    key: Sequence[str],
    set_cols: Sequence[str],
    ds: str | dt.date,
    first_seen: str = "first_seen_date",
    last_updated: str = "last_updated_date",
) -> DataFrame:
    """Type 1 dimension, in any order of run dates.

    Attributes are those of the newest date seen; the first date only moves back, the last one only forward.
    """
    batch = unique_source(src.select(*key, *set_cols).distinct(), key)
    old = tgt.select(*key, *set_cols, first_seen, last_updated).alias("t")
    new = batch.withColumn("_in_batch", F.lit(True)).alias("s")
    run = F.when(F.col("s._in_batch").isNotNull(), day(ds))
    newer = run.isNotNull() & (F.col(f"t.{last_updated}").isNull() | (run >= F.col(f"t.{last_updated}")))
    # Null-safe, so that a NULL key keeps its one row from run to run.
    met = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key])
    joined = old.join(new, met, "full_outer")
    return joined.select(
        *[F.coalesce(F.col(f"t.{k}"), F.col(f"s.{k}")).alias(k) for k in key],
        *[F.when(newer, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in set_cols],
        F.least(F.col(f"t.{first_seen}"), run).alias(first_seen),
        F.greatest(F.col(f"t.{last_updated}"), run).alias(last_updated),
    )


def upsert_activity(
    dim: DataFrame,
    daily: DataFrame,
    key: str,
    ds: str | dt.date,
    attrs: Mapping[str, str],
    first_seen: str = "first_seen_date",
    last_active: str = "last_active_date",
) -> DataFrame:
    """Accumulate first and last date per key, in any order of run dates.

    `attrs` maps dimension columns to columns of the daily table. They follow the newest
    date seen, so re-running an old date does not bring old values back.
    """
    batch = unique_source(daily.select(key, *attrs.values()), [key]).select(
        key, *[F.col(v).alias(k) for k, v in attrs.items()], day(ds).alias("_ds")
    )
    # Null-safe, so that a NULL key keeps its one row from run to run.
    joined = dim.alias("t").join(batch.alias("s"), F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}")), "full_outer")
    newer = F.col("s._ds").isNotNull() & (
        F.col(f"t.{last_active}").isNull() | (F.col("s._ds") >= F.col(f"t.{last_active}"))
    )
    return joined.select(
        F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key),
        *[F.when(newer, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in attrs],
        F.least(F.col(f"t.{first_seen}"), F.col("s._ds")).alias(first_seen),
        F.greatest(F.col(f"t.{last_active}"), F.col("s._ds")).alias(last_active),
    ).select(dim.columns)


def activity_from_history(
    daily: DataFrame,
    key: str,
    date_col: str,
    attrs: Mapping[str, str],
    first_seen: str = "first_seen_date",
    last_active: str = "last_active_date",
) -> DataFrame:
    """Same table as applying `upsert_activity` for every date, in one aggregation."""
    return daily.groupBy(key).agg(
        F.min(date_col).alias(first_seen),
        F.max(date_col).alias(last_active),
        *[F.max_by(v, date_col).alias(k) for k, v in attrs.items()],
    )


def apply_cdc(
    tgt: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    op: str = "op",
    delete: str = "D",
    add: Sequence[str] = (),
) -> DataFrame:
    """Apply inserts, updates and deletes; deleting an absent key does nothing.

    `add` names columns of the changes that the target gains, NULL in the rows that stay. Batches have to come in order: a later call wins whatever its times. `merge_changes` needs no order.
    """
    last = keep_latest(changes, key, order)
    # Distinct keys: a key changed very often is reduced before the shuffle.
    kept = tgt.join(changes.select(*key).distinct(), list(key), "left_anti")
    live = last.where(~F.col(op).eqNullSafe(F.lit(delete)))
    new = [c for c in add if c not in tgt.columns]
    return union_evolving(kept.select(tgt.columns), live.select(*tgt.columns, *new))


def merge_changes(
    table: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The last change of each key over a table of such changes and a new batch, in any order of batches.

    The table keeps deletes as rows, so a late change of a deleted key finds out that it is old; `live` hides them.
    Applying a batch twice, or batches in another order, gives the same table. Keys without a change pass by an
    anti join. A column that only one side has is NULL in the rows of the other.
    """
    keys = changes.select(*key).distinct()
    known = table.join(keys, list(key), "left_semi").select(table.columns)
    kept = table.join(keys, list(key), "left_anti").select(table.columns)
    return union_evolving(kept, keep_latest(union_evolving(known, changes), key, order))


def live(table: DataFrame, op: str = "op", delete: str = "D") -> DataFrame:
    """Rows of a table of last changes that are not deletes, without the kind of change."""
    return table.where(~F.col(op).eqNullSafe(F.lit(delete))).drop(op)


def snapshot(df: DataFrame, ds: str | dt.date, col: str = "snapshot_date") -> DataFrame:
    """A full copy of a table stamped with the run date."""
    return df.withColumn(col, day(ds))


def read_as_of(snapshots: DataFrame, col: str, ds: str | dt.date) -> DataFrame:
    """The newest snapshot taken on or before a date."""
    past = snapshots.where(F.col(col) <= day(ds))
    newest = past.agg(F.max(col).alias(col))
    return past.join(F.broadcast(newest), col, "left_semi")


def backfill_days(
    build: Callable[[str], DataFrame], dates: Iterable[str]
) -> DataFrame:
    """Union of one-day builds. For few dates; prefer a build that takes a range."""
    return reduce(lambda a, b: a.unionByName(b), [build(d) for d in dates])
