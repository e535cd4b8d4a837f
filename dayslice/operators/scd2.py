"""Type 2 dimensions: one row per version of a key.

Two conventions. Open: [effective_from, effective_to) with NULL as open end and a surrogate
key per version. Closed: [effective_date, expiration_date] with 9999-12-31 as open end and
a version number. Both applies first undo the run date, so a date can be run again, also
with a corrected snapshot, and raise on a date older than the table.
Only current rows are joined. History passes through without a shuffle; the closed form searches it for the
versions of keys that open without a current row, by a broadcast of these keys where they are few.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import day, same, shift
from ..session import fits_broadcast, materialize
from .load import unique_source
from .numbering import number_rows

# Fixed value: end of the current version in the closed convention.
OPEN_END = "9999-12-31"


def _not_newer(col: str, ds: str | dt.date) -> Column:
    late = F.raise_error(
        F.concat(F.lit(f"run date {ds} is older than version start "), F.col(col).cast("string"))
    )
    return F.when(F.col(col) > day(ds), late).otherwise(F.col(col))


def _undo(
    dim: DataFrame, ds: str | dt.date, start: str, end: str, closed_on: Column, open_end: Column
) -> DataFrame:
    """The table as it was before the run date: its versions gone, what it closed open again."""
    reopened = F.col(end).eqNullSafe(closed_on)
    return (
        dim.withColumn(start, _not_newer(start, ds))
        .where(F.col(start) != day(ds))
        .withColumns(
            {
                end: F.when(reopened, open_end).otherwise(F.col(end)),
                "is_current": F.col("is_current") | reopened,
            }
        )
    )


def _meet(
    before: DataFrame, snap: DataFrame, key: Sequence[str], attrs: Sequence[str], close_missing: bool
) -> DataFrame:
    """Current rows met with the snapshot: one row per key known to either.

    `_closes` tells that the current version ends, `_opens` that a new version starts with
    the attributes `_new_*`. A key occurs once on both sides, so no key can be hot here.
    """
    current = before.where("is_current").withColumn("_held", F.lit(True))
    batch = unique_source(snap.select(*key, *attrs), key).select(
        *key, *[F.col(a).alias(f"_new_{a}") for a in attrs], F.lit(True).alias("_seen")
    )
    held, seen = F.col("_held").isNotNull(), F.col("_seen").isNotNull()
    equal = same([F.col(a) for a in attrs], [F.col(f"_new_{a}") for a in attrs])
    ends = (seen & ~equal) | ~seen if close_missing else seen & ~equal
    return current.join(batch, list(key), "full_outer").withColumns(
        {"_closes": held & ends, "_opens": seen & (~held | ~equal)}
    )


def apply_scd2_closed(
    dim: DataFrame,
    snap: DataFrame,
    key: Sequence[str],
    attrs: Sequence[str],
    ds: str | dt.date,
    close_missing: bool = False,
) -> DataFrame:
    """Apply one full snapshot in the closed convention.

    Each met row yields its current version, its new version, or both, from the same join.
    """
    forever = F.lit(OPEN_END).cast("date")
    before = _undo(dim, ds, "effective_date", "expiration_date", day(shift(ds, -1)), forever)
    # A current row has the highest version of its key. Only a key that opens without a current row may have closed versions to count on
    # from: new keys and those that come back. The join is written, these few keys are taken from it, and history is
    # filtered by them; it is not touched where there are none.
    met = materialize(_meet(before, snap, key, attrs, close_missing), "met")
    without = met.where(F.col("_held").isNull()).select(*key)
    if without.isEmpty():
        both = met.withColumn("_last", F.lit(None).cast(dim.schema["version"].dataType))
    else:
        small = F.broadcast(without) if fits_broadcast(without) else without
        closed = before.where("NOT is_current").join(small, list(key), "left_semi")
        both = met.join(closed.groupBy(*key).agg(F.max("version").alias("_last")), list(key), "left")
    closes = F.col("_closes")
    cols = dim.columns
    old = {c: F.col(c) for c in cols} | {
        "expiration_date": F.when(closes, day(shift(ds, -1))).otherwise(F.col("expiration_date")),
        "is_current": ~closes,
    }
    new = {
        **{k: F.col(k) for k in key},
        **{a: F.col(f"_new_{a}") for a in attrs},
        "effective_date": day(ds),
        "expiration_date": forever,
        "is_current": F.lit(True),
        "version": (F.coalesce(F.col("version"), F.col("_last"), F.lit(0)) + 1).cast(dim.schema["version"].dataType),
    }
    versions = F.array_compact(
        F.array(
            F.when(F.col("_held").isNotNull(), F.struct(*[old[c].alias(c) for c in cols])),
            F.when(F.col("_opens"), F.struct(*[new[c].alias(c) for c in cols])),
        )
    )
    touched = both.select(F.explode(versions).alias("v")).select("v.*")
    return before.where("NOT is_current").select(cols).unionByName(touched)


def apply_scd2_open(
    dim: DataFrame,
    snap: DataFrame,
    key: Sequence[str],
    attrs: Sequence[str],
    ds: str | dt.date,
    surrogate: str = "customer_key",
    close_missing: bool = False,
) -> DataFrame:
    """Apply one full snapshot in the open convention; new versions get the next surrogates.

    The join of current rows and snapshot runs once: its old and new versions are written to the shared folder,
    and only the new ones are numbered from there.
    """
    before = _undo(
        dim, ds, "effective_from", "effective_to", day(ds), F.lit(None).cast("date")
    )
    met = _meet(before, snap, key, attrs, close_missing)
    closes = F.col("_closes")
    kept = [*key, *attrs]
    others = [c for c in dim.columns if c not in kept]
    old = {c: F.col(c) for c in dim.columns} | {
        "effective_to": F.when(closes, day(ds)).otherwise(F.col("effective_to")),
        "is_current": ~closes,
    }
    new = {**{k: F.col(k) for k in key}, **{a: F.col(f"_new_{a}") for a in attrs}}
    new |= {c: F.lit(None).cast(dim.schema[c].dataType) for c in others}
    versions = F.array_compact(
        F.array(
            F.when(F.col("_held").isNotNull(), F.struct(*[old[c].alias(c) for c in dim.columns], F.lit(False).alias("_fresh"))),
            F.when(F.col("_opens"), F.struct(*[new[c].alias(c) for c in dim.columns], F.lit(True).alias("_fresh"))),
        )
    )
    touched = materialize(met.select(F.explode(versions).alias("v")).select("v.*"), "versions")
    current = touched.where("NOT _fresh")
    opened = touched.where("_fresh").select(*kept)
    highest = before.agg(F.max(surrogate).alias("_max"))
    fresh = number_rows(opened, key, surrogate, after=highest).withColumns(
        {
            "effective_from": day(ds),
            "effective_to": F.lit(None).cast("date"),
            "is_current": F.lit(True),
        }
    )
    cols = dim.columns
    history = before.where("NOT is_current")
    return history.select(cols).unionByName(current.select(cols)).unionByName(fresh.select(cols))


def scd2_from_snapshots(
    snaps: DataFrame,
    key: Sequence[str],
    attrs: Sequence[str],
    date_col: str = "snapshot_date",
    closed: bool = True,
    surrogate: str | None = None,
) -> DataFrame:
    """Whole history from many snapshots at once; equals applying them day by day.

    A key has one row per snapshot date, so the window per key is bounded by the calendar.
    """
    per_key = Window.partitionBy(*key).orderBy(date_col)
    previous = [F.lag(a).over(per_key) for a in attrs]
    first = F.row_number().over(per_key) == 1
    changes = snaps.withColumn(
        "_change", first | ~same([F.col(a) for a in attrs], previous)
    ).where("_change")
    following = F.lead(date_col).over(per_key)
    if closed:
        return changes.select(
            *key,
            *attrs,
            F.col(date_col).alias("effective_date"),
            F.coalesce(F.date_sub(following, 1), F.lit(OPEN_END).cast("date")).alias("expiration_date"),
            following.isNull().alias("is_current"),
            F.row_number().over(per_key).alias("version"),
        )
    versions = changes.select(
        *key,
        *attrs,
        F.col(date_col).alias("effective_from"),
        following.alias("effective_to"),
        following.isNull().alias("is_current"),
    )
    if surrogate is None:
        return versions
    return number_rows(versions, [*key, "effective_from"], surrogate)


def scd2_from_snapshots_closing(
    snaps: DataFrame,
    key: Sequence[str],
    attrs: Sequence[str],
    date_col: str = "snapshot_date",
    closed: bool = True,
    surrogate: str | None = None,
) -> DataFrame:
    """`scd2_from_snapshots` that ends the version of a key which a snapshot lacks, as `close_missing` does day by day.

    The dates of all snapshots say which date follows which: a row continues the version before it if it lies on the next
    date and has the same attributes. Else a version starts, also for a key that comes back unchanged. A version ends on the date
    after its last row. A key has one row per snapshot date, so the window per key is bounded by the calendar, and so are the dates.
    """
    dates = snaps.select(F.col(date_col)).distinct()
    following = F.lead(date_col).over(Window.partitionBy(F.lit(0)).orderBy(date_col))
    calendar = dates.select(date_col, following.alias("_next"))
    per_key = Window.partitionBy(*key).orderBy(date_col)
    rows = snaps.select(*key, *attrs, date_col).join(F.broadcast(calendar), date_col)
    previous = [F.lag(a).over(per_key) for a in attrs]
    goes_on = F.coalesce(F.lag("_next").over(per_key) == F.col(date_col), F.lit(False))
    starts = (~(goes_on & same([F.col(a) for a in attrs], previous))).cast("int")
    runs = rows.withColumn("_starts", starts).withColumn("version", F.sum("_starts").over(per_key).cast("int"))
    versions = runs.groupBy(*key, "version").agg(
        *[F.max_by(a, date_col).alias(a) for a in attrs], F.min(date_col).alias("_from"), F.max_by("_next", date_col).alias("_to")
    )
    current = F.col("_to").isNull().alias("is_current")
    if closed:
        last = F.coalesce(F.date_sub("_to", 1), F.lit(OPEN_END).cast("date"))
        return versions.select(*key, *attrs, F.col("_from").alias("effective_date"), last.alias("expiration_date"), current, "version")
    opened = versions.select(*key, *attrs, F.col("_from").alias("effective_from"), F.col("_to").alias("effective_to"), current)
    return opened if surrogate is None else number_rows(opened, [*key, "effective_from"], surrogate)


def as_of(dim: DataFrame, ds: str | dt.date, lo: str, hi: str, closed: bool = True) -> DataFrame:
    """The version of each key that was valid on a date."""
    point = day(ds)
    if closed:
        return dim.where(point.between(F.col(lo), F.col(hi)))
    return dim.where((F.col(lo) <= point) & (F.col(hi).isNull() | (point < F.col(hi))))


def overlapping_versions(
    dim: DataFrame, key: Sequence[str], version: str, lo: str, hi: str
) -> DataFrame:
    """Versions that start before an earlier version of the key has ended.

    Compares with the running maximum of earlier ends: one pass, and no pairs of versions.
    """
    earlier = (
        Window.partitionBy(*key).orderBy(version).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        dim.withColumn("_reach", F.max(hi).over(earlier))
        .where(F.col("_reach") >= F.col(lo))
        .drop("_reach")
    )


def gaps_between_versions(
    dim: DataFrame, key: Sequence[str], lo: str = "effective_date", hi: str = "expiration_date"
) -> DataFrame:
    """Versions after which the next one starts later than the following day."""
    following = F.lead(lo).over(Window.partitionBy(*key).orderBy(lo))
    return (
        dim.withColumn("next_start", following)
        .where(F.col("next_start") > F.date_add(F.col(hi), 1))
    )


def scd2_problems(dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of counts for the closed convention. Zero everywhere is sound, except that
    keys without a current row are expected where vanished keys are closed.

    All counts come from one shuffle on the key.
    """
    per_key = Window.partitionBy(*key).orderBy("version")
    earlier = per_key.rowsBetween(Window.unboundedPreceding, -1)
    marked = dim.select(
        *key,
        F.col("is_current").cast("int").alias("_cur"),
        F.coalesce(F.max("expiration_date").over(earlier) >= F.col("effective_date"), F.lit(False))
        .cast("int").alias("_overlap"),
        F.coalesce(
            F.lead("effective_date").over(per_key) > F.date_add(F.col("expiration_date"), 1), F.lit(False)
        ).cast("int").alias("_gap"),
        F.coalesce(F.lag("version").over(per_key) == F.col("version"), F.lit(False))
        .cast("int").alias("_repeat"),
    )
    by_key = marked.groupBy(*key).agg(
        F.sum("_cur").alias("_cur"),
        F.sum("_overlap").alias("_overlap"),
        F.sum("_gap").alias("_gap"),
        F.sum("_repeat").alias("_repeat"),
    )
    zero = F.lit(0).cast("bigint")
    return by_key.agg(
        F.coalesce(F.sum((F.col("_cur") > 1).cast("int")), zero).alias("several_current"),
        F.coalesce(F.sum((F.col("_cur") == 0).cast("int")), zero).alias("no_current"),
        F.coalesce(F.sum("_overlap"), zero).alias("overlaps"),
        F.coalesce(F.sum("_gap"), zero).alias("gaps"),
        F.coalesce(F.sum("_repeat"), zero).alias("repeated_versions"),
    )
