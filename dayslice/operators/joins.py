"""Joins whose meaning or cost needs more than `df.join`."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import same
from ..session import fits_broadcast, materialize


def broadcast_dim(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only when the size estimate proves it fits; else leave the choice to AQE."""
    fits = fits_broadcast(df) if limit is None else fits_broadcast(df, limit)
    return F.broadcast(df) if fits else df


def orders_with_shipments(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Every order, with NULL delivery fields where no shipment exists."""
    clash = [c for c in shipments.columns if c in orders.columns and c != "order_id"]
    renamed = shipments.withColumnsRenamed({c: f"shipment_{c}" for c in clash})
    return orders.join(renamed, "order_id", "left")


def orphans(fact: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fact rows whose key the dimension lacks; a NULL key is an orphan."""
    return fact.join(dim.select(*key).distinct(), list(key), "left_anti")


def matched(fact: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fact rows whose key the dimension holds, without multiplying them."""
    return fact.join(dim.select(*key).distinct(), list(key), "left_semi")


def join_as_of(
    fact: DataFrame,
    dim: DataFrame,
    key: Sequence[str],
    ts: str,
    lo: str,
    hi: str,
    closed: bool = True,
) -> DataFrame:
    """Each fact row with the dimension version valid at its time; unmatched facts stay.

    The key is an equality, so this is a hash or merge join whose fact side AQE can split
    on a hot key; the validity test is evaluated inside it and no version pairs are emitted.
    """
    f, d = fact.alias("f"), dim.alias("d")
    at = F.col(f"f.{ts}")
    upper = at <= F.col(f"d.{hi}") if closed else F.col(f"d.{hi}").isNull() | (at < F.col(f"d.{hi}"))
    on = (F.col(f"d.{lo}") <= at) & upper
    for k in key:
        on = on & (F.col(f"f.{k}") == F.col(f"d.{k}"))
    extra = [F.col(f"d.{c}") for c in dim.columns if c not in key]
    return f.join(d, on, "left").select("f.*", *extra)


def join_as_of_sorted(
    fact: DataFrame,
    dim: DataFrame,
    key: Sequence[str],
    ts: str,
    lo: str,
    hi: str,
    closed: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """`join_as_of` without comparing facts and versions in pairs, for keys with many versions.

    Facts and versions of a key are one sorted run in which the last version is carried forward, so the work is a sort, whatever the
    number of versions. Versions of a key must not overlap (`scd2.overlapping_versions`); a fact in a gap, without a time or with
    a NULL in its key finds none.

    With `hot_rows`, the run of a key with more facts than that is cut at quantiles of its times: each range gets the versions that start in
    it and the one open at its cut. The cuts are one row for each hot key, at most rows / hot_rows.
    """
    extra = [c for c in dim.columns if c not in key]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    versions = dim.where(whole & F.col(lo).isNotNull()).select(
        *key, F.col(lo).alias("_at"), F.lit(0).alias("_kind"), F.struct(*extra).alias("_version")
    )
    facts = fact.select(*key, F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.struct(*fact.columns).alias("_fact"))
    run = [*key]
    if hot_rows is not None:
        cuts = _time_cuts(fact, key, ts, hot_rows)
        small = F.broadcast(cuts) if fits_broadcast(cuts) else cuts
        place = lambda at: F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.unix_micros(at.cast("timestamp")))), F.lit(0))
        facts = facts.join(small, list(key), "left").withColumn("_range", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(place(F.col("_at"))))
        following = F.lead("_at").over(Window.partitionBy(*key).orderBy("_at"))
        last = F.when(F.col("_next").isNull(), F.size("_cuts")).otherwise(place(F.col("_next")))
        spans = F.when(F.col("_cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(place(F.col("_at")), last))
        versions = versions.withColumn("_next", following).join(small, list(key), "left").withColumn("_range", F.explode(spans)).drop("_next")
        facts, versions, run = facts.drop("_cuts"), versions.drop("_cuts"), [*key, "_range"]
    both = versions.unionByName(facts, allowMissingColumns=True)
    carried = F.last("_version", ignorenulls=True).over(
        Window.partitionBy(*run).orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = both.withColumn("_open", carried).where("_kind = 1")
    end = F.col(f"_open.{hi}")
    inside = F.col("_at") <= end if closed else end.isNull() | (F.col("_at") < end)
    valid = whole & F.col("_at").isNotNull() & F.col("_open").isNotNull() & inside
    return met.withColumn("_open", F.when(valid, F.col("_open"))).select("_fact.*", *[F.col(f"_open.{c}").alias(c) for c in extra])


def _time_cuts(fact: DataFrame, key: Sequence[str], ts: str, hot_rows: int, ranges: int = 64) -> DataFrame:
    """Key and ascending times, in microseconds, at which the run of a hot key is cut into `ranges` of about equal size."""
    counts = fact.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = materialize(counts.select(*key), "hot-keys")
    small = F.broadcast(hot) if fits_broadcast(hot) else hot
    share = [i / ranges for i in range(1, ranges)]
    times = F.unix_micros(F.col(ts).cast("timestamp"))
    found = fact.join(small, list(key), "left_semi").groupBy(*key).agg(F.array_distinct(F.percentile_approx(times, share, 1000)).alias("_cuts"))
    return materialize(found.where("_cuts IS NOT NULL"), "time-cuts")


def join_current(fact: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join to the current versions only. Filtering first avoids one output row per version."""
    return fact.join(dim.where("is_current"), list(key))


def join_copartitioned(
    left: DataFrame, right: DataFrame, keys: Sequence[str], part_col: str, how: str = "inner"
) -> DataFrame:
    """Equi-join that names the partition column both sides share, so a filter prunes both."""
    return left.join(right, [part_col, *keys], how)


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list[object]:
    """Keys that may hold more than `share` of the rows: at most 1/share values.

    Spark's frequent-item sketch never misses such a key; it may name a few others,
    which costs a little salting and nothing else.
    """
    found = df.select(key).stat.freqItems([key], share).first()
    return [] if found is None else [v for v in found[0] if v is not None]


def skew_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    salts: int = 16,
    how: str = "inner",
    share: float = 0.01,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join where single keys hold a large share of `big`.

    AQE splits such keys in a merge join by itself; this is for plans where it cannot, such
    as a join under a window on the same key. Only hot keys are salted: the few matching small
    rows are repeated once per salt, other keys go unchanged.

    The salt is a hash of the columns that tell rows of one key apart: `spread`, by default all others. Where a default hash uses less
    than half of the salts (rows of a hot key are mostly alike, or there is no other column), equal rows are counted instead, with map-side
    combining, a count is dealt over the salts, and rows are repeated after the join. A named `spread` that uses less than half is refused.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError("the salted side must be the preserved one")
    hot = hot_keys(big, key, share)
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    taken = {*big.columns, *small.columns}
    salt_col, n_col = _fresh("_salt", taken), _fresh("_n", taken)
    telling = list(spread) if spread is not None else [f.name for f in big.schema if f.name != key and _hashable(f.dataType)]
    salt = F.pmod(F.xxhash64(*telling), F.lit(salts)).cast("int")
    used = big.where(is_hot).select(salt.alias(salt_col)).distinct().count() if telling else 0
    counted = used < salts // 2
    if counted and spread is not None:
        raise ValueError(f"columns {list(spread)} use {used} of {salts} salts")
    if counted:
        left = salted_counts(big, is_hot, salts).withColumnsRenamed({"_salt": salt_col, "_n": n_col})
    else:
        left = big.withColumn(salt_col, F.when(is_hot, salt).otherwise(F.lit(0)))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = small.withColumn(salt_col, F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    joined = left.join(right, [key, salt_col], how).drop(salt_col)
    if counted:
        joined = joined.withColumn(n_col, F.explode(F.sequence(F.lit(1), F.col(n_col).cast("int")))).drop(n_col)
    return joined


def _fresh(name: str, taken: Collection[str]) -> str:
    """A column name that is not in use."""
    while name in taken:
        name = f"_{name}"
    return name


def _hashable(kind: T.DataType) -> bool:
    return not any(word in kind.simpleString() for word in ("map<", "variant", "interval"))


def salted_counts(df: DataFrame, is_hot: Column, salts: int) -> DataFrame:
    """Distinct rows with a count `_n` and a `_salt`; a hot row's count is dealt over up to `salts` rows."""
    names = {n: _fresh(n, df.columns) for n in ("_all", "_parts", "_i")}
    whole, parts_col, i = names.values()
    counted = df.groupBy(*df.columns).agg(F.count("*").alias(whole))
    parts = F.when(is_hot, F.least(F.col(whole), F.lit(salts))).otherwise(F.lit(1)).cast("int")
    numbered = counted.withColumn(parts_col, parts).withColumn(i, F.explode(F.sequence(F.lit(0), F.col(parts_col) - 1)))
    first = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    salt = F.when(is_hot, F.pmod(first + F.col(i), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    dealt = F.floor((F.col(whole) + F.col(parts_col) - 1 - F.col(i)) / F.col(parts_col))
    return numbered.select(*df.columns, salt.alias("_salt"), dealt.alias("_n"))


def channel_sales(direct_items: DataFrame, marketplace: DataFrame) -> DataFrame:
    """Units and amount per product in both channels, which share nothing but the product.

    Each side is reduced to one row per product first, so the outer join cannot multiply rows.
    """

    def per_product(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("product_id").agg(
            F.sum("units").alias(f"{prefix}_units"), F.sum("amount").alias(f"{prefix}_amount")
        )

    both = per_product(direct_items, "direct").join(
        per_product(marketplace, "marketplace"), "product_id", "full_outer"
    )
    names = [f"{p}_{m}" for p in ("direct", "marketplace") for m in ("units", "amount")]
    return both.select(
        "product_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    )


def diff_tables(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that differ between two tables: only_left, only_right or changed, with the columns."""
    rest = [c for c in left.columns if c not in keys and c in right.columns]
    a = left.select(*keys, *rest, F.lit(True).alias("_here")).alias("a")
    b = right.select(*keys, *rest, F.lit(True).alias("_here")).alias("b")
    both = a.join(b, list(keys), "full_outer")
    changed: list[Column] = [
        F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in rest
    ]
    kind = (
        F.when(F.col("b._here").isNull(), F.lit("only_left"))
        .when(F.col("a._here").isNull(), F.lit("only_right"))
        .when(
            ~same([F.col(f"a.{c}") for c in rest], [F.col(f"b.{c}") for c in rest]),
            F.lit("changed"),
        )
    )
    cols = F.when(F.col("kind") == "changed", F.array_compact(F.array(*changed))) if changed else F.lit(None)
    return (
        both.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(*keys, "kind", cols.alias("changed_columns"))
    )
