"""Reconciliation.

A check names the figures it needs from each table and how to judge them. `evaluate` takes
any number of checks and reads each table once: all figures of a table are one aggregation,
and only the resulting single rows are combined. The answer has one row per check:
check_name, passed, expected, observed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReconcileError
from ..functions.columns import as_col, count_if, day, shift, sum_or_zero
from .dedup import keep_latest
from .joins import orphans

Figure = Callable[[str], Column]
Judge = Callable[[Figure], tuple[Column, Column, Column]]


@dataclass(frozen=True)
class Check:
    """Figures per table, and a judge that turns them into (passed, expected, observed)."""

    name: str
    figures: Sequence[tuple[DataFrame, Mapping[str, Column]]]
    judge: Judge


def scalars(**frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side in one row.

    The rows are stacked with NULLs and folded by `max`, which needs no join. Column names
    must not repeat between the frames.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values()
    )
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def evaluate(*checks: Check) -> DataFrame:
    """One row per check. Checks that share a table (the same frame object) share its scan."""
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}
    rows: list[Column] = []
    for i, check in enumerate(checks):
        for df, figures in check.figures:
            wanted = tables.setdefault(id(df), (df, []))[1]
            wanted += [agg.alias(f"c{i}_{name}") for name, agg in figures.items()]
        passed, expected, observed = check.judge(lambda name, i=i: F.col(f"c{i}_{name}"))
        rows.append(
            F.struct(
                F.lit(check.name).alias("check_name"),
                F.coalesce(passed, F.lit(False)).alias("passed"),
                expected.cast("double").alias("expected"),
                observed.cast("double").alias("observed"),
            )
        )
    singles = {f"t{i}": df.agg(*aggs) for i, (df, aggs) in enumerate(tables.values())}
    return scalars(**singles).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _equal(a: str, b: str) -> Judge:
    return lambda f: (f(a) == f(b), f(a), f(b))


def _none(name: str) -> Judge:
    return lambda f: (f(name) == 0, F.lit(0), f(name))


def recon_count(src: DataFrame, tgt: DataFrame, name: str = "count_match") -> Check:
    """Source and target hold the same number of rows."""
    rows = F.count(F.lit(1))
    return Check(name, [(src, {"src": rows}), (tgt, {"tgt": rows})], _equal("src", "tgt"))


def recon_sum(
    src: DataFrame, tgt: DataFrame, col: str, tolerance: float = 0.0, name: str = "sum_match"
) -> Check:
    """A sum agrees to two digits, within a tolerance. Sums are exact decimals."""
    total = F.round(sum_or_zero(F.col(col).cast("decimal(28,6)")), 2)

    def judge(f: Figure) -> tuple[Column, Column, Column]:
        return F.abs(f("src") - f("tgt")) <= F.lit(tolerance), f("src"), f("tgt")

    return Check(name, [(src, {"src": total}), (tgt, {"tgt": total})], judge)


def recon_rollup(src: DataFrame, tgt: DataFrame, count_col: str, name: str = "rollup_match") -> Check:
    """Detail rows equal the sum of the counts in a rollup."""
    return Check(
        name,
        [(src, {"src": F.count(F.lit(1))}), (tgt, {"tgt": sum_or_zero(count_col)})],
        _equal("src", "tgt"),
    )


def recon_dod(
    fact: DataFrame,
    date_col: str,
    ds: str | dt.date,
    max_drift: float = 0.5,
    exclude: Sequence[str | dt.date] = (),
    name: str = "dod_ok",
) -> Check:
    """The day's rows stay within a share of the day before. A first day passes.

    Days in `exclude`, such as sales events, are no baseline: the run date then passes when
    it or its previous day is one of them. The check filters its two days, so a table
    partitioned by date is read for those only.
    """
    previous = shift(ds, -1)
    exempt = bool({shift(d, 0) for d in exclude} & {previous, shift(ds, 0)})
    two = fact.where(F.col(date_col).isin([previous, shift(ds, 0)]))
    figures = {
        "today": count_if(F.col(date_col) == day(ds)),
        "prior": count_if(F.col(date_col) == day(previous)),
    }

    def judge(f: Figure) -> tuple[Column, Column, Column]:
        near = F.abs(f("today") - f("prior")) <= F.lit(max_drift) * f("prior")
        return F.lit(exempt) | (f("prior") == 0) | near, f("prior"), f("today")

    return Check(name, [(two, figures)], judge)


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> Check:
    """Rows equal distinct keys. Grouping merges copies before the shuffle."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return Check(
        name, [(groups, {"rows": sum_or_zero("_n"), "keys": F.count("*")})], _equal("keys", "rows")
    )


def check_no_tombstone(
    tgt: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    op: str = "op",
    delete: str = "D",
    name: str = "no_tombstone",
) -> Check:
    """No key whose last change is a delete is left in the target."""
    dead = keep_latest(changes, key, order).where(F.col(op) == delete)
    left = tgt.join(dead.select(*key), list(key), "left_semi")
    return Check(name, [(left, {"n": F.count(F.lit(1))})], _none("n"))


def violations(rules: Mapping[str, Column]) -> dict[str, Column]:
    """Aggregates: rows that break each rule, and rows that break any. NULL breaks no rule."""
    broken = {n: F.coalesce(~ok, F.lit(False)) for n, ok in rules.items()}
    any_broken = reduce(lambda a, b: a | b, broken.values())
    return {"bad_rows": count_if(any_broken), **{n: count_if(b) for n, b in broken.items()}}


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule and rows that break any, in one pass."""
    return df.agg(*[agg.alias(n) for n, agg in violations(rules).items()])


def check_rules(df: DataFrame, rules: Mapping[str, Column], name: str = "rules_ok") -> Check:
    """No row breaks a business rule."""
    return Check(name, [(df, {"bad": violations(rules)["bad_rows"]})], _none("bad"))


def recon_rules(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    amount: str,
    inclusive: bool = True,
    name: str = "rules_ok",
) -> Check:
    """Fact rows with a bad amount, no key, or a key that the dimension lacks: there are none.

    The fact is counted per key before the join, so that its rows are not shuffled for a dimension too large to broadcast.
    """
    value = F.col(amount)
    bad_amount = value < 0 if inclusive else value <= 0
    keys = dim.select(key).distinct().withColumn("_known", F.lit(True))
    counts = fact.groupBy(key).agg(F.count("*").alias("_rows"), count_if(bad_amount).alias("_bad"))
    lost = F.col(key).isNull() | F.col("_known").isNull()
    bad = F.when(lost, F.col("_rows")).otherwise(F.col("_bad"))
    return Check(name, [(counts.join(keys, key, "left"), {"bad": sum_or_zero(bad)})], _none("bad"))


def check_no_orphans(
    fact: DataFrame, dim: DataFrame, key: Sequence[str], name: str = "no_orphans"
) -> Check:
    """Every fact key exists in the dimension."""
    return Check(name, [(orphans(fact, dim, key), {"n": F.count(F.lit(1))})], _none("n"))


def recon_tieout(
    fact: DataFrame,
    agg: DataFrame,
    event_type: str,
    agg_col: str,
    type_col: str = "event_type",
    name: str = "tieout",
) -> Check:
    """Events of one type in the fact equal the sum over the aggregate."""
    return Check(
        name,
        [
            (fact, {"src": count_if(F.col(type_col) == event_type)}),
            (agg, {"tgt": sum_or_zero(agg_col)}),
        ],
        _equal("src", "tgt"),
    )


def check_activity_dim(
    dim: DataFrame,
    daily: DataFrame,
    key: str,
    ds: str | dt.date,
    date_col: str = "event_date",
    first_seen: str = "first_seen_date",
    last_active: str = "last_active_date",
    share: str = "latest_ctr",
) -> list[Check]:
    """An accumulated dimension: unique, complete up to the run date, ordered dates, share in [0, 1]."""
    known = daily.where(F.col(date_col) <= day(ds)).select(key).distinct()
    keys = dim.groupBy(key).agg(F.count("*").alias("_n"))
    late = count_if(F.col(first_seen) > F.col(last_active))
    outside = count_if((F.col(share) < 0) | (F.col(share) > 1))
    return [
        Check(
            "unique_key", [(keys, {"rows": sum_or_zero("_n"), "keys": F.count("*")})],
            _equal("keys", "rows"),
        ),
        Check("date_order", [(dim, {"bad": late})], _none("bad")),
        # Keys of later dates may be there, too: what counts is that none of history is missing.
        Check("complete", [(known.join(keys, key, "left_anti"), {"missing": F.count("*")})], _none("missing")),
        Check("share_range", [(dim, {"bad": outside})], _none("bad")),
    ]


def check_positive(df: DataFrame, col: str | None = None, name: str | None = None) -> Check:
    """The table has rows, or with a column, a sum above zero; catches a silently renamed column."""
    if col is None:
        return Check(
            name or "not_empty", [(df, {"v": F.count(F.lit(1))})], lambda f: (f("v") > 0, F.lit(1), f("v"))
        )
    return Check(
        name or f"positive_{col}", [(df, {"v": sum_or_zero(col)})], lambda f: (f("v") > 0, F.lit(0), f("v"))
    )


def check_source(df: DataFrame, name: str = "source_reachable") -> Check:
    """The source answers and holds at least one row; reads one row, not the table."""
    one = df.select(F.lit(1).alias("one")).limit(1)
    return Check(name, [(one, {"v": F.count("*")})], lambda f: (f("v") > 0, F.lit(1), f("v")))


def check_not_null(
    df: DataFrame,
    col: str,
    date_col: str | None = None,
    ds: str | dt.date | None = None,
    name: str | None = None,
) -> Check:
    """No NULL in a key column, for one run date or the whole table."""
    missing = as_col(col).isNull()
    if ds is not None:
        missing = missing & (F.col(date_col) == day(ds))
    return Check(name or f"not_null_{col}", [(df, {"n": count_if(missing)})], _none("n"))


def recon_channels(
    pairs: Mapping[str, tuple[DataFrame, DataFrame]], col: str, tolerance: float = 0.0
) -> list[Check]:
    """Source and mart totals agree for every sales channel."""
    return [recon_sum(s, t, col, tolerance, f"revenue_{c}") for c, (s, t) in pairs.items()]


def trace_layers(layers: Mapping[str, DataFrame], date_col: str, value: str) -> DataFrame:
    """Rows, non-NULL values and their sum per layer and date: where a bad number first appears."""
    parts = [
        df.groupBy(F.lit(name).alias("layer"), F.col(date_col).alias("day")).agg(
            F.count("*").alias("n_rows"),
            F.count(value).alias("n_values"),
            sum_or_zero(F.col(value).cast("decimal(28,6)")).alias("total"),
        )
        for name, df in layers.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_summary(
    checks: DataFrame, rows_per_layer: Mapping[str, int], ds: str, finished_at: str
) -> DataFrame:
    """What an operator on call needs: finish time, rows per layer, and each check's outcome.

    Row counts are those the sinks return, taken while writing.
    """
    spark = checks.sparkSession
    layers = spark.createDataFrame(
        [(f"rows_{n}", True, float(c), float(c)) for n, c in rows_per_layer.items()],
        "check_name string, passed boolean, expected double, observed double",
    )
    return layers.unionByName(checks).withColumns(
        {"run_date": F.lit(ds).cast("date"), "finished_at": F.lit(finished_at).cast("timestamp_ntz")}
    )


def require(checks: DataFrame) -> None:
    """Raise when any check failed, naming each with its two numbers."""
    failed = checks.where(~F.col("passed")).collect()
    if failed:
        told = "; ".join(
            f"{r['check_name']}: expected {r['expected']:g}, observed {r['observed']:g}"
            for r in sorted(failed, key=lambda r: r["check_name"])
        )
        raise ReconcileError(told)
