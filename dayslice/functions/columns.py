"""Small column expressions shared by operators and marts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base risk per payment type, used by risk_score.
RISK_BASE: dict[str, float] = {
    "credit_card": 30.0,
    "debit_card": 10.0,
    "voucher": 5.0,
    "boleto": 15.0,
}

SETTLEMENT_DAYS = 15


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(ds: str | dt.date) -> Column:
    """A typed date literal. Cast the literal, never the column, so filters push down."""
    value = ds if isinstance(ds, dt.date) else dt.date.fromisoformat(ds)
    return F.lit(value)


def shift(ds: str | dt.date, days: int) -> dt.date:
    """Calendar arithmetic on a run date."""
    value = ds if isinstance(ds, dt.date) else dt.date.fromisoformat(ds)
    return value + dt.timedelta(days=days)


def money(c: Column | str) -> Column:
    """Exact two-digit amount; sums of it do not depend on row order."""
    return as_col(c).cast("decimal(18,2)")


def exact(c: Column | str) -> Column:
    """An amount with the digits it has; sums of it do not depend on row order."""
    return as_col(c).cast("decimal(28,6)")


def total(c: Column | str) -> Column:
    """Sum of amounts, rounded to two digits once, after the sum."""
    return F.sum(exact(c)).cast("decimal(28,2)")


def half_up(c: Column | str, digits: int) -> Column:
    """Round a double half up by plain arithmetic, so that other engines agree."""
    scale = 10.0**digits
    return F.floor(as_col(c).cast("double") * scale + 0.5) / scale


def safe_ratio(num: Column | str, den: Column | str, digits: int = 4) -> Column:
    """num / den rounded, and 0.0 where the denominator is not positive or missing."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    return F.when(d > 0, half_up(n / d, digits)).otherwise(F.lit(0.0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Unrounded num / den, and NULL where the denominator is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def count_if(cond: Column) -> Column:
    """Rows for which the condition is true; NULL counts as false."""
    return F.count(F.when(cond, F.lit(1)))


def sum_or_zero(c: Column | str) -> Column:
    """Sum that is 0 rather than NULL on an empty slice."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def date_key(d: Column | str, sequence: Column | str, slots: int = 1_000_000) -> Column:
    """Integer key YYYYMMDD * slots + sequence."""
    stamp = F.date_format(as_col(d), "yyyyMMdd").cast("bigint")
    return stamp * F.lit(slots) + as_col(sequence).cast("bigint")


def settlement_date(d: Column | str, days: int = SETTLEMENT_DAYS) -> Column:
    """Date on which a partner pays out a sale."""
    return F.date_add(as_col(d), days)


def tier(c: Column | str, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open bucket a number falls in; NULL stays NULL."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("a tier needs one label more than bounds")
    value = as_col(c)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels):
        out = out.when(value < F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def risk_score(
    payment_type: Column | str,
    installments: Column | str,
    value: Column | str,
    base: Mapping[str, float] = RISK_BASE,
) -> Column:
    """Payment risk as one expression inside generated code, with no Python worker."""
    table = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    start = F.coalesce(F.try_element_at(table, as_col(payment_type)), F.lit(0.0))
    size = F.coalesce(as_col(value).cast("double"), F.lit(0.0))
    return start + as_col(installments).cast("double") * 2.0 + size * 0.01


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Row-value equality that treats NULL as a value."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def window_filter(ts: Column | str, lo: Column, hi: Column) -> Column:
    """Half-open interval test lo <= ts < hi."""
    c = as_col(ts)
    return (c >= lo) & (c < hi)


def json_row(*columns: str) -> Column:
    """One JSON text per row built from the named columns."""
    return F.to_json(F.struct(*columns))
