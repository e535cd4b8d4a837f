"""Projection, filtering, validation and set operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, count_if, day, window_filter


def select_known(df: DataFrame, known: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Keep the agreed columns that are present, in the agreed order, and drop the rest."""
    return df.select([c for c in known if c in df.columns] + list(extra))


def normalize_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast id columns to text, so that an id that turns from number to text still joins."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols if c in df.columns})


def in_domain(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Rows whose value is one of the allowed ones; NULL is not."""
    return df.where(F.col(col).isin(list(values)))


def on_day(df: DataFrame, col: str, ds: str | dt.date) -> DataFrame:
    """One date slice. The column stays bare, so partitions and row groups are pruned."""
    return df.where(F.col(col) == day(ds))


def in_window(df: DataFrame, ts: str, lo: Column, hi: Column) -> DataFrame:
    """Rows with lo <= ts < hi."""
    return df.where(window_filter(ts, lo, hi))


def valid_order(min_amount: float = 0.0, inclusive: bool = True) -> Column:
    """Condition a raw order meets to be loaded: customer known, amount known and large enough."""
    amount = F.col("amount")
    enough = amount >= min_amount if inclusive else amount > min_amount
    return F.col("customer_id").isNotNull() & amount.isNotNull() & enough


def validate_orders(
    df: DataFrame,
    ds: str | dt.date | None = None,
    min_amount: float = 0.0,
    inclusive: bool = True,
) -> DataFrame:
    """Bronze to silver for orders: the run date's valid rows, or every date's without `ds`."""
    sliced = df if ds is None else on_day(df, "order_date", ds)
    return sliced.where(valid_order(min_amount, inclusive))


def stamp_valid(df: DataFrame, ds: str) -> DataFrame:
    """Valid rows with the run date, not the clock, as processing stamp."""
    return df.where(valid_order(0.0, inclusive=False)).withColumn("processed_at", F.lit(ds))


def with_reasons(df: DataFrame, rules: Mapping[str, Column], out: str = "reasons") -> DataFrame:
    """Add the names of all rules a row breaks. A rule that yields NULL counts as broken."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def split_valid(
    df: DataFrame, rules: Mapping[str, Column], out: str = "reasons"
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reasons. No row is lost between the two."""
    marked = with_reasons(df, rules, out)
    return marked.where(F.size(out) == 0).drop(out), marked.where(F.size(out) > 0)


def flag_order_anomalies(orders: DataFrame) -> DataFrame:
    """Mark, but keep, orders with an unexplained free delivery or an oversized discount."""
    return orders.withColumns(
        {
            "is_zero_shipping": F.coalesce(
                (F.col("shipping_fee") == 0) & F.col("voucher_code").isNull(), F.lit(False)
            ),
            "is_over_discounted": F.coalesce(
                F.col("discount_amount") > F.col("subtotal"), F.lit(False)
            ),
        }
    )


def flag_item_anomalies(items: DataFrame) -> DataFrame:
    """Mark lines that were cancelled by setting their quantity to zero."""
    return items.withColumn(
        "is_cancelled_line", F.coalesce(F.col("quantity") == 0, F.lit(False))
    )


def flag_products(products: DataFrame) -> DataFrame:
    """Mark products whose cost is above their list price."""
    return products.withColumn(
        "is_loss_making", F.coalesce(F.col("cost_price") > F.col("base_price"), F.lit(False))
    )


def flag_customers(customers: DataFrame) -> DataFrame:
    """Mark customers without a phone; the row is valid and stays."""
    return customers.withColumn("has_no_phone", F.col("phone").isNull())


def count_where(df: DataFrame, cond: Column, out: str = "n") -> DataFrame:
    """How many rows meet a condition, as one row that shows none of them."""
    return df.agg(count_if(cond).alias(out))


def union_evolving(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name over frames of different age; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left`, with multiplicity, that `right` does not hold."""
    return left.exceptAll(right.select(left.columns))


def table_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that both tables hold."""
    return left.intersectAll(right.select(left.columns))


def coverage(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows and non-null rows per column for each slice, in one pass."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.count(F.col(c)).alias(f"{c}_present") for c in cols],
    )


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in an order: each task keeps k rows, and only those are merged."""
    return df.orderBy(*by).limit(k)


def rollup_sum(df: DataFrame, dims: Sequence[str], value: Column | str, out: str) -> DataFrame:
    """Sub-totals along a hierarchy; a rolled-up dimension shows as the text ALL."""
    rolled = df.rollup(*dims).agg(
        F.sum(as_col(value)).alias(out),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    names = [
        F.when(F.col(f"_g_{d}") == 1, F.lit("ALL")).otherwise(F.col(d).cast("string")).alias(d)
        for d in dims
    ]
    return rolled.select(*names, out)
