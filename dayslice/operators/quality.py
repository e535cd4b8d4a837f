"""Expectation suites and the gate in front of a load.

A suite is a list of rules, each {"expectation_type": ..., "kwargs": {...}}. All rules on
single rows are counted in one pass over the table; only uniqueness needs its own shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QualityError
from ..functions.columns import count_if

Rule = Mapping[str, object]

# The rule names a suite file uses.
ROW_COUNT = "expect_table_row_count_to_be_between"
EXISTS = "expect_column_to_exist"
NOT_NULL = "expect_column_values_to_not_be_null"
BETWEEN = "expect_column_values_to_be_between"
UNIQUE = "expect_column_values_to_be_unique"


def load_suite(text: str) -> list[Rule]:
    """Rules of a suite file: either a list, or an object with `expectations`."""
    doc = json.loads(text)
    return list(doc["expectations"] if isinstance(doc, dict) else doc)


def _result(name: str, column: str, success: Column, unexpected: Column, seen: Column) -> Column:
    pct = F.when(seen > 0, unexpected * F.lit(100.0) / seen)
    return F.struct(
        F.lit(name).alias("expectation"),
        F.lit(column).alias("column"),
        success.alias("success"),
        unexpected.cast("bigint").alias("unexpected"),
        pct.cast("double").alias("unexpected_percent"),
    )


def _outside(col: Column, lo: object, hi: object) -> Column:
    tests = []
    if lo is not None:
        tests.append(col < F.lit(lo))
    if hi is not None:
        tests.append(col > F.lit(hi))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _uniqueness(df: DataFrame, column: str) -> DataFrame:
    copies = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    totals = copies.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("_bad"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_seen"),
    )
    bad, seen = F.col("_bad"), F.col("_seen")
    return totals.select(_result(UNIQUE, column, bad == 0, bad, seen).alias("r")).select("r.*")


def run_suite(df: DataFrame, suite: Sequence[Rule]) -> DataFrame:
    """One result row per rule: expectation, column, success, unexpected, unexpected_percent.

    A rule on an absent column fails with the whole table counted as unexpected. Ranges and
    uniqueness ignore NULL, and their percentage is of the non-NULL rows.
    """
    aggs: list[Column] = [F.count("*").alias("n_rows")]
    results: list[Column] = []
    separate: list[DataFrame] = []
    rows = F.col("n_rows")
    for i, rule in enumerate(suite):
        name = str(rule["expectation_type"])
        kwargs = dict(rule.get("kwargs") or {})
        column = str(kwargs.get("column", "-"))
        if name == ROW_COUNT:
            bad = _outside(rows, kwargs.get("min_value"), kwargs.get("max_value"))
            results.append(_result(name, column, ~bad, bad.cast("bigint"), F.lit(None).cast("bigint")))
            continue
        present = column in df.columns
        if name == EXISTS:
            results.append(
                _result(name, column, F.lit(present), F.lit(0 if present else 1), F.lit(None).cast("bigint"))
            )
        elif not present:
            results.append(_result(name, column, F.lit(False), rows, rows))
        elif name == NOT_NULL:
            aggs.append(count_if(F.col(column).isNull()).alias(f"bad_{i}"))
            results.append(_result(name, column, F.col(f"bad_{i}") == 0, F.col(f"bad_{i}"), rows))
        elif name == BETWEEN:
            outside = _outside(F.col(column), kwargs.get("min_value"), kwargs.get("max_value"))
            aggs.append(count_if(outside).alias(f"bad_{i}"))
            aggs.append(F.count(F.col(column)).alias(f"seen_{i}"))
            results.append(
                _result(name, column, F.col(f"bad_{i}") == 0, F.col(f"bad_{i}"), F.col(f"seen_{i}"))
            )
        elif name == UNIQUE:
            separate.append(_uniqueness(df, column))
        else:
            raise ValueError(f"unknown expectation {name}")
    parts = list(separate)
    if results:
        one = df.agg(*aggs)
        parts.insert(0, one.select(F.explode(F.array(*results)).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def gate(result: DataFrame) -> None:
    """Block the load when any rule failed, and name those rules. Reads one row per rule."""
    failed = result.where(~F.col("success")).select("expectation", "column").collect()
    if failed:
        names = ", ".join(sorted(f"{r['expectation']}({r['column']})" for r in failed))
        raise QualityError(f"{len(failed)} expectations failed: {names}")
