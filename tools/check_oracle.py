"""Run registered queries on Spark and their SQL on DuckDB and compare every value.

A plan with a product or nested-loop join fails too.

    python tools/check_oracle.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return f"{type(value).__name__}:{value}"


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose Spark and DuckDB types do not correspond."""
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name} {kind}/{want[name]}" for name, kind in df.dtypes
        if name in want and TYPES.get(kind, kind) != want[name]
    ]


def compare(spark, con, query, sf: str) -> tuple[bool, str, float]:
    start = time.time()
    df = query.run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return False, "the plan multiplies rows without a key", took
    if query.sql is None:
        return True, f"{len(got)} rows, no SQL", took
    odd = type_differences(df, con, query.sql)
    if odd:
        return False, f"types {odd}", took
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of(names, want)
    if a_names != b_names:
        return False, f"columns {a_names} / {b_names}", took
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}", took
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(bad)} rows differ, first {a_names}: {bad[0][0]} / {bad[0][1]}", took
    return True, f"{len(a)} rows", took


def session(cpus: int = 8):
    from dayslice.session import build_session

    return build_session(
        "check",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.session.timeZone": "UTC",
        },
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from workload import all_queries

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    failed, total = [], 0.0
    for name, query in all_queries().items():
        if args.names and name not in args.names:
            continue
        try:
            ok, note, took = compare(spark, con, query, args.sf)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        total += took
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{total:.1f}s, failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
