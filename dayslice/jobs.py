"""Command line of the daily runs, for spark-submit.

    spark-submit dayslice/jobs.py orders --ds 2026-01-15 --raw s3a://landing/orders --root s3a://lake
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayslice.functions.columns import day
from dayslice.operators import layout
from dayslice.plans import pipelines
from dayslice.session import build_session
from dayslice.sources import catalog, readers

RUNS = {
    "orders": pipelines.run_orders_day,
    "ads": pipelines.run_ads_day,
    "marketplace": pipelines.run_marketplace_day,
    "customers": pipelines.run_customers_day,
    "campaigns": pipelines.run_campaigns_day,
}


#: Columns that say which day a row of a landed table belongs to.
SLICE_COLUMNS = {
    "orders": ("order_date",),
    "ads": ("event_date", "event_ts"),
    "marketplace": ("order_date", "order_ts"),
    "customers": ("ingested_at",),
    "campaigns": ("date", "event_ts"),
}


#: Columns of landed CSV files by job. Nothing is guessed from the values, so an id keeps its leading zeros.
CONTRACTS = {
    "orders": "order_id bigint, customer_id int, customer_name string, amount double, order_date date",
    "ads": ", ".join(f"{name} {kind}" for name, kind in pipelines.AD_CONTRACT.items()),
    "marketplace": pipelines.MARKETPLACE_ORDERS,
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="dayslice")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in RUNS:
        run = jobs.add_parser(name, help=f"run {name} for one date")
        run.add_argument("--ds", required=True, help="run date YYYY-MM-DD")
        run.add_argument("--raw", required=True, help="landing folder, or table for --format parquet")
        run.add_argument("--root", required=True, help="folder of the layers")
        run.add_argument("--format", choices=("csv", "json", "parquet"), default="csv")
        run.add_argument("--schema", default=CONTRACTS.get(name), help="columns of a CSV file as DDL; default the contract of the job, if it has one")
        run.add_argument("--at", default=None, help="time for the access trail; default the run date")
    query = jobs.add_parser("query", help="look into a table")
    query.add_argument("path")
    query.add_argument("--format", default="parquet")
    query.add_argument("--where")
    query.add_argument("--columns", help="comma separated")
    query.add_argument("--limit", type=int, default=10)
    query.add_argument("--sql", help="SELECT over the alias tbl")
    query.add_argument("--count", action="store_true")
    query.add_argument("--describe", action="store_true")
    stats = jobs.add_parser("file-stats", help="files, bytes and rows of a table")
    stats.add_argument("path")
    compact = jobs.add_parser("compact", help="rewrite small files into a new folder")
    compact.add_argument("path")
    compact.add_argument("out")
    compact.add_argument("--target-mb", type=int, default=128)
    compact.add_argument("--part", help="partition column")
    return parser


def _raw(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.format == "csv":
        if args.schema is None:
            raise SystemExit(f"dayslice {args.job}: give --schema for CSV files, or land JSON or Parquet")
        return readers.read_csv_day(spark, args.raw, args.ds, args.schema)
    if args.format == "json":
        return spark.read.json(f"{args.raw}/{args.ds}.json")
    table = spark.read.parquet(args.raw)
    # A table of many days: the filter reaches the scan.
    dates = [c for c in SLICE_COLUMNS[args.job] if c in table.columns]
    return table.where(F.col(dates[0]).cast("date") == day(args.ds)) if dates else table


def run(spark: SparkSession, argv: Sequence[str]) -> DataFrame:
    """Execute one command and return what it reports."""
    args = _parser().parse_args(argv)
    if args.job in RUNS:
        extra = {"at": args.at or f"{args.ds}T00:00:00Z"} if args.job == "customers" else {}
        return RUNS[args.job](spark, _raw(spark, args), args.root, args.ds, **extra)
    if args.job == "file-stats":
        return layout.file_stats(spark.read.parquet(args.path))
    if args.job == "compact":
        return layout.compact(spark, args.path, args.out, args.target_mb, args.part)
    table = readers.read_table(spark, args.path, args.format)
    if args.describe:
        return catalog.describe_table(table)
    if args.count:
        return table.groupBy().count()
    columns = args.columns.split(",") if args.columns else None
    limit = None if args.sql else args.limit
    return catalog.query_table(table, args.where, columns, limit, args.sql)


def main(argv: Sequence[str] | None = None) -> None:
    spark = build_session("dayslice")
    try:
        run(spark, sys.argv[1:] if argv is None else argv).show(100, truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
