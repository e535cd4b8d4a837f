"""One local session for all tests, and small fixtures."""

from __future__ import annotations

import datetime as dt
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from dayslice.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *cols) -> list[tuple]:
    """Rows as a sorted list of tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple(str(v) for v in t))


@pytest.fixture(scope="session")
def six_orders(spark):
    return spark.createDataFrame(
        [
            (1, 101, "Alice", 100.0, d("2026-01-15")),
            (2, 102, "Bob", 200.0, d("2026-01-15")),
            (3, 103, "Carol", 50.0, d("2026-01-15")),
            (4, None, None, 42.0, d("2026-01-15")),
            (5, 104, "Dan", -15.0, d("2026-01-15")),
            (6, 105, "Eve", 80.0, d("2026-01-16")),
        ],
        "order_id bigint, customer_id int, customer_name string, amount double, order_date date",
    )
