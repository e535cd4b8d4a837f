"""Registered queries: each operator run over whole tables, with the SQL that must agree."""

from . import daily, deduping, files, loads, marts, reports, shaping, streaming, trust, versions  # noqa: F401
from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    """Every registered query by name."""
    return dict(QUERIES)
