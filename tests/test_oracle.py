"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

from check_oracle import compare, duck
from workload import all_queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_its_sql(spark, con, name):
    ok, note, _ = compare(spark, con, all_queries()[name], SF)
    assert ok, note


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
