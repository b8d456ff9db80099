"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tools import check  # noqa: E402

SMALL = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")


@pytest.fixture(scope="module")
def oracle():
    return check.oracle(SMALL)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    status, _, _, note = check.compare(spark, oracle, SMALL, name, contract.queries()[name], contract.oracle_sql()[name])
    assert status == "ok", note


def test_entry(spark):
    frame = contract.entry(spark)
    assert set(frame.columns) == {"query_id", "row_id", "score", "rank"}
    assert frame.count() > 0
