"""Every registered report query against its DuckDB oracle, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, duckdb_views  # noqa: E402
from skywatch.registry import oracle_sql  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver test data not present")
    return duckdb_views(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, detail = compare(entry.queries()[name](spark, SF_DIR), con, ORACLES[name])
    assert ok, detail


def test_describe_table_lists_columns(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver test data not present")
    rows = [r.col_name for r in entry.queries()["describe_table"](spark, SF_DIR).collect()]
    assert rows[:10] == ["details", "datetime", "city", "state", "country", "shape", "summary",
                         "report_date", "posted_date", "month_count"]
