"""The corpus queries against their DuckDB SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracles import compare, duckdb_views  # noqa: E402
from skywatch.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver test data not present")
    return duckdb_views(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, detail = compare(queries.QUERIES[name](spark, SF_DIR), con, queries.ORACLES[name])
    assert ok, detail
