"""Every registered query against its SQL in DuckDB."""

import os

import pytest

from oracle import compare, connect
from strataflow.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
