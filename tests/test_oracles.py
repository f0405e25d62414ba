"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from lotframe.catalog import ORACLES, QUERIES

from check_oracles import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF_DIR, QUERIES[name], ORACLES.get(name)) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
