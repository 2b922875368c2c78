"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name not in SQL:
        assert fn(spark, SF_DIR).collect()
    else:
        assert compare(spark, con, SF_DIR, name, fn, SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
