"""Every registered query gives the rows of its SQL on the smallest tables."""

import pytest

import __spark_entry__
from workload import check

SF_DIR = "/root/testdata/sf0.001"
# Text queries have tests of their own.
QUERIES = {name: fn for name, fn in __spark_entry__.queries().items() if name in __spark_entry__.GRAPH_QUERIES}
SQL = {name: sql for name, sql in __spark_entry__.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


def test_each_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows(spark, con, name):
    found = check.compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert found["match"], found
    assert not found["types"], found


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
