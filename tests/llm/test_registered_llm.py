"""Registered text queries: those with SQL give its rows, the others one row per input row."""

import pytest

import __spark_entry__
from veilgraph.llm.queries import ORACLE, QUERIES
from workload import check

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(ORACLE))
def test_rows_of_sql(spark, con, name):
    found = check.compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert found["match"], found
    assert not found["types"], found


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_one_row_per_input_row(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    source = spark.read.parquet(f"{SF_DIR}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in source.select(key).collect())
