"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import duck, spark_rows, sql_rows

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry_points.queries().items() if k not in entry_points.LLM_QUERIES}
SQL = {k: v for k, v in entry_points.oracle_sql().items() if k not in entry_points.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = spark_rows(QUERIES[name](spark, SF)), sql_rows(con, SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert len(want[1]) > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "key" and df.count() > 0
