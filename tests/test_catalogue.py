"""Every query with SQL gives the SQL's rows; every other query runs."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, rows_of_spark, rows_of_sql

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
ALL = entry.queries()
# fixed ids and thresholds of the larger table leave nothing to compare here
CORE = [n for n in ALL if not ALL[n].__module__.startswith("pathloom.llm")]


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    got = rows_of_spark(ALL[name](spark, D))
    if name in SQL:
        assert got == rows_of_sql(con, SQL[name])
    else:
        assert got[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
