import duckdb
import pytest

import __spark_entry__ as entry
from chainloom.plans import catalog

from tests.compare import compared, views

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return views(duckdb.connect(), small)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    if name in SQL:
        compared(df, duck.sql(SQL[name]))
    else:
        assert df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_what_the_flagship_needs(spark, small):
    plan = catalog.queries()["combo_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in plan
    assert "o_orderkey" not in plan


def test_filters_reach_the_scan(spark, small):
    plan = catalog.queries()["filter_in_list"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_returnflag, [A,R])" in plan
