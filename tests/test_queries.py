"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from shelfgraph.plans import all_queries
from tests.compare import duck, run_duck, run_spark
from tests.conftest import SF

QUERIES, SQL = all_queries().QUERIES, all_queries().ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = run_spark(df)
    if name in SQL:
        assert got == run_duck(con, SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "type", "label"]
