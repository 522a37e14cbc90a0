"""Every registered query against its SQL, on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from opsmetrics.catalog import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


COSTLY = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas", "MapInArrow")


def check_plan(df):
    """No cross joins and no Python in any plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in COSTLY if word in plan]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con):
    status, _, detail = compare(name, spark, con, SF, QUERIES, ORACLES, check_plan)
    assert detail is None, f"{status}: {detail}"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_lists_the_catalogue():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
