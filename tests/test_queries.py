import math
import os

import pytest

import __spark_entry__ as entry
from gramlake.queries import oracle_sql, queries
from tests.oracle import both, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
#: Queries without SQL that fit many times: their operators run on small tables in test_closed.py.
SLOW = {"tree_ensembles", "quantile_regression", "mixed_intercepts"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ours, theirs = both(spark, con, DATA, queries()[name], oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_gives_finite_rows(spark, name):
    """Queries without SQL: rows, and no NaN or infinity in them; their values are held in test_closed.py."""
    rows = queries()[name](spark, DATA).collect()
    assert rows
    for r in rows:
        assert all(not isinstance(v, float) or math.isfinite(v) for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(oracle_sql()) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_do_not_shuffle_twice(spark):
    plan = queries()["ols_grouped"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_returnflag:string>" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    plan = queries()["date_range_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan and "Exchange" not in plan
