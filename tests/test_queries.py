"""Every query of the engine against its SQL, or that it runs where SQL has no say."""

import pytest

from galeframe.plans import assembly, distributions, evaluation, files, formats, learning, services
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"
ALL = {k: (f, m.ORACLES.get(k)) for m in (distributions, assembly, evaluation, learning, files, formats, services) for k, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if sql))
def test_same_as_sql(spark, con, name):
    f, sql = ALL[name]
    assert_same(f(spark, SF), con, sql)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if not sql))
def test_runs(spark, name):
    assert ALL[name][0](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = distributions.q27_adjacent_equals(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan
    pushed = evaluation.q31_runs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in pushed
