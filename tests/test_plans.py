"""Physical-plan guard: no cartesian / nested-loop joins, no row-at-a-time
Python UDFs, no unbounded single-partition windows or sorts."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.plan_audit import audit

ORACLES = E.oracle_sql()
QUERIES = E.queries()
# stream / model runners execute jobs while they are built; they are covered elsewhere
NAMES = sorted(n for n in ORACLES if not n.startswith("t0"))


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_scale_antipatterns(spark, name):
    assert audit(name, QUERIES[name](spark, SF_SMALL)) == []


def test_window_filter_reaches_parquet(spark):
    df = QUERIES["p03_renewal_risk_by_neighborhood"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
