"""Every query with an oracle matches DuckDB on sf0.001 (row count, column
names, order-insensitive values)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.check import digest

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["neighborhood", "leases", "high_risk", "medium_risk", "low_risk", "avg_risk_score",
                          "rent_at_risk"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLES[name])
    o_cols, o_rows = list(rel.columns), rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert digest(s_cols, s_rows)[0] == digest(o_cols, o_rows)[0]
