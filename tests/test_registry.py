"""The registry: names follow `<id>_<slug>`, every oracle has a query, and
oracle SQL reads only the driver's pre-registered views."""

import re

import __spark_entry__ as E

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_names_follow_id_slug_convention():
    for name in QUERIES:
        assert re.fullmatch(r"([a-z]\d{2}|f|e\d|op\d+)_[a-z0-9_]+|pipeline", name), name


def test_oracles_pair_with_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 130


def test_oracle_sql_reads_only_registered_views():
    for name, sql in ORACLES.items():
        low = sql.lower()
        assert "read_parquet" not in low and "/root/" not in low, name
