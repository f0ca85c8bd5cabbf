"""Scoring runs follow from the leases: no run is lost on old data."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from leaserisk.operators import predictions as PR
from leaserisk.sources.driver import domain
from tools.check import digest


@pytest.fixture(scope="module")
def old_data(tmp_path_factory):
    """The small tables, every other order 15 years earlier."""
    path = tmp_path_factory.mktemp("old")
    for name in os.listdir(SF_SMALL):
        if name != "orders.parquet":
            os.symlink(f"{SF_SMALL}/{name}", path / name)
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 15 YEAR ELSE o_orderdate END
                                            AS o_orderdate) FROM read_parquet('{SF_SMALL}/orders.parquet'))
                    TO '{path}/orders.parquet' (FORMAT parquet)""")
    for name in os.listdir(path):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}/{name}')")
    return str(path), con


@pytest.mark.parametrize("name", ["w01_latest_prediction", "r01_lease_latest_prediction", "d08_prediction_fact", "j15_unpredicted_active"])
def test_leases_of_1980_are_scored(spark, old_data, name):
    path, con = old_data
    df = E.queries()[name](spark, path)
    rel = con.sql(E.oracle_sql()[name])
    rows = [tuple(r) for r in df.collect()]
    assert digest(df.columns, rows)[0] == digest(list(rel.columns), rel.fetchall())[0]
    if name == "w01_latest_prediction":
        assert min(r[df.columns.index("prediction_date")] for r in rows) < "1983"


def test_newest_run_alone_equals_the_latest_of_the_history(spark, old_data):
    dom = domain(spark, old_data[0])
    a, b = PR.latest_of(dom), PR.latest_predictions(PR.prediction_history(dom))
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_runs_of_a_window(spark):
    day = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(PR.runs_between(day("1980-01-01"), day("1980-03-01")).alias("a"),
                                PR.runs_between(day("1980-01-02"), day("1980-03-02")).alias("b"),
                                PR.runs_between(day("1980-01-02"), day("1980-02-01")).alias("c")).first()
    assert row["a"] == [dt.date(1980, 1, 1), dt.date(1980, 2, 1)]
    assert row["b"] == [dt.date(1980, 2, 1), dt.date(1980, 3, 1)] and row["c"] == []


def test_market_of_a_run_is_the_newest_row_up_to_it(spark):
    dom = domain(spark, SF_SMALL)
    market = dom.market_data().filter("month(data_date) % 5 <> 2")
    last = dt.date(1996, 6, 1)
    got = PR.market_for_runs(market, last=last)
    pairs = got.select("zip_code", "run_date").alias("p").join(market.alias("m"), F.expr(
        "p.zip_code = m.zip_code AND m.data_date <= p.run_date")).groupBy("p.zip_code", "run_date").agg(F.max("data_date").alias("data_date"))
    assert got.select("zip_code", "run_date", "data_date").exceptAll(pairs).isEmpty()
    assert got.count() == 25 * 18 and got.agg(F.max("run_date")).first()[0] == last
