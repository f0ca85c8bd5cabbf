"""Steps whose cost grew by key or by column are held to plans and partitions that follow the rows."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from leaserisk.operators import ml as ML
from leaserisk.operators import prep as PP
from leaserisk.operators import warehouse as WH
from leaserisk.operators.search import partitions, run_search
from leaserisk.operators.windows import asof_lookup, tasks_for
from leaserisk.plans import ml_models as MM
from leaserisk.sources.merge import newest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_do_not_deal_rows_by_column(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.createDataFrame([(float(i % 17), i) for i in range(200)] + [(None, None)], "a double, b int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = PP.medians(df, ["a", "b"])
        assert "SortMergeJoin" not in _plan(got)
        assert got.first().asDict() == {"median_a": statistics.median([float(i % 17) for i in range(200)]), "median_b": 99.5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_column_statistics_take_nulls_and_name_no_column_in_an_aggregate(spark):
    rows = [(1.0, None, 5), (2.0, None, 5), (4.0, None, None), (None, None, 7)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    assert PP.columns_to_scale(df, ["a", "b", "c"]) == {"a": True, "b": False, "c": False}
    got = PP.fit_scaler(df, ["a", "b", "c"])
    assert got["b"] == (None, None)
    for c, own in (("a", [1.0, 2.0, 4.0]), ("c", [5.0, 5.0, 7.0])):
        assert abs(got[c][0] - statistics.mean(own)) < 1e-12 and abs(got[c][1] - statistics.pstdev(own)) < 1e-12
    long = PP._long(df, ["a", "b", "c"])
    assert sorted(tuple(r) for r in long.collect()) == [(0, 1.0), (0, 2.0), (0, 4.0), (2, 5.0), (2, 5.0), (2, 7.0)]


def test_held_rows_get_as_many_partitions_as_their_number_asks_for(spark, monkeypatch):
    monkeypatch.setattr(MM, "ROWS_PER_PARTITION", 10)
    df = spark.range(95).coalesce(1).withColumn("v", F.col("id") * 2.0)
    held = MM._held(df)
    try:
        assert held.rdd.getNumPartitions() == 10
        assert sorted(r.v for r in held.collect()) == [i * 2.0 for i in range(95)]
    finally:
        held.unpersist()


def test_newest_sorts_each_row_once_by_plain_keys(spark):
    day = dt.date(1999, 1, 1)
    rows = [(1, "a", day, 2.0), (1, "a", day, None), (1, "b", None, 9.0), (None, "x", None, 1.0), (None, "x", None, 3.0), (2, None, None, None)]
    df = spark.createDataFrame(rows, "k int, t string, d date, v double")
    assert sorted(map(tuple, newest(df, ["k", "t"], "d").collect()), key=str) == sorted(
        [(1, "a", day, 2.0), (1, "b", None, 9.0), (None, "x", None, 3.0), (2, None, None, None)], key=str)
    plan = _plan(newest(df, ["k", "t"], None))
    assert "max_by" not in plan and "max(struct(" in plan
    assert newest(df.select("k", "t"), ["k", "t"], None).count() == 4


def test_asof_lookup_sorts_no_scan_task_whole_and_deals_by_rows(spark):
    facts = spark.createDataFrame([(i, k, dt.date(1999, 1, 1 + i % 28)) for i in range(90) for k in (1, 2, 3)] + [(90, None, dt.date(1999, 1, 5)), (91, 1, None)],
                                  "id int, k int, d date")
    rows = [(1, dt.date(1998, 12, 31), "a"), (1, dt.date(1999, 1, 9), None), (1, dt.date(1999, 1, 20), "c"), (2, dt.date(1999, 1, 14), "z"), (None, dt.date(1999, 1, 1), "n"), (3, None, "never")]
    look = spark.createDataFrame(rows, "k int, at date, x string")

    def last(k, d):
        known = [(at, x) for key, at, x in rows if key == k and d is not None and at is not None and at <= d]
        return max(known, key=lambda r: r[0])[1] if known else None

    for parts in (None, 13):
        got = asof_lookup(facts, look, "k", "d", "at", ["x"], lambda c: c, parts)
        assert "SortAggregate" not in _plan(got)
        found = {(r.id, r.k): (r.d, r.x) for r in got.collect()}
        assert len(found) == 270 and all(x == last(k, d) for (_, k), (d, x) in found.items())
        assert parts is None or "hashpartitioning(k#" in _plan(got) and f", {parts})" in _plan(got)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(10 * n), 10) is None and tasks_for(spark.range(10 * n + 1), 10) == n + 1
    snap = spark.createDataFrame([(k, dt.date(1999, 1, d), h) for k in (1, 2) for d in (1, 3, 3, 9) for h in (d, d + 1)], "t int, on date, h int")
    same = [sorted(map(tuple, WH.scd2_from_history(snap, "t", "on", ["h"], p).collect())) for p in (None, 7)]
    assert same[0] == same[1] and len(same[0]) == 6


def test_training_rows_get_whole_waves_of_cores_and_folds_are_spread(spark, tmp_path):
    assert [partitions(n, 12) for n in (0, 50_001, 319_796, 3_197_975, 19_200_000)] == [1, 2, 7, 12, 48]
    assert partitions(3_197_975, 1) == 8 and partitions(500_000, 100) == 10


def test_search_deals_rows_evenly_not_by_fold(spark, tmp_path, monkeypatch):
    kept = {}

    def stop(features):
        raise RuntimeError("enough")

    rows = spark.range(350_000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"),
                                       F.lit(1.0).alias("weight"), (F.col("id") % 5).cast("int").alias("fold"))
    own = type(rows)
    real = own.persist
    monkeypatch.setattr(own, "persist", lambda df, *level: kept.setdefault("rows", real(df, *level)))
    monkeypatch.setattr(own, "unpersist", lambda df, *block: kept.update(
        sizes=[r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]))
    monkeypatch.setattr(ML, "assembler", stop)
    with pytest.raises(RuntimeError, match="enough"):
        run_search(rows, [{}], ML.gbt, str(tmp_path / "ledger"), ["x"], parallelism=1)
    monkeypatch.undo()
    kept["rows"].unpersist()
    assert len(kept["sizes"]) == 7 and max(kept["sizes"]) < 1.1 * min(kept["sizes"])


def test_held_rows_fill_every_partition_whatever_their_files(spark, monkeypatch):
    df = spark.range(4_000).coalesce(1).withColumn("v", F.col("id") * 2.0)
    sizes = lambda d: [r["n"] for r in d.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    monkeypatch.setattr(MM, "ROWS_PER_PARTITION", 2_000)
    monkeypatch.setattr(MM, "_stored", lambda d, name: d.repartition(3, F.lit(1)))
    held = MM._held(df)  # three partitions, one of them with rows
    try:
        assert sorted(sizes(held)) == [2_000, 2_000]
    finally:
        held.unpersist()
