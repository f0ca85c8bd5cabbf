"""Sources / sinks: RAW ingestion, staging, document sync, CSV round trip."""

import datetime as dt

from pyspark.sql import functions as F

from leaserisk.session import scratch_path
from leaserisk.sources import io as IO


def test_ingest_bad_values_become_null(spark):
    raw = spark.createDataFrame([("1", "12.5"), ("x", "oops")], "k string, v string")
    rows = IO.ingest_raw(raw, {"k": "bigint", "v": "decimal(10,2)"}, "src").collect()
    assert rows[0].k == 1 and float(rows[0].v) == 12.5 and rows[1].k is None and rows[1].v is None
    assert all(r.source_system == "src" and r.ingested_at is not None for r in rows)


def test_stage_latest_version_and_quarantine(spark):
    df = spark.createDataFrame([(1, 1, "  A ", 5.0), (1, 2, "b", -1.0), (2, 1, "c", 3.0)],
                               "k long, ver long, name string, amount double")
    rows = {r.k: r for r in IO.stage(df, "k", "ver", [("positive", "amount > 0"), ("short", "length(name) < 9")],
                                     trim_lower=["name"]).collect()}
    assert (rows[2].name, rows[2].status, rows[2].broken) == ("c", "valid", [])
    assert (rows[1].ver, rows[1].name, rows[1].status, rows[1].broken) == (2, "b", "quarantine", ["positive"])


def _table_files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_merge_in_any_order_and_again_gives_one_table(spark, tmp_path):
    from itertools import permutations

    from leaserisk.sources import merge as MG

    schema = "k long, v int, x string, items array<int>"
    batches = [[(i, 1, "a", [i]) for i in range(60)], [(3, 2, "b", None), (3, 2, "c", [1]), (3, 2, "b", None), (7, 0, "old", [])],
               [(3, 2, "bb", [9]), (100, None, "new", None), (None, 1, "no key", None)]]
    want = None
    for n, order in enumerate([*permutations(range(3)), (2, 1, 0, 1, 2, 0)]):
        path = tmp_path / str(n)
        for i in order:
            MG.merge(str(path), spark.createDataFrame(batches[i], schema), "k", "v", buckets=8)
        got = sorted(map(tuple, MG.read_merged(spark, str(path)).collect()), key=str)
        want = want or got
        assert got == want
    assert len(want) == 62 and (3, 2, "c", [1]) in want and (7, 1, "a", [7]) in want


def test_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    from leaserisk.sources import merge as MG

    path = tmp_path / "t"
    df = lambda rows: spark.createDataFrame(rows, "k long, v int")
    assert MG.merge(str(path), df([]), "k", "v") == []
    MG.merge(str(path), df([(i, 1) for i in range(100)]), "k", "v", buckets=8)
    before = _table_files(path)
    touched = MG.merge(str(path), df([(5, 2)]), "k", "v", buckets=8)
    after = _table_files(path)
    assert len(touched) == 1
    kept = {p for p in before if f"_bucket={touched[0]}/" not in f"{p}"}
    assert len(kept) == 7 and all(after[p] == before[p] for p in kept)
    assert MG.read_merged(spark, str(path)).filter("k = 5").first().v == 2


def test_sync_reads_from_the_mark_on(spark, tmp_path):
    from leaserisk.sources import merge as MG

    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k long, v int, x string")
    assert MG.high_water_mark(spark, path) is None
    MG.sync(path, df([(1, 5, "a"), (2, 6, "a")]), "k", "v")
    assert MG.high_water_mark(spark, path) == 6
    MG.sync(path, df([(1, 5, "changed without a new version"), (3, 6, "late"), (4, 9, "a")]), "k", "v")
    assert sorted(map(tuple, MG.read_merged(spark, path).collect())) == [(1, 5, "a"), (2, 6, "a"), (3, 6, "late"), (4, 9, "a")]
    assert MG.high_water_mark(spark, path) == 9
    assert MG.sync(path, df([(1, 5, "z")]), "k", "v") == [] and MG.high_water_mark(spark, path) == 9


def test_layers_are_idempotent_and_finish_what_broke_off(spark, tmp_path):
    from leaserisk.sources.layers import Entity, Layers

    rows = spark.createDataFrame([(1, "  Ann ", "5"), (1, "bob", "7"), (2, "cy", "-1"), (3, None, "oops")], "id long, name string, amount string")
    typed = spark.createDataFrame([], "id long, name string, amount double").schema
    e = Entity("tenants", ("id",), typed, (("named", "name IS NOT NULL"), ("positive", "amount > 0")), ("name",))
    layers = Layers(spark, str(tmp_path))
    assert layers.land(e, "b1", rows, "src") and not layers.land(e, "b1", rows.limit(0), "src")
    assert layers.stage(e, "b1") and not layers.stage(e, "b1")
    assert [(r.id, r.name, r.amount) for r in layers.staged(e).collect()] == [(1, "bob", 7.0)]
    assert sorted((r.id, r.broken) for r in layers.staged(e, "quarantine").collect()) == [(2, ["positive"]), (3, ["named", "positive"])]
    # Rows of a batch that was written but not listed are replaced.
    rows.selectExpr("id", "name", "'half' AS amount", "'src' AS source_system").write.parquet(f"{tmp_path}/raw/entity=tenants/batch=b2")
    assert layers.land(e, "b2", spark.createDataFrame([(1, "dan", "9"), (4, "eve", "2")], rows.schema), "src") and layers.stage(e, "b2")
    assert sorted((r.id, r.name) for r in layers.current(e).collect()) == [(1, "dan"), (4, "eve")]
    assert sorted((r.layer, r.batch, r.rows) for r in layers.manifest().collect()) == [
        ("raw", "b1", 4), ("raw", "b2", 2), ("staging", "b1", 3), ("staging", "b2", 2)]


def test_sync_documents_keeps_docs_without_items(spark):
    docs = spark.createDataFrame(
        [(1, dt.date(2020, 1, 2), ("ann", "a@x"), [(10,), (11,)]), (2, dt.date(2020, 1, 3), ("bob", "b@x"), []),
         (3, dt.date(2019, 1, 1), ("cy", "c@x"), [(12,)])],
        "id long, updated date, owner struct<name:string,email:string>, items array<struct<n:int>>")
    out = IO.sync_documents(docs, "updated", "2020-01-01", "items", "id").collect()
    assert sorted((r.id, r.n) for r in out) == [(1, 10), (1, 11), (2, None)]
    assert {r.owner_name for r in out} == {"ann", "bob"}


def test_csv_round_trip_with_schema(spark):
    df = spark.createDataFrame([(1, dt.date(1999, 1, 1), 0), (2, None, 1)], "lease_id long, d date, churned int")
    path = scratch_path(spark, "test_csv")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path, "lease_id long, d date, churned int")
    assert sorted(back.collect()) == sorted(df.collect())
    assert back.filter(F.col("d").isNull()).count() == 1


def test_paths_without_a_scheme_are_qualified(spark, tmp_path):
    assert IO.qualified(spark, str(tmp_path / "a")) == f"file:{tmp_path}/a"
    assert IO.qualified(spark, f"file://{tmp_path}/a") == f"file:{tmp_path}/a"
    place = IO.qualified(spark, str(tmp_path / "t"))
    spark.range(3).write.parquet(place)
    assert IO.path_exists(spark, place) and IO.read_source(spark, "parquet", place).count() == 3
