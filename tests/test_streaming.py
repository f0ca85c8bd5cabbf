"""Streams vs brute force on a hand-made event folder with late and duplicate rows."""

import datetime as dt

import pytest

from leaserisk.streaming import monitors as T


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("events_src")
    b = dt.datetime(2024, 1, 1)
    h = lambda x: b + dt.timedelta(hours=x)
    rows = [
        (1, h(0), 1, "purchase", 10.0, "{}"),   # answered by click at h(5)
        (2, h(5), 1, "click", 1.0, "{}"),
        (3, h(1), 2, "purchase", 10.0, "{}"),   # no click within 48 h -> NO_RESPONSE
        (4, h(60), 2, "click", 1.0, "{}"),
        (5, h(200), 3, "purchase", 10.0, "{}"),  # window still open at the end -> not emitted
        (6, h(230), 3, "view", 1.0, "{}"),
        (6, h(230), 3, "view", 1.0, "{}"),      # duplicate event id
        (7, h(2), 1, "purchase", 10.0, "{}"),   # same tenant, answered by the same click
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                     "value double, props string")
    df.coalesce(1).write.parquet(str(d / "events.parquet"))
    return str(d)


def test_response_monitor(spark, event_dir):
    out = {r.action_id: (r.outcome, r.response_ts) for r in T.response_monitor(spark, event_dir).collect()}
    assert out[1] == ("RESPONDED", dt.datetime(2024, 1, 1, 5))
    assert out[7] == ("RESPONDED", dt.datetime(2024, 1, 1, 5))
    assert out[3] == ("NO_RESPONSE", None)
    assert 5 not in out  # watermark (h230 - 1 h) has not passed h200 + 48 h


def test_dedup_within_watermark(spark, event_dir):
    ids = [r.event_id for r in T.deduplicated(spark, event_dir).collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6, 7]


def test_counters_equal_batch_twin(spark, event_dir):
    s = {r.tenant_id: (r.portal_login_count, r.complaint_count) for r in T.counters(spark, event_dir).collect()}
    b = {r.tenant_id: (r.portal_login_count, r.complaint_count)
         for r in T.counters_batch(spark.read.parquet(f"{event_dir}/events.parquet")).collect()}
    assert s == b


def test_rerun_is_incremental(spark, event_dir):
    import uuid
    rid = uuid.uuid4().hex[:12]  # one checkpoint shared by both runs
    first = sorted(T.counters(spark, event_dir, rid).collect())
    second = sorted(T.counters(spark, event_dir, rid).collect())
    assert first == second


def test_response_monitor_equals_batch_twin(spark):
    """T1 stream vs its batch twin on driver data: every answered action has
    the same first response; every escalated one has none in the batch."""
    from pyspark.sql import functions as F
    from leaserisk.operators import retention as RT
    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    acts = ev.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("action_id"),
                                                               F.col("user_id").alias("tenant_id"), "ts")
    clicks = ev.filter(F.col("event_type") == "click").select(F.col("user_id").alias("tenant_id"), "ts")
    batch = {r.action_id: r.response_ts for r in RT.first_response_within(acts, clicks, 48).collect()}
    stream = T.response_monitor(spark, sf).collect()
    assert stream
    for r in stream:
        assert batch[r.action_id] == r.response_ts
    last = ev.filter(F.col("event_type").isin("purchase", "click")).groupBy("event_type").agg(F.max("ts").alias("ts")).collect()
    mark = min(r.ts for r in last) - dt.timedelta(hours=1)
    closed = {r.action_id for r in acts.filter(F.col("ts") + F.expr("INTERVAL 48 HOURS") < F.lit(mark)).collect()}
    assert {r.action_id for r in stream} == closed


def _event_files(spark, path, batches):
    """One file for each batch of (event_id, hour, user, type), in order of arrival."""
    import time
    start = dt.datetime(2024, 1, 1)
    for rows in batches:
        spark.createDataFrame([(i, start + dt.timedelta(hours=h), u, t, 100.0, "{}") for i, h, u, t in rows],
                              "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                              ).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
        time.sleep(1.1)  # the file source takes files by modification time, in seconds


BATCHES = [
    [(1, 10.5, 1, "purchase"), (2, 10.2, 2, "click"), (3, 0, 3, "purchase")],
    [(4, 10.0, 1, "click"), (5, 10.0, 2, "purchase"), (6, 12, 1, "click")],       # 4 before its action; 5 late within the delay
    [(7, 47, 3, "click"), (8, 46.5, 3, "click"), (9, 60, 9, "click"), (10, 60, 9, "purchase")],
    [(11, 61, 2, "click"), (12, 59.5, 4, "purchase"), (13, 120, 9, "purchase"), (14, 120, 9, "click")],
    [(15, 121, 9, "purchase"), (16, 121, 9, "click"), (17, 300, 9, "purchase"), (18, 300, 9, "click")],
]


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_response_monitor_over_many_micro_batches(spark, tmp_path, monkeypatch, files):
    from pyspark.sql import functions as F
    from leaserisk.operators import retention as RT
    monkeypatch.setattr(T, "FILES_PER_TRIGGER", files)
    _event_files(spark, tmp_path, BATCHES)
    ev = spark.read.parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    acts = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("action_id"), F.col("user_id").alias("tenant_id"), "ts")
    clicks = ev.filter("event_type = 'click'").select(F.col("user_id").alias("tenant_id"), "ts")
    want = {r.action_id: r.response_ts for r in RT.first_response_within(acts, clicks, 48).collect() if r.action_id != 17}
    got = {r.action_id: r.response_ts for r in T.response_monitor(spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("files", [1, 1000])
def test_duplicates_in_later_batches_are_dropped(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(T, "FILES_PER_TRIGGER", files)
    _event_files(spark, tmp_path, [[(1, 1, 1, "view"), (1, 1, 1, "view")], [(1, 1, 1, "view"), (2, 1.5, 1, "view")], [(2, 1.5, 1, "view"), (3, 2, 1, "click")]])
    assert sorted(r.event_id for r in T.deduplicated(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_failed_sink_read_raises(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        T._read(spark, str(tmp_path), "a long").collect()
    assert T._read(spark, str(tmp_path / "none"), "a long").collect() == []
