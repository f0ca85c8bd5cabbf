"""Structured Streaming monitors (T1-T8) with their batch twins.

Every stream reads the driver parquet through the file source
(``readStream`` + ``pathGlobFilter``), casts the NTZ event time to
``timestamp`` (UTC session) and declares a watermark, then runs with
``trigger(availableNow=True)``: all available input is processed and the
query stops (incremental batch, T5).  Checkpoints and sink tables live under
the shared checkpoint folder, so a rerun after a failure resumes from the
last committed batch.

Append mode emits only closed state: a window, session or pending action
is emitted once the watermark (max event time - delay) has passed its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaserisk.config import AS_OF, ENGAGEMENT_HIGH_THRESHOLD
from leaserisk.session import checkpoint_dir, ensure_utc, scratch_path

DELAY = "1 hour"
RESPONSE_HOURS = 48


FILES_PER_TRIGGER = 1000


def _fs(spark: SparkSession, path: str):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def _is_dir(spark: SparkSession, path: str) -> bool:
    fs, hp = _fs(spark, path)
    return fs.getFileStatus(hp).isDirectory()


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """File-stream source over ``<sf_dir>/<table>.parquet``: a folder of part
    files is streamed as is; a single file is picked out of its folder with a
    glob filter.  A trigger takes up to ``FILES_PER_TRIGGER`` files."""
    ensure_utc(spark)
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    if _is_dir(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _events(spark, sf_dir, types) -> DataFrame:
    s = event_stream(spark, sf_dir)
    return (s.filter(F.col("event_type").isin(*types))
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", DELAY))


def stream_paths(spark: SparkSession, name: str, run_id: str | None = None) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark)}/streams/{name}-{run_id or uuid.uuid4().hex[:12]}"
    return f"{base}/out", f"{base}/checkpoint"


def run_append(df: DataFrame, name: str, run_id: str | None = None) -> str:
    """Run a streaming frame until all available input is processed, however
    long that takes, into a parquet sink; return its path.  A failed stream raises."""
    spark = df.sparkSession
    out, ck = stream_paths(spark, name, run_id)
    q = (df.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_batches(df: DataFrame, name: str, mode: str, sink, run_id: str | None = None) -> str:
    """foreachBatch form for update / complete modes; ``sink(batch_df, out_path, batch_id)``."""
    spark = df.sparkSession
    out, ck = stream_paths(spark, name, run_id)
    q = (df.writeStream.outputMode(mode).foreachBatch(lambda b, i: sink(b, out, i))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The sink's table; empty only if no batch has made it."""
    fs, hp = _fs(spark, path)
    if not fs.exists(hp):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# -- T1: 48-hour response monitor (left outer join of two streams) -------------------
T1_OUT = ("action_id long, tenant_id long, action_ts timestamp, response_ts timestamp, outcome string")
BUCKET_HOURS = 24


def response_monitor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions left-joined with the clicks of the same tenant in [t, t + 48 h],
    then the first click of each action.  Both sides carry a watermark, so an
    action leaves the state, and is emitted with its first response or as
    NO_RESPONSE, once the watermark has passed its 48 hours, in whatever
    batches and order its events came.

    The join key is (tenant, day bucket of the action), so a hot tenant's state
    is split over its days; a click goes to the buckets whose actions it can
    answer: those of [ts - 48 h, ts]."""
    width = BUCKET_HOURS * 3600
    bucket = lambda c: F.floor(c / width).cast("long")
    ts = F.col("ts").cast("timestamp")
    actions = (event_stream(spark, sf_dir).filter(F.col("event_type") == "purchase")
               .select(F.col("event_id").alias("action_id"), F.col("user_id").alias("tenant_id"), ts.alias("action_ts"))
               .withWatermark("action_ts", DELAY)
               .withColumn("bucket", bucket(F.unix_seconds("action_ts"))))
    clicks = (event_stream(spark, sf_dir).filter(F.col("event_type") == "click")
              .select(F.col("user_id").alias("click_tenant"), ts.alias("click_ts"))
              .withWatermark("click_ts", DELAY)
              .select("click_tenant", "click_ts", F.explode(F.sequence(
                  bucket(F.unix_seconds("click_ts") - RESPONSE_HOURS * 3600), bucket(F.unix_seconds("click_ts")))).alias("click_bucket")))
    in_time = F.expr(f"click_ts >= action_ts AND click_ts <= action_ts + INTERVAL {RESPONSE_HOURS} HOURS")
    joined = actions.join(clicks, (F.col("tenant_id") == F.col("click_tenant"))
                          & (F.col("bucket") == F.col("click_bucket")) & in_time, "leftOuter")
    return (joined.groupBy("action_id", "tenant_id", "action_ts").agg(F.min("click_ts").alias("response_ts"))
            .withColumn("outcome", F.when(F.col("response_ts").isNull(), "NO_RESPONSE").otherwise("RESPONDED")))


def response_monitor(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Run the stream, return the emitted rows."""
    path = run_append(response_monitor_stream(spark, sf_dir), "t1_response", run_id)
    return _read(spark, path, T1_OUT)


# -- T2: 7-day engagement windows ------------------------------------------------------
def engagement_windows_stream(spark, sf_dir, threshold: int = ENGAGEMENT_HIGH_THRESHOLD) -> DataFrame:
    ev = _events(spark, sf_dir, ["click", "view", "signup"])
    return (ev.groupBy(F.window("ts", "7 days"), F.col("user_id").alias("tenant_id"))
            .agg(F.count(F.lit(1)).alias("engagement_count"))
            .select("tenant_id", F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "engagement_count",
                    F.when(F.col("engagement_count") >= threshold, "HIGH_ENGAGEMENT")
                    .otherwise("LOW_ENGAGEMENT").alias("branch")))


def engagement_windows(spark, sf_dir, run_id=None) -> DataFrame:
    return _read(spark, run_append(engagement_windows_stream(spark, sf_dir), "t2_engagement", run_id),
                 "tenant_id long, window_start timestamp, window_end timestamp, engagement_count long, "
                 "branch string")


# -- T3: login / complaint counters (update semantics through foreachBatch) ---------------
def counters_stream(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir, ["view", "error"])
    return ev.groupBy(F.col("user_id").alias("tenant_id")).agg(
        F.count_if(F.col("event_type") == "view").alias("portal_login_count"),
        F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_login_at"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") >= 60)).alias("complaint_count"))


def _append_delta(batch: DataFrame, out: str, batch_id: int) -> None:
    """Append the rows a micro-batch changed, tagged with the batch id.  A
    replayed batch (after a failure) appends identical rows with the same id,
    which the read side collapses, so the sink is idempotent; no batch
    rewrites the table."""
    batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{out}/deltas")


def read_latest(spark: SparkSession, out: str, key: str, schema: str) -> DataFrame:
    """Current table = latest delta row per key (R2 at read time)."""
    d = _read(spark, f"{out}/deltas", schema + ", _batch long")
    cols = [c for c in d.columns if c not in (key, "_batch")]
    return (d.groupBy(key).agg(F.max_by(F.struct(*cols), "_batch").alias("_r")).select(key, "_r.*"))


_T3_SCHEMA = "tenant_id long, portal_login_count long, last_login_at timestamp, complaint_count long"


def counters(spark, sf_dir, run_id=None) -> DataFrame:
    """Update-mode counters; each batch appends the changed tenants."""
    path = run_batches(counters_stream(spark, sf_dir), "t3_counters", "update", _append_delta, run_id)
    return read_latest(spark, path, "tenant_id", _T3_SCHEMA)


def counters_batch(events: DataFrame) -> DataFrame:
    """T3 batch twin."""
    e = events.filter(F.col("event_type").isin("view", "error"))
    return e.groupBy(F.col("user_id").alias("tenant_id")).agg(
        F.count_if(F.col("event_type") == "view").alias("portal_login_count"),
        F.max(F.when(F.col("event_type") == "view", F.col("ts").cast("timestamp"))).alias("last_login_at"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") >= 60)).alias("complaint_count"))


# -- T4: continuous scoring of arriving leases (stream-static joins) --------------------------
def scoring_stream(spark, sf_dir, as_of=AS_OF) -> DataFrame:
    from leaserisk.operators import features as FE
    from leaserisk.operators import scoring as S
    from leaserisk.sources.driver import domain, leases_from_orders
    dom = domain(spark, sf_dir, as_of)
    orders = event_stream(spark, sf_dir, "orders")
    # Written once: micro-batches join the table, not its aggregate over all line items.
    path = scratch_path(spark, "lease_property")
    dom.lease_property().write.parquet(path)
    leases = leases_from_orders(orders, spark.read.parquet(path), as_of)
    a = FE.as_of_col(as_of)
    ctx = (leases.join(dom.tenants().select(*FE.TENANT_COLS), "tenant_id", "left")
           .join(dom.properties().select(*FE.PROPERTY_COLS), "property_id", "left")
           .join(FE.market_as_of(dom.market_data(), as_of), "zip_code", "left")
           .withColumns({"property_age": F.year(a) - F.col("year_built"),
                         "tenure_days": F.datediff(a, F.col("start_date"))}))
    return S.with_rule_risk(ctx).select("lease_id", "tenant_id", "risk_score", "risk_level",
                                        "predicted_churn")


def continuous_scoring(spark, sf_dir, run_id=None) -> DataFrame:
    """T4: each micro-batch appends its scored leases to the delta log; the
    current prediction table is the latest row per lease (keyed upsert)."""
    path = run_batches(scoring_stream(spark, sf_dir), "t4_scoring", "append", _append_delta, run_id)
    return read_latest(spark, path, "lease_id",
                       "lease_id long, tenant_id long, risk_score int, risk_level string, predicted_churn boolean")


# -- T6: sliding 7-day maintenance trend ----------------------------------------------------
def maintenance_trend_stream(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir, ["error"])
    pr = F.when(F.col("value") >= 100, "HIGH").when(F.col("value") >= 30, "MEDIUM").otherwise("LOW")
    return (ev.groupBy(F.window("ts", "7 days", "1 day"), pr.alias("priority"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "priority", "requests"))


def maintenance_trend(spark, sf_dir, run_id=None) -> DataFrame:
    return _read(spark, run_append(maintenance_trend_stream(spark, sf_dir), "t6_trend", run_id),
                 "window_start timestamp, window_end timestamp, priority string, requests long")


# -- T7: portal sessions ---------------------------------------------------------------------
def sessions_stream(spark, sf_dir, gap: str = "30 minutes") -> DataFrame:
    ev = _events(spark, sf_dir, ["click", "view", "signup"])
    return (ev.groupBy(F.session_window("ts", gap), F.col("user_id").alias("tenant_id"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select("tenant_id", F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "events"))


def sessions(spark, sf_dir, run_id=None) -> DataFrame:
    return _read(spark, run_append(sessions_stream(spark, sf_dir), "t7_sessions", run_id),
                 "tenant_id long, session_start timestamp, session_end timestamp, events long")


# -- T8: duplicates and late rows -------------------------------------------------------------
def dedup_stream(spark, sf_dir, deliveries: int = 1) -> DataFrame:
    """``deliveries`` above 1 reads every event that often, as an at-least-once source would."""
    s = event_stream(spark, sf_dir)
    for _ in range(deliveries - 1):
        s = s.union(event_stream(spark, sf_dir))
    s = s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)
    return s.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type", "ts")


def deduplicated(spark, sf_dir, run_id=None, deliveries: int = 1) -> DataFrame:
    return _read(spark, run_append(dedup_stream(spark, sf_dir, deliveries), "t8_dedup", run_id),
                 "event_id long, event_type string, ts timestamp")
