"""Streaming queries (T1-T8).  Each runs a Structured Streaming query to
completion (availableNow) and returns what its sink holds.  Oracles restrict
to state the watermark has closed: ``wm = max(event time in ms) - 1 hour``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.session import scratch_path
from leaserisk.streaming import monitors as T


def _ts(c, name):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


register("t01_response_monitoring", q(f"""
, e AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('purchase', 'click')),
wm AS (SELECT (least(epoch_ms(max(ts) FILTER (event_type = 'purchase')), epoch_ms(max(ts) FILTER (event_type = 'click')))
               - 3600000) * 1000 AS wm_us FROM e),
act AS (SELECT event_id AS action_id, user_id AS tenant_id, ts FROM e WHERE event_type = 'purchase'),
m AS (SELECT a.action_id, min(c.ts) AS rts FROM act a JOIN e c
        ON c.event_type = 'click' AND c.user_id = a.tenant_id AND c.ts >= a.ts
       AND c.ts <= a.ts + INTERVAL 48 HOUR
      GROUP BY 1)
SELECT a.action_id, a.tenant_id, {_ts('a.ts', 'action_ts')}, {_ts('m.rts', 'response_ts')},
       CASE WHEN m.rts IS NULL THEN 'NO_RESPONSE' ELSE 'RESPONDED' END AS outcome
FROM act a LEFT JOIN m ON m.action_id = a.action_id, wm
WHERE epoch_us(a.ts) + 172800000000 < wm.wm_us
"""), headline=True)(lambda spark, sf: T.response_monitor(spark, sf))

register("t02_engagement_windows", q(f"""
, e AS (SELECT user_id, ts FROM events WHERE event_type IN ('click', 'view', 'signup')),
wm AS (SELECT epoch_ms(max(ts)) - 3600000 AS wm_ms FROM e),
w AS (SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01 00:00:00') AS ws, count(*) AS n
      FROM e GROUP BY 1, 2)
SELECT user_id AS tenant_id, {_ts('ws', 'window_start')}, {_ts('ws + INTERVAL 7 DAY', 'window_end')},
       n AS engagement_count, CASE WHEN n >= 3 THEN 'HIGH_ENGAGEMENT' ELSE 'LOW_ENGAGEMENT' END AS branch
FROM w, wm WHERE epoch_ms(ws + INTERVAL 7 DAY) <= wm_ms
"""))(lambda spark, sf: T.engagement_windows(spark, sf))

_T3_SQL = f"""
SELECT user_id AS tenant_id, count(*) FILTER (WHERE event_type = 'view') AS portal_login_count,
       {_ts("max(CASE WHEN event_type = 'view' THEN ts END)", 'last_login_at')},
       count(*) FILTER (WHERE event_type = 'error' AND value >= 60) AS complaint_count
FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id
"""
register("t03_login_counters", q(_T3_SQL))(lambda spark, sf: T.counters(spark, sf))


def t05(spark, sf):
    """T5: the same incremental job run twice on one checkpoint, with new
    files in between; the second run reads only those."""
    rid, folder = uuid.uuid4().hex[:12], scratch_path(spark, "arriving")
    events = spark.read.parquet(f"{sf}/events.parquet")
    early = F.col("event_id") % 2 == 0
    for part in (events.filter(early), events.filter(~early | F.col("event_id").isNull())):
        part.write.mode("append").parquet(f"{folder}/events.parquet")
        out = T.counters(spark, folder, rid)
    return out


register("t05_incremental_rerun", q(_T3_SQL))(t05)

register("t04_continuous_scoring", q("""
SELECT lease_id, tenant_id, risk_score, risk_level, predicted_churn FROM d_scored
"""))(lambda spark, sf: T.continuous_scoring(spark, sf))

register("t06_sliding_trend", q(f"""
, e AS (SELECT ts, CASE WHEN value >= 100 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority
        FROM events WHERE event_type = 'error'),
wm AS (SELECT epoch_ms(max(ts)) - 3600000 AS wm_ms FROM e),
w AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 00:00:00') - to_days(CAST(k AS INTEGER)) AS ws,
             priority FROM e CROSS JOIN range(0, 7) t(k))
SELECT {_ts('ws', 'window_start')}, {_ts('ws + INTERVAL 7 DAY', 'window_end')}, priority, count(*) AS requests
FROM w, wm WHERE epoch_ms(ws + INTERVAL 7 DAY) <= wm_ms GROUP BY ws, priority
"""))(lambda spark, sf: T.maintenance_trend(spark, sf))

register("t07_portal_sessions", q(f"""
, e AS (SELECT user_id, ts FROM events WHERE event_type IN ('click', 'view', 'signup')),
wm AS (SELECT epoch_ms(max(ts)) - 3600000 AS wm_ms FROM e),
s1 AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM e),
s2 AS (SELECT user_id, ts,
              sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM s1),
s3 AS (SELECT user_id, sid, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS n FROM s2 GROUP BY 1, 2)
SELECT user_id AS tenant_id, {_ts('st', 'session_start')}, {_ts('en', 'session_end')}, n AS events
FROM s3, wm WHERE epoch_ms(en) <= wm_ms
"""))(lambda spark, sf: T.sessions(spark, sf))

# Every event comes twice; rows are counted, so a duplicate that got through would show.
register("t08_dedup_events", q("""
SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1
"""))(lambda spark, sf: T.deduplicated(spark, sf, deliveries=2).groupBy("event_type")
      .agg(F.count("*").alias("events")))
