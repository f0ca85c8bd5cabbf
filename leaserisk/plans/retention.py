"""Retention queries (R1-R11, W1, J14, J15, A5, A6, A27) and their oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leaserisk import config as C
from leaserisk.functions import measures as M
from leaserisk.operators import predictions as PR
from leaserisk.operators import retention as RT
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.sources.driver import domain

A = "DATE '1999-01-01'"
TS0 = "'1999-01-01 00:00:00.000000'"


def _lp(spark, sf):
    return PR.leases_with_prediction(domain(spark, sf))


# -- W1 / R1 / R2 / J14 / J15 -------------------------------------------------------
register("w01_latest_prediction", q("""
SELECT lease_id, CAST(prediction_date AS VARCHAR) AS prediction_date, risk_score, risk_level, model_version
FROM d_latest
"""))(lambda spark, sf: PR.latest_predictions(PR.prediction_history(domain(spark, sf)))
      .select("lease_id", "prediction_date", "risk_score", "risk_level", "model_version"))

register("r01_lease_latest_prediction", q("""
SELECT lease_id, status, CAST(prediction_date AS VARCHAR) AS prediction_date, risk_score, risk_level
FROM d_lease_pred
"""))(lambda spark, sf: _lp(spark, sf).select("lease_id", "status", "prediction_date", "risk_score",
                                              "risk_level"))


def r02(spark, sf):
    dom = domain(spark, sf)
    newest = dom.as_of.replace(day=1)
    cols = ["lease_id", "prediction_date", "risk_score", "risk_level"]
    snap = PR.latest_predictions(PR.prediction_history(dom, last=newest - dt.timedelta(days=1))).select(*cols)
    upd = PR.prediction_history(dom, first=newest).select(*cols)
    return RT.upsert(snap, upd, "lease_id", "prediction_date")


register("r02_keyed_upsert", q("""
SELECT lease_id, CAST(prediction_date AS VARCHAR) AS prediction_date, risk_score, risk_level FROM d_latest
"""))(r02)

register("j14_attach_predictions", q(f"""
SELECT l.lease_id, l.tenant_id, CAST(l.end_date AS VARCHAR) AS end_date, h.risk_score, h.risk_level
FROM d_lease l JOIN d_hist h ON h.lease_id = l.lease_id AND h.prediction_date = {A}
"""))(lambda spark, sf: domain(spark, sf).leases().select("lease_id", "tenant_id", "end_date").join(
    PR.prediction_history(domain(spark, sf), first=dt.date(1999, 1, 1)).select("lease_id", "risk_score",
                                                                               "risk_level"), "lease_id"))

register("j15_unpredicted_active", q("""
SELECT lease_id, tenant_id FROM d_lease
WHERE status = 'active' AND lease_id NOT IN (SELECT lease_id FROM d_hist)
"""))(lambda spark, sf: PR.unpredicted_active(domain(spark, sf)).select("lease_id", "tenant_id"))

# -- R5 / R6 / R7 / R3 ---------------------------------------------------------------------
_INC_SQL = f"""
CASE WHEN risk_score >= {C.INCENTIVE_DISCOUNT_SCORE} THEN 'rent-discount'
     WHEN risk_score >= {C.INCENTIVE_UPGRADE_SCORE} THEN 'upgrade' ELSE 'gift-card' END"""
_INC_VAL = f"""
CASE WHEN risk_score >= {C.INCENTIVE_DISCOUNT_SCORE} THEN CAST(rent_cents * 5 AS DOUBLE) / 10000
     WHEN risk_score >= {C.INCENTIVE_UPGRADE_SCORE} THEN CAST({C.INCENTIVE_UPGRADE_VALUE} AS DOUBLE)
     ELSE CAST({C.INCENTIVE_GIFT_VALUE} AS DOUBLE) END"""
_INC_DESC = f"""
CASE WHEN risk_score >= {C.INCENTIVE_DISCOUNT_SCORE} THEN '{RT.INCENTIVE_TEXT["rent-discount"]}'
     WHEN risk_score >= {C.INCENTIVE_UPGRADE_SCORE} THEN '{RT.INCENTIVE_TEXT["upgrade"]}'
     ELSE '{RT.INCENTIVE_TEXT["gift-card"]}' END"""

_TRIGGER_SQL = f"""
, a AS (SELECT * FROM d_lease_pred
        WHERE status = 'active' AND risk_level IS NOT NULL
          AND (risk_level <> 'LOW' OR (end_date > {A} AND end_date <= {A} + 90))),
tr AS (
  SELECT lease_id, tenant_id, property_id, risk_level, risk_score,
         CASE risk_level WHEN 'HIGH' THEN '{RT.HIGH_ACTION[0]}' WHEN 'MEDIUM' THEN '{RT.MEDIUM_ACTION_TYPE}'
              ELSE '{RT.LOW_ACTION[0]}' END AS action_type,
         CASE risk_level WHEN 'HIGH' THEN '{RT.HIGH_ACTION[1]}'
              WHEN 'MEDIUM' THEN '{RT.MEDIUM_NOTE_PREFIX}' || {_INC_DESC}
              ELSE '{RT.LOW_ACTION[1]}' END AS notes,
         CASE risk_level WHEN 'HIGH' THEN '{",".join(RT.ACTIONS_TAKEN["HIGH"])}'
              WHEN 'MEDIUM' THEN '{",".join(RT.ACTIONS_TAKEN["MEDIUM"])}'
              ELSE '{",".join(RT.ACTIONS_TAKEN["LOW"])}' END AS actions_taken,
         CASE WHEN risk_level = 'MEDIUM' THEN {_INC_SQL} END AS incentive_type,
         CASE WHEN risk_level = 'MEDIUM' THEN {_INC_VAL} END AS incentive_value,
         {TS0} AS triggered_at, 'pending' AS status,
         CASE WHEN property_id IS NULL THEN 'lease has no property' END AS error
  FROM a)
"""


def _trigger(spark, sf):
    return RT.auto_trigger(_lp(spark, sf))


register("r05_auto_trigger", q(_TRIGGER_SQL + "SELECT * FROM tr"), headline=True)(
    lambda spark, sf: _trigger(spark, sf).withColumn("actions_taken", F.array_join("actions_taken", ",")))

register("r05_trigger_summary", q(_TRIGGER_SQL + """
SELECT count(*) FILTER (WHERE error IS NULL AND risk_level = 'HIGH') AS high_risk_processed,
       count(*) FILTER (WHERE error IS NULL AND risk_level = 'MEDIUM') AS medium_risk_processed,
       count(*) FILTER (WHERE error IS NULL AND risk_level = 'LOW') AS low_risk_notices,
       count(*) FILTER (WHERE error IS NULL AND risk_level <> 'LOW') AS actions_triggered,
       count(*) FILTER (WHERE error IS NOT NULL) AS errors
FROM tr
"""))(lambda spark, sf: RT.trigger_summary(_trigger(spark, sf)))

register("r06_incentive_offer", q(f"""
SELECT lease_id, risk_score, {_INC_SQL} AS incentive_type, {_INC_VAL} AS incentive_value,
       {_INC_DESC} AS incentive_description, CAST({A} + 30 AS VARCHAR) AS expires_at,
       risk_score AS risk_score_at_offer
FROM d_lease_pred WHERE status = 'active' AND risk_level = 'MEDIUM'
"""))(lambda spark, sf: RT.incentive_offer(_lp(spark, sf).filter(
    (F.col("status") == "active") & (F.col("risk_level") == "MEDIUM")))
    .select("lease_id", "risk_score", "incentive_type", "incentive_value", "incentive_description",
            "expires_at", "risk_score_at_offer"))

register("r07_low_risk_notice", q(_TRIGGER_SQL + """
SELECT lease_id, tenant_id, action_type, notes FROM tr WHERE risk_level = 'LOW'
"""))(lambda spark, sf: _trigger(spark, sf).filter(F.col("risk_level") == "LOW")
      .select("lease_id", "tenant_id", "action_type", "notes"))


def r03(spark, sf):
    dom = domain(spark, sf)
    log = dom.actions().select("action_id", "tenant_id", "action_type", "status", "triggered_at")
    new = _trigger(spark, sf).filter(F.col("error").isNull())
    return RT.record_actions(log, new).groupBy("action_type", "status").agg(
        F.count(F.lit(1)).alias("actions"), F.count("action_id").alias("logged_before"))


register("r03_record_actions", q(_TRIGGER_SQL + """
, u AS (SELECT action_id, action_type, status FROM d_action
        UNION ALL SELECT NULL, action_type, status FROM tr WHERE error IS NULL)
SELECT action_type, status, count(*) AS actions, count(action_id) AS logged_before FROM u GROUP BY 1, 2
"""))(r03)

register("r05_action_rows", q(_TRIGGER_SQL + """
SELECT lease_id, tenant_id, risk_level, CAST(unnest(generate_series(1, len(string_split(actions_taken, ',')))) - 1 AS INTEGER) AS step,
       unnest(string_split(actions_taken, ',')) AS action, triggered_at, status
FROM tr WHERE error IS NULL
"""))(lambda spark, sf: RT.action_rows(_trigger(spark, sf)))

# -- R8 ---------------------------------------------------------------------------------
_STEPS_SQL = ", ".join(
    "('{0}', {1}, '{2}', {3}, {4}, {5}, '{6}')".format(
        lv, sid, act, "NULL" if nxt is None else nxt, "NULL" if cn is None else f"'{cn}'",
        "true" if term else "false", ";".join(f"{k}={v}" for k, v in sorted(RT.STEP_PARAMETERS[lv, sid].items())))
    for lv, sid, act, nxt, cn, term in RT.WORKFLOW_STEPS)

register("r08_workflow_plan", q(f"""
, steps AS (SELECT * FROM (VALUES {_STEPS_SQL})
            v(risk_level, step_id, action, next_step, conditional_next, terminal, parameters))
SELECT l.lease_id, l.tenant_id, l.risk_level, l.risk_score, s.step_id, s.action,
       CAST(s.next_step AS INTEGER) AS next_step, s.conditional_next, s.terminal, s.parameters,
       CASE WHEN l.risk_level = 'HIGH' THEN 'URGENT' ELSE 'NORMAL' END AS priority,
       4000 AS estimated_turnover_cost, l.risk_score * 40 AS risk_mitigation_value
FROM d_lease_pred l JOIN steps s ON s.risk_level = l.risk_level
WHERE l.status = 'active' AND l.risk_level IN ('HIGH', 'MEDIUM')
"""))(lambda spark, sf: RT.workflow_plan(_lp(spark, sf), spark).withColumn("parameters", F.array_join(F.transform(
    F.array_sort(F.map_entries("parameters")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")))

# -- R9 / A27 ----------------------------------------------------------------------------
_STATUS_SQL = """
, wf AS (SELECT DISTINCT lease_id, tenant_id, risk_level,
                CASE WHEN risk_level = 'HIGH' THEN 'URGENT' ELSE 'NORMAL' END AS priority
         FROM d_lease_pred WHERE status = 'active' AND risk_level IN ('HIGH', 'MEDIUM')),
st AS (SELECT tenant_id, triggered_at AS started_at FROM d_action
       QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY triggered_at, action_id) = 1),
rs AS (SELECT st.tenant_id, min(e.ts) AS response_ts FROM st JOIN events e
         ON e.user_id = st.tenant_id AND e.event_type = 'click'
        AND e.ts >= st.started_at AND e.ts <= st.started_at + INTERVAL 48 HOUR
       GROUP BY st.tenant_id),
en AS (SELECT st.tenant_id, count(g.event_id) AS engagement_count FROM st LEFT JOIN d_engage g
         ON g.tenant_id = st.tenant_id AND g.ts > st.started_at AND g.ts <= st.started_at + INTERVAL 7 DAY
       GROUP BY st.tenant_id),
ws0 AS (SELECT wf.*, st.started_at, rs.response_ts, coalesce(en.engagement_count, 0) AS engagement_count,
               CASE WHEN st.started_at IS NULL THEN NULL
                    WHEN wf.risk_level = 'HIGH' THEN
                      CASE WHEN rs.response_ts IS NOT NULL THEN 'POSITIVE_RESPONSE'
                           WHEN st.started_at + INTERVAL 48 HOUR < (SELECT max(ts) FROM events) THEN 'NO_RESPONSE' END
                    ELSE CASE WHEN coalesce(en.engagement_count, 0) >= 3 THEN 'HIGH_ENGAGEMENT'
                              WHEN st.started_at + INTERVAL 7 DAY < (SELECT max(ts) FROM events) THEN 'LOW_ENGAGEMENT' END
                    END AS branch
        FROM wf LEFT JOIN st ON st.tenant_id = wf.tenant_id
                LEFT JOIN rs ON rs.tenant_id = wf.tenant_id
                LEFT JOIN en ON en.tenant_id = wf.tenant_id),
ws AS (SELECT ws0.*,
              CASE branch WHEN 'NO_RESPONSE' THEN 6 WHEN 'POSITIVE_RESPONSE' THEN 7
                   WHEN 'NEGATIVE_RESPONSE' THEN 8 WHEN 'HIGH_ENGAGEMENT' THEN 5 WHEN 'LOW_ENGAGEMENT' THEN 4
                   ELSE CASE WHEN started_at IS NULL THEN 1 WHEN risk_level = 'HIGH' THEN 5 ELSE 3 END END AS current_step,
              CASE WHEN started_at IS NULL THEN 0 WHEN branch IS NULL AND risk_level = 'HIGH' THEN 4
                   WHEN branch IS NULL THEN 2 WHEN risk_level = 'HIGH' THEN 6 ELSE 4 END AS completed_steps,
              CASE WHEN started_at IS NULL THEN 'PENDING' WHEN branch IS NULL THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status,
              CASE WHEN response_ts IS NOT NULL
                   THEN CAST(epoch_us(response_ts) - epoch_us(started_at) AS DOUBLE) / 3600000000 END AS hours_to_response
       FROM ws0)
"""


def _status(spark, sf):
    dom = domain(spark, sf)
    lp = PR.leases_with_prediction(dom)
    resp = dom.engagement().filter(F.col("event_type") == "click")
    now = dom.raw("events").agg(F.max(F.col("ts").cast("timestamp")))  # the log's last event
    return RT.workflow_status(RT.workflow_plan(lp, spark), dom.actions(), resp, dom.engagement(), now)


register("r09_workflow_status", q(_STATUS_SQL + """
SELECT lease_id, tenant_id, risk_level, priority,
       strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       strftime(response_ts, '%Y-%m-%d %H:%M:%S.%f') AS response_ts,
       engagement_count, branch, current_step, completed_steps, status, round(hours_to_response, 4) AS
       hours_to_response
FROM ws
"""))(lambda spark, sf: _status(spark, sf).withColumn("hours_to_response", F.round("hours_to_response", 4)))


def _workflow_log(spark, sf):
    """Active HIGH and MEDIUM leases, and their tenants' events as a step log: steps come in any order, and again."""
    dom = domain(spark, sf)
    starts = RT.workflow_plan(PR.leases_with_prediction(dom), spark).select("lease_id", "tenant_id", "risk_level").distinct()
    e = dom.raw("events").select(F.col("user_id").alias("tenant_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    log = starts.join(e, "tenant_id")
    high = F.col("risk_level") == "HIGH"
    outcome = (F.when(F.col("event_type") == "click", F.when(high, "POSITIVE_RESPONSE").otherwise("HIGH_ENGAGEMENT"))
               .when(F.col("event_type") == "error", F.when(high, "NEGATIVE_RESPONSE").otherwise("LOW_ENGAGEMENT"))
               .when(F.col("event_type") == "view", F.when(high, "NO_RESPONSE").otherwise("LOW_ENGAGEMENT")))
    return starts, log.select("lease_id", "ts", "event_id", (1 + F.col("event_id") % 8).cast("int").alias("step_id"), outcome.alias("outcome"))


def _workflow_sql():
    ctes = [f"""
, wl AS (SELECT lease_id, tenant_id, risk_level FROM d_lease_pred WHERE status = 'active' AND risk_level IN ('HIGH', 'MEDIUM')),
ev AS (SELECT wl.lease_id, e.ts, e.event_id, CAST(1 + e.event_id % 8 AS INTEGER) AS step_id,
              CASE e.event_type WHEN 'click' THEN CASE risk_level WHEN 'HIGH' THEN 'POSITIVE_RESPONSE' ELSE 'HIGH_ENGAGEMENT' END
                   WHEN 'error' THEN CASE risk_level WHEN 'HIGH' THEN 'NEGATIVE_RESPONSE' ELSE 'LOW_ENGAGEMENT' END
                   WHEN 'view' THEN CASE risk_level WHEN 'HIGH' THEN 'NO_RESPONSE' ELSE 'LOW_ENGAGEMENT' END END AS outcome
       FROM wl JOIN events e ON e.user_id = wl.tenant_id),
w0 AS (SELECT lease_id, risk_level, 1 AS step, 0 AS done, CAST(NULL AS VARCHAR) AS branch, TIMESTAMP '1900-01-01' AS ts,
              CAST(-1 AS BIGINT) AS event_id FROM wl)"""]
    for i in range(6):
        ctes.append(f"""
h{i} AS (SELECT w.lease_id, e.ts, e.event_id, e.outcome FROM w{i} w JOIN ev e ON e.lease_id = w.lease_id AND e.step_id = w.step
              AND (e.ts > w.ts OR (e.ts = w.ts AND e.event_id > w.event_id))
         QUALIFY row_number() OVER (PARTITION BY w.lease_id ORDER BY e.ts, e.event_id) = 1),
w{i + 1} AS (SELECT w.lease_id, w.risk_level,
       CASE WHEN h.lease_id IS NULL THEN w.step
            WHEN w.risk_level = 'HIGH' AND w.step = 5 THEN CASE h.outcome WHEN 'POSITIVE_RESPONSE' THEN 7 WHEN 'NEGATIVE_RESPONSE' THEN 8 ELSE 6 END
            WHEN w.risk_level = 'MEDIUM' AND w.step = 3 THEN CASE h.outcome WHEN 'HIGH_ENGAGEMENT' THEN 5 ELSE 4 END
            WHEN w.step >= CASE w.risk_level WHEN 'HIGH' THEN 6 ELSE 4 END THEN NULL ELSE w.step + 1 END AS step,
       w.done + CASE WHEN h.lease_id IS NULL THEN 0 ELSE 1 END AS done,
       CASE WHEN h.lease_id IS NOT NULL AND w.step = CASE w.risk_level WHEN 'HIGH' THEN 5 ELSE 3 END THEN h.outcome ELSE w.branch END AS branch,
       coalesce(h.ts, w.ts) AS ts, coalesce(h.event_id, w.event_id) AS event_id
       FROM w{i} w LEFT JOIN h{i} h ON h.lease_id = w.lease_id)""")
    return q(",".join(ctes) + """
SELECT lease_id, risk_level, CAST(step AS INTEGER) AS current_step, CAST(done AS INTEGER) AS completed_steps, branch,
       CASE WHEN step IS NULL THEN 'COMPLETED' WHEN done = 0 THEN 'PENDING' ELSE 'IN_PROGRESS' END AS status,
       CASE WHEN done > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS last_event_at
FROM w6""")


register("r09_workflow_fold", _workflow_sql())(lambda spark, sf: RT.fold_workflow(*_workflow_log(spark, sf)))

register("a27_workflow_metrics", q(_STATUS_SQL + """
SELECT priority, status, count(*) AS workflows,
       count(*) FILTER (WHERE branch IN ('POSITIVE_RESPONSE', 'HIGH_ENGAGEMENT')) AS successful,
       count(*) FILTER (WHERE branch IN ('NO_RESPONSE', 'LOW_ENGAGEMENT')) AS unsuccessful,
       round(CAST(count(*) FILTER (WHERE branch IN ('POSITIVE_RESPONSE', 'HIGH_ENGAGEMENT')) AS DOUBLE)
             / count(*), 6) AS success_rate,
       round(avg(hours_to_response), 4) AS avg_hours_to_response
FROM ws GROUP BY priority, status
"""))(lambda spark, sf: RT.workflow_metrics(_status(spark, sf)))

# -- A5 / A6 / R11 ---------------------------------------------------------------------------
C_START, C_END = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
_ACTED_SQL = """
, cur AS (SELECT tenant_id, lease_id, renewal_status FROM d_lease
          QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date DESC, lease_id DESC) = 1),
acted AS (SELECT a.*, cur.lease_id, cur.renewal_status FROM d_action a JOIN cur ON cur.tenant_id = a.tenant_id),
"""
_CAMP_METRICS_SQL = """
pl AS (SELECT c.lease_id, count(*) AS n, any_value(c.renewal_status) AS renewal_status, lp.risk_level
       FROM camp c LEFT JOIN d_lease_pred lp ON lp.lease_id = c.lease_id GROUP BY c.lease_id, lp.risk_level),
cm AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_campaigns, count(*) AS leases_with_campaigns,
              count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
              count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
              count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
              count(*) FILTER (WHERE renewal_status = 'renewed') AS renewed_leases
       FROM pl),
cmr AS (SELECT cm.*, CASE WHEN leases_with_campaigns > 0
                          THEN CAST(renewed_leases AS DOUBLE) / leases_with_campaigns * 100
                          ELSE CAST(0 AS DOUBLE) END AS renewal_rate FROM cm)
"""
_CAMP_SQL = _ACTED_SQL + f"""
camp AS (SELECT * FROM acted WHERE triggered_at >= TIMESTAMP '{C_START}' AND triggered_at <= TIMESTAMP '{C_END}'),
""" + _CAMP_METRICS_SQL
# Q13: a lease counts with all its actions if some action is not before the start and some, maybe another, not after the end.
_CAMP_DOCUMENT_SQL = _ACTED_SQL + f"""
camp AS (SELECT * FROM acted a WHERE EXISTS (SELECT 1 FROM acted b WHERE b.lease_id = a.lease_id AND b.triggered_at >= TIMESTAMP '{C_START}')
                                 AND EXISTS (SELECT 1 FROM acted b WHERE b.lease_id = a.lease_id AND b.triggered_at <= TIMESTAMP '{C_END}')),
""" + _CAMP_METRICS_SQL


def _camp(spark, sf, mode: str = "action"):
    dom = domain(spark, sf)
    return RT.campaign_actions(RT.action_leases(dom.actions(), dom.leases()), C_START, C_END, mode)


def _camp_metrics(spark, sf, mode: str = "action"):
    return RT.campaign_metrics(_camp(spark, sf, mode), _lp(spark, sf))


register("a05_campaign_metrics", q(_CAMP_SQL + "SELECT * FROM cmr"))(_camp_metrics)

register("a05_campaign_metrics_document", q(_CAMP_DOCUMENT_SQL + "SELECT * FROM cmr"))(
    lambda spark, sf: _camp_metrics(spark, sf, "document"))

register("a05_campaign_by_type", q(_CAMP_SQL + """
SELECT action_type, count(*) AS actions FROM camp GROUP BY action_type
"""))(lambda spark, sf: RT.campaign_by_type(_camp(spark, sf)))

register("a06_campaign_roi", q(_CAMP_SQL + """
SELECT total_campaigns,
       CAST(round(total_campaigns * (renewal_rate / 100)) AS BIGINT) AS turnovers_avoided,
       round(total_campaigns * (renewal_rate / 100) * 4000, 4) AS cost_savings,
       total_campaigns * 200 AS campaign_costs,
       round(total_campaigns * (renewal_rate / 100) * 4000 - total_campaigns * 200, 4) AS net_savings,
       round(CASE WHEN total_campaigns * 200 > 0
                  THEN (total_campaigns * (renewal_rate / 100) * 4000 - total_campaigns * 200)
                       / (total_campaigns * 200) * 100 ELSE CAST(0 AS DOUBLE) END, 4) AS roi_percentage,
       round(renewal_rate, 4) AS renewal_rate
FROM cmr
"""))(lambda spark, sf: RT.roi(_camp_metrics(spark, sf)))

register("r11_cohort_outcomes", q("""
SELECT h.neighborhood, h.risk_level, l.renewal_status, count(*) AS leases
FROM d_hist h JOIN d_lease l ON l.lease_id = h.lease_id
WHERE h.prediction_date = DATE '1998-11-01' AND h.risk_level IN ('HIGH', 'MEDIUM')
GROUP BY 1, 2, 3
"""))(lambda spark, sf: RT.cohort_outcomes(PR.prediction_history(domain(spark, sf)),
                                           domain(spark, sf).leases(), dt.date(1998, 11, 1)))


def _campaign(spark, sf):
    """The campaign of 1998-11-01, created, and created again once a later run has added leases to its cohort."""
    dom = domain(spark, sf)
    cohort = RT.campaign_cohort(PR.prediction_history(dom, first=dt.date(1998, 11, 1), last=dt.date(1998, 11, 30)))
    wider = RT.campaign_cohort(PR.prediction_history(dom, first=dt.date(1998, 11, 1), last=dt.date(1998, 12, 31)))
    log = RT.create_campaign(None, cohort, "autumn-98", 7)
    return RT.create_campaign(log, wider, "autumn-98", 7)


_COHORT_SQL = """
, co AS (SELECT lease_id, tenant_id, neighborhood, max_by(risk_level, prediction_date) AS risk_level, min(prediction_date) AS d,
                min_by(risk_level, prediction_date) AS first_level
         FROM d_hist WHERE prediction_date IN (DATE '1998-11-01', DATE '1998-12-01') AND risk_level IN ('HIGH', 'MEDIUM') GROUP BY 1, 2, 3),
cl AS (SELECT lease_id, tenant_id, neighborhood, CASE WHEN d = DATE '1998-11-01' THEN first_level ELSE risk_level END AS risk_level,
              CASE WHEN (lease_id * 7919 + 7) % 100 < 20 THEN 'control' ELSE 'treated' END AS arm FROM co)
"""
register("r11_campaign_actions", q(_COHORT_SQL + f"""
SELECT 'autumn-98' AS campaign, lease_id, tenant_id, risk_level, arm,
       CASE WHEN arm = 'treated' THEN CASE risk_level WHEN 'HIGH' THEN '{RT.HIGH_ACTION[0]}' ELSE '{RT.MEDIUM_ACTION_TYPE}' END END AS action_type,
       CASE WHEN arm = 'treated' THEN 'pending' ELSE 'held-out' END AS status
FROM cl
"""))(lambda spark, sf: _campaign(spark, sf).drop("action_key", "neighborhood"))

register("r11_campaign_outcomes", q(_COHORT_SQL + """
SELECT cl.risk_level, count(*) FILTER (WHERE arm = 'treated') AS treated, count(*) FILTER (WHERE arm = 'control') AS control,
       count(*) FILTER (WHERE arm = 'treated' AND l.renewal_status = 'renewed') AS treated_renewed,
       count(*) FILTER (WHERE arm = 'control' AND l.renewal_status = 'renewed') AS control_renewed,
       round(CAST(count(*) FILTER (WHERE arm = 'treated' AND l.renewal_status = 'renewed') AS DOUBLE)
             / nullif(count(*) FILTER (WHERE arm = 'treated'), 0)
             - CAST(count(*) FILTER (WHERE arm = 'control' AND l.renewal_status = 'renewed') AS DOUBLE)
             / nullif(count(*) FILTER (WHERE arm = 'control'), 0), 6) AS uplift
FROM cl JOIN d_lease l ON l.lease_id = cl.lease_id GROUP BY 1
"""))(lambda spark, sf: RT.campaign_outcomes(_campaign(spark, sf), domain(spark, sf).leases()))

# -- A23 / U5 -------------------------------------------------------------------------------
_METRICS = ("high_risk_tenant_count", "average_risk_score", "churn_ratio", "retention_campaign_roi")


def _metric_frames(spark, sf):
    """Rows of each grain with the neighbourhood of their lease's property."""
    dom = domain(spark, sf)
    place = dom.leases().select("lease_id", "property_id").join(
        dom.properties().select("property_id", "neighborhood"), "property_id", "left").select("lease_id", "neighborhood")
    acts = _camp(spark, sf).select("action_id", "lease_id", "renewal_status")
    leases = acts.groupBy("lease_id").agg(F.max("renewal_status").alias("renewal_status"))
    return {"prediction": PR.prediction_history(dom, newest_only=True), "action": acts.join(place, "lease_id"),
            "campaign_lease": leases.join(place, "lease_id")}


def _metrics_sql(dim):
    by, on = (f"{dim}, ", f"IS NOT DISTINCT FROM c.{dim}") if dim else ("", "")
    group = f"GROUP BY {dim}" if dim else ""
    join = (lambda a, b: f"FULL JOIN {b} ON {a}.{dim} IS NOT DISTINCT FROM {b}.{dim}") if dim else (lambda a, b: f"CROSS JOIN {b}")
    head = f"coalesce(p.{dim}, c.{dim}) AS {dim}, " if dim else ""
    return q(_CAMP_SQL + f"""
, acts AS (SELECT c.*, pr.neighborhood FROM camp c JOIN d_lease l ON l.lease_id = c.lease_id
         LEFT JOIN d_property pr ON pr.property_id = l.property_id),
p AS (SELECT {by}count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_tenant_count, round(avg(risk_score), 4) AS average_risk_score,
             round(CAST(count(*) FILTER (WHERE predicted_churn) AS DOUBLE) / nullif(count(*), 0), 6) AS churn_ratio
      FROM d_latest {group}),
c AS (SELECT {by}count(*) AS n, count(DISTINCT lease_id) AS leases,
             count(DISTINCT lease_id) FILTER (WHERE renewal_status = 'renewed') AS renewed FROM acts {group})
SELECT {head}high_risk_tenant_count, average_risk_score, churn_ratio,
       round((coalesce(n, 0) * (CAST(coalesce(renewed, 0) AS DOUBLE) / nullif(leases, 0)) * 4000 - coalesce(n, 0) * 200)
             / nullif(coalesce(n, 0) * 200, 0) * 100, 4) AS retention_campaign_roi
FROM p {join('p', 'c')}
""")


register("a23_ontology_with_roi", _metrics_sql(""))(lambda spark, sf: M.metric_frame(_METRICS, _metric_frames(spark, sf)))
register("a23_ontology_by_neighborhood", _metrics_sql("neighborhood"))(
    lambda spark, sf: M.metric_frame(_METRICS, _metric_frames(spark, sf), ["neighborhood"]))

# -- R4 / R10 -------------------------------------------------------------------------------
register("r04_record_renewal", q("""
, r AS (SELECT *, (rent_cents * (100 + CAST(round(last_rent_increase_pct * 100) AS BIGINT)) + 50) // 100 AS nc
        FROM d_lease WHERE renewal_status = 'renewed')
SELECT lease_id, CAST(end_date + CAST(lease_term_months * 30 AS INTEGER) AS VARCHAR) AS new_end_date,
       CAST(nc AS DOUBLE) / 100 AS new_monthly_rent, renewal_count + 1 AS renewal_count, 'renewed' AS status,
       1 AS history_size,
       round((CAST(nc AS DOUBLE) / 100 - monthly_rent) / nullif(monthly_rent, 0) * 100, 4) AS last_increase_pct
FROM r
"""))(lambda spark, sf: RT.record_renewals(domain(spark, sf).leases()).select(
    "lease_id", "new_end_date", "new_monthly_rent", "renewal_count", "status",
    F.size("rent_increase_history").alias("history_size"),
    F.element_at("rent_increase_history", -1)["increasePercent"].alias("last_increase_pct")))


def r04_history(spark, sf):
    """A tenant's later leases as renewals of the first one: recorded up to 1997, then all of them sent again."""
    leases = domain(spark, sf).leases()
    one = (leases.groupBy("tenant_id").agg(F.min_by("lease_id", F.struct("start_date", "lease_id")).alias("lease_id")))
    first = leases.join(one, ["tenant_id", "lease_id"], "left_semi")
    later = (leases.join(one.withColumnRenamed("lease_id", "first_id"), "tenant_id").filter("lease_id <> first_id")
             .select(F.col("first_id").alias("lease_id"), F.col("start_date").alias("effective_date"),
                     F.col("rent_cents").alias("new_rent_cents"), F.col("lease_term_months").alias("term_months")))
    known = RT.record_renewals(first, later.filter("effective_date < DATE '1997-01-01'"))
    state = (first.drop("renewal_count", "end_date", "monthly_rent").join(
        RT.apply_renewals(first, known), "lease_id"))
    return RT.record_renewals(state, later).select(
        "lease_id", F.col("new_end_date").alias("end_date"), "renewal_count", F.size("rent_increase_history").alias("history_size"),
        F.col("new_monthly_rent").alias("monthly_rent"),
        F.array_join(F.transform("rent_increase_history", lambda e: e["effectiveDate"].cast("string")), ",").alias("dates"),
        F.round(F.aggregate("rent_increase_history", F.lit(0.0), lambda a, e: a + e["newRent"] - e["previousRent"]), 2).alias("rent_gain"))


register("r04_renewal_history", q("""
, f AS (SELECT * FROM d_lease QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date, lease_id) = 1),
s AS (SELECT DISTINCT f.lease_id, l.start_date AS d, l.rent_cents AS c, l.lease_term_months AS t
      FROM f JOIN d_lease l ON l.tenant_id = f.tenant_id AND l.lease_id <> f.lease_id),
g AS (SELECT lease_id, count(*) AS n, last(d + CAST(t * 30 AS INTEGER) ORDER BY d, c, t) AS e, last(c ORDER BY d, c, t) AS c,
             string_agg(CAST(d AS VARCHAR), ',' ORDER BY d, c, t) AS dates FROM s GROUP BY 1)
SELECT f.lease_id, CAST(CAST(g.e AS DATE) AS VARCHAR) AS end_date, f.renewal_count + CAST(g.n AS INTEGER) AS renewal_count,
       CAST(g.n AS INTEGER) AS history_size, CAST(g.c AS DOUBLE) / 100 AS monthly_rent, dates,
       round(CAST(g.c - f.rent_cents AS DOUBLE) / 100, 2) AS rent_gain
FROM f JOIN g ON g.lease_id = f.lease_id
"""))(r04_history)

MANAGER = "managers@example.com"
_SQL_TEXT = lambda s: s.replace("'", "''")
register("r10_outbox", q(_TRIGGER_SQL + f"""
, ok AS (SELECT tr.*, t.email, t.phone, t.first_name, t.full_name, p.address FROM tr
         LEFT JOIN d_tenant t ON t.tenant_id = tr.tenant_id LEFT JOIN d_property p ON p.property_id = tr.property_id
         WHERE error IS NULL)
SELECT lease_id, 'email' AS channel, email AS recipient,
       CASE risk_level WHEN 'HIGH' THEN '{RT.TEMPLATES["HIGH"]}' WHEN 'MEDIUM' THEN '{RT.TEMPLATES["MEDIUM"]}'
            ELSE '{RT.TEMPLATES["LOW"]}' END AS template,
       CASE WHEN risk_level = 'HIGH' THEN '{_SQL_TEXT(RT.SUBJECT_HIGH)}' ELSE '{RT.SUBJECT_OTHER}' END AS subject,
       CAST(NULL AS VARCHAR) AS message
FROM ok WHERE email IS NOT NULL
UNION ALL
SELECT lease_id, 'email', email, 'incentive-offer', '{RT.SUBJECT_INCENTIVE}', NULL
FROM ok WHERE risk_level = 'MEDIUM' AND email IS NOT NULL
UNION ALL
SELECT lease_id, 'email', '{MANAGER}', '{RT.MANAGER_TEMPLATE}', '{RT.SUBJECT_MANAGER}' || full_name || ' - ' || address, NULL
FROM ok WHERE risk_level = 'HIGH'
UNION ALL
SELECT lease_id, 'sms', phone, 'concierge-call', NULL, '{RT.SMS_TEXT[0]}' || first_name || '{_SQL_TEXT(RT.SMS_TEXT[1])}'
FROM ok WHERE risk_level = 'HIGH' AND phone IS NOT NULL
"""))(lambda spark, sf: RT.outbox(_trigger(spark, sf), domain(spark, sf).tenants(), domain(spark, sf).properties(),
                                  default_manager_email=MANAGER, sms_enabled=True))
