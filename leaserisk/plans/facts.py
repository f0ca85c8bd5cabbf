"""Fact table builds D8 (churn predictions) and D9 (retention actions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.functions import scalars as X
from leaserisk.operators import predictions as PR
from leaserisk.operators import retention as RT
from leaserisk.operators import scoring as S
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.retention import _INC_SQL, _INC_VAL
from leaserisk.sources.driver import domain


def prediction_fact(dom):
    h = PR.prediction_history(dom)
    return h.select(
        "prediction_key", F.xxhash64("tenant_id").alias("tenant_key"), F.xxhash64("property_id").alias("property_key"),
        "lease_id", "tenant_id", "property_id",
        X.date_key(F.col("prediction_date")).alias("prediction_date_key"),
        X.date_key(F.col("end_date")).alias("lease_end_date_key"),
        "churn_probability", "risk_score", "risk_level", "predicted_churn", "model_version",
        F.col("confidence").alias("confidence_score"), "monthly_rent", "days_to_expiration", "tenure_days",
        "lease_term_months", "renewal_count", S.risk_factors().alias("risk_factors"), "predicted_at")


register("d08_prediction_fact", q("""
SELECT lease_id, tenant_id, property_id, CAST(strftime(prediction_date, '%Y%m%d') AS INTEGER) AS prediction_date_key,
       CAST(strftime(end_date, '%Y%m%d') AS INTEGER) AS lease_end_date_key, churn_probability, risk_score,
       risk_level, predicted_churn, model_version, confidence AS confidence_score, monthly_rent, days_to_expiration,
       tenure_days, lease_term_months, renewal_count,
       concat_ws(',', CASE WHEN NOT autopay_enabled THEN 'no_autopay' END,
                 CASE WHEN complaint_count > 1 THEN 'complaints' END,
                 CASE WHEN condition_rating < 3 THEN 'poor_condition' END,
                 CASE WHEN property_age > 40 THEN 'old_property' END,
                 CASE WHEN rent_cents * 10 > market_rent_median * 1100 THEN 'rent_above_market' END,
                 CASE WHEN tenure_days < 180 THEN 'short_tenure' END) AS risk_factors,
       strftime(predicted_at, '%Y-%m-%d %H:%M:%S.%f') AS predicted_at
FROM d_hist
"""), headline=True)(lambda spark, sf: prediction_fact(domain(spark, sf))
                     .drop("prediction_key", "tenant_key", "property_key"))


def action_fact(dom):
    acts = RT.action_leases(dom.actions(), dom.leases())
    latest = PR.latest_of(dom).select(
        "lease_id", "risk_score", "risk_level")
    clicks = dom.engagement().filter(F.col("event_type") == "click").select("tenant_id", "ts")
    resp = RT.first_response_within(acts.select("action_id", "tenant_id", F.col("triggered_at").alias("ts")),
                                    clicks, 48)
    j = (acts.join(latest, "lease_id", "left")
         .join(dom.leases().select("lease_id", "rent_cents"), "lease_id", "left")
         .join(resp, "action_id", "left"))
    j = RT.incentive_offer(j)
    has = F.col("risk_score").isNotNull()
    return j.select(
        F.xxhash64("action_id").alias("action_key"), "action_id", "tenant_id", "lease_id",
        X.date_key(F.col("triggered_at")).alias("action_date_key"), "action_type",
        F.col("risk_score").alias("risk_score_at_action"), F.col("risk_level").alias("risk_level_at_action"),
        F.when(has, F.col("incentive_type")).alias("incentive_type"),
        F.when(has, F.col("incentive_value")).alias("incentive_value"),
        F.col("status").alias("action_status"),
        F.col("response_ts").isNotNull().alias("response_received"),
        X.date_key(F.col("response_ts")).alias("response_date_key"),
        F.round((F.unix_micros("response_ts") - F.unix_micros("triggered_at")) / 3.6e9, 4).alias("hours_to_response"),
        (F.col("renewal_status") == "renewed").alias("resulted_in_renewal"),
        F.col("cost").alias("cost_of_action"),
        (F.col("risk_score") * 40).alias("estimated_value"))


register("d09_retention_action_fact", q(f"""
, cur AS (SELECT tenant_id, lease_id, renewal_status FROM d_lease
          QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date DESC, lease_id DESC) = 1),
a AS (SELECT d.*, cur.lease_id, cur.renewal_status FROM d_action d JOIN cur ON cur.tenant_id = d.tenant_id),
r AS (SELECT a.action_id, min(c.ts) AS rts FROM a JOIN events c
        ON c.event_type = 'click' AND c.user_id = a.tenant_id AND c.ts >= a.triggered_at
       AND c.ts <= a.triggered_at + INTERVAL 48 HOUR GROUP BY 1),
x AS (SELECT a.*, lt.risk_score, lt.risk_level, l.rent_cents, r.rts FROM a
      LEFT JOIN d_latest lt ON lt.lease_id = a.lease_id
      LEFT JOIN d_lease l ON l.lease_id = a.lease_id
      LEFT JOIN r ON r.action_id = a.action_id)
SELECT action_id, tenant_id, lease_id, CAST(strftime(triggered_at, '%Y%m%d') AS INTEGER) AS action_date_key,
       action_type, risk_score AS risk_score_at_action, risk_level AS risk_level_at_action,
       CASE WHEN risk_score IS NOT NULL THEN {_INC_SQL} END AS incentive_type,
       CASE WHEN risk_score IS NOT NULL THEN {_INC_VAL} END AS incentive_value,
       status AS action_status, rts IS NOT NULL AS response_received,
       CAST(strftime(rts, '%Y%m%d') AS INTEGER) AS response_date_key,
       round(CAST(epoch_us(rts) - epoch_us(triggered_at) AS DOUBLE) / 3600000000, 4) AS hours_to_response,
       renewal_status = 'renewed' AS resulted_in_renewal, cost AS cost_of_action, risk_score * 40 AS estimated_value
FROM x
"""))(lambda spark, sf: action_fact(domain(spark, sf)).drop("action_key"))
