"""Semantic-layer queries (J9-J13, J18, J19, F16/F19/F20) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.functions import scalars as X
from leaserisk.operators import predictions as PR
from leaserisk.operators import semantic as SM
from leaserisk.operators import warehouse as WH
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.warehouse import _EVENTS_SQL
from leaserisk.sources.driver import domain


def _pred_explore(spark, sf):
    dom = domain(spark, sf)
    base = PR.prediction_history(dom).select(*PR.PRED_COLS)
    return SM.Explore(base, "prediction_key", [
        SM.Join("tenants", dom.tenants().select("tenant_id", "employment_status", "primary_payment_method"),
                ["tenant_id"]),
        SM.Join("properties", dom.properties().select("property_id", "neighborhood", "property_type", "city"),
                ["property_id"]),
        SM.Join("actions", dom.actions().select("tenant_id", "action_type", F.col("status").alias("action_status")),
                ["tenant_id"], "one_to_many"),
    ])


register("j10_explore_predictions", q("""
SELECT p.neighborhood, t.employment_status, count(*) AS count,
       count(*) FILTER (WHERE h.risk_level = 'HIGH') AS count_high_risk,
       round(avg(h.risk_score), 4) AS average_risk_score
FROM d_hist h LEFT JOIN d_tenant t ON t.tenant_id = h.tenant_id
LEFT JOIN d_property p ON p.property_id = h.property_id
GROUP BY 1, 2
"""), headline=True)(lambda spark, sf: SM.query(_pred_explore(spark, sf), ["neighborhood", "employment_status"],
                                                ["count", "count_high_risk", "average_risk_score"]))

register("j12_explore_campaigns", q("""
, j AS (SELECT DISTINCT h.lease_id, h.prediction_date, h.risk_level, h.risk_score, a.action_type
        FROM d_hist h LEFT JOIN d_action a ON a.tenant_id = h.tenant_id)
SELECT action_type, risk_level, count(*) AS count, round(avg(risk_score), 4) AS average_risk_score
FROM j GROUP BY 1, 2
"""))(lambda spark, sf: SM.query(_pred_explore(spark, sf), ["action_type", "risk_level"],
                                 ["count", "average_risk_score"]))


def j11(spark, sf):
    dom = domain(spark, sf)
    hist = PR.prediction_history(dom)
    ev = WH.lease_events(dom.leases(), None, with_context=False).select("event_key", "lease_id", "property_id",
                                                                       "event_type")
    ex = SM.Explore(ev, "event_key", [
        SM.Join("properties", dom.properties().select("property_id", "property_type"), ["property_id"]),
        SM.Join("predictions", hist.select("lease_id", "risk_level"), ["lease_id"], "one_to_many"),
    ])
    return SM.query(ex, ["event_type", "risk_level"], ["count"])


register("j11_explore_lease_events", q(_EVENTS_SQL + """
, j AS (SELECT DISTINCT e.lease_id, e.event_type, e.event_date, h.risk_level
        FROM ev e LEFT JOIN d_hist h ON h.lease_id = e.lease_id)
SELECT event_type, risk_level, count(*) AS count FROM j GROUP BY 1, 2
"""))(j11)


def j13(spark, sf):
    dom = domain(spark, sf)
    base = PR.prediction_history(dom).select("prediction_key", "tenant_id", "risk_level")
    return SM.fanout_compare(base, dom.actions().select("tenant_id", "action_id"), "tenant_id",
                             "prediction_key", "risk_level")


register("j13_fanout_safe_measures", q("""
, j AS (SELECT h.lease_id, h.prediction_date, h.risk_level, a.action_id
        FROM d_hist h LEFT JOIN d_action a ON a.tenant_id = h.tenant_id),
s AS (SELECT risk_level, count(*) AS predictions
      FROM (SELECT DISTINCT lease_id, prediction_date, risk_level FROM j) GROUP BY 1),
n AS (SELECT risk_level, count(*) AS joined_rows FROM j GROUP BY 1)
SELECT coalesce(s.risk_level, n.risk_level) AS risk_level, s.predictions, n.joined_rows
FROM s FULL JOIN n ON s.risk_level = n.risk_level
"""))(j13)


def j18(spark, sf):
    dom = domain(spark, sf)
    return (SM.traverse(dom.tenants().select("tenant_id"),
                        [(dom.leases().select("tenant_id", "lease_id", "property_id"), "tenant_id"),
                         (dom.properties().select("property_id", "neighborhood"), "property_id")])
            .select("tenant_id", "lease_id", "property_id", "neighborhood"))


register("j18_link_traversal", q("""
SELECT t.tenant_id, l.lease_id, p.property_id, p.neighborhood
FROM d_tenant t JOIN d_lease l ON l.tenant_id = t.tenant_id JOIN d_property p ON p.property_id = l.property_id
"""))(j18)


def j09(spark, sf):
    dom = domain(spark, sf)
    latest = PR.latest_of(dom)
    docs = SM.lease_documents(dom.leases(), dom.tenants(), dom.properties(), latest)
    entry = F.struct(F.col("end_date").alias("effectiveDate"), F.col("monthly_rent").alias("newRent"))
    return docs.select(
        "lease_id",
        F.col("tenant.full_name").alias("tenant_full_name"),
        F.col("property.address").alias("property_address"),
        X.geopoint(F.col("property.latitude"), F.col("property.longitude"))["lat"].alias("geo_lat"),
        F.col("churnPrediction.riskLevel").alias("risk_level"),
        F.size(X.append_struct(F.lit(None).cast("array<struct<effectiveDate:date,newRent:double>>"), entry))
        .alias("history_size"))


register("j09_populate_lease", q("""
SELECT l.lease_id, t.full_name AS tenant_full_name, p.address AS property_address, p.latitude AS geo_lat,
       l.risk_level, 1 AS history_size
FROM d_lease_pred l LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id
LEFT JOIN d_property p ON p.property_id = l.property_id
"""))(j09)


def j19(spark, sf):
    dom = domain(spark, sf)
    latest = PR.latest_of(dom)
    d = SM.tenant_detail(dom.tenants(), dom.leases(), dom.payments(), latest)
    item = lambda x: F.concat(x["date"].cast("string"), F.lit(":"),
                              F.round(x["amount"] * 100).cast("long").cast("string"))
    return d.select("tenant_id", "full_name",
                    F.col("current_lease.lease_id").alias("current_lease_id"),
                    F.col("current_lease.monthly_rent").alias("current_rent"),
                    "lease_count", "risk_level", "total_payments", "on_time_payments",
                    F.array_join(F.transform("recent_payments", item), ";").alias("recent_payments"))


register("j19_tenant_detail", q("""
, cur AS (SELECT tenant_id, lease_id, monthly_rent, count(*) OVER (PARTITION BY tenant_id) AS lease_count
          FROM d_lease
          QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date DESC, lease_id DESC) = 1),
pay AS (SELECT l.tenant_id, p.payment_date, p.amount, p.days_late
        FROM d_payment p JOIN d_lease l ON l.lease_id = p.lease_id),
tot AS (SELECT tenant_id, count(*) AS total_payments, count(*) FILTER (WHERE days_late <= 0) AS on_time_payments
        FROM pay GROUP BY 1),
rk AS (SELECT tenant_id, payment_date, amount,
              row_number() OVER (PARTITION BY tenant_id ORDER BY payment_date DESC, amount DESC) AS rn FROM pay),
rec AS (SELECT tenant_id,
               string_agg(CAST(payment_date AS VARCHAR) || ':' || CAST(CAST(round(amount * 100) AS BIGINT) AS VARCHAR),
                          ';' ORDER BY rn) AS recent_payments
        FROM rk WHERE rn <= 5 GROUP BY 1)
SELECT t.tenant_id, t.full_name, c.lease_id AS current_lease_id, c.monthly_rent AS current_rent, c.lease_count,
       lt.risk_level, tot.total_payments, tot.on_time_payments, rec.recent_payments
FROM d_tenant t LEFT JOIN cur c ON c.tenant_id = t.tenant_id
LEFT JOIN d_latest lt ON lt.lease_id = c.lease_id
LEFT JOIN tot ON tot.tenant_id = t.tenant_id
LEFT JOIN rec ON rec.tenant_id = t.tenant_id
"""))(j19)


register("j19_property_detail", q("""
, lr AS (SELECT l.property_id, count(*) FILTER (WHERE l.status = 'active') AS active_leases,
                round(avg(lt.risk_score), 4) AS avg_risk_score,
                count(*) FILTER (WHERE lt.risk_level = 'HIGH') AS high_risk_leases
         FROM d_lease l LEFT JOIN d_latest lt ON lt.lease_id = l.lease_id GROUP BY 1),
mc AS (SELECT property_id, count(*) AS maintenance_requests FROM d_maint GROUP BY 1),
rk AS (SELECT property_id, request_date, priority,
              row_number() OVER (PARTITION BY property_id ORDER BY request_date DESC, request_id DESC) AS rn
       FROM d_maint),
rec AS (SELECT property_id, string_agg(CAST(request_date AS VARCHAR) || ':' || priority, ';' ORDER BY rn)
               AS recent_requests FROM rk WHERE rn <= 3 GROUP BY 1)
SELECT p.property_id, p.address, p.neighborhood, lr.active_leases, lr.avg_risk_score, lr.high_risk_leases,
       mc.maintenance_requests, rec.recent_requests
FROM d_property p LEFT JOIN lr ON lr.property_id = p.property_id
LEFT JOIN mc ON mc.property_id = p.property_id LEFT JOIN rec ON rec.property_id = p.property_id
"""))(lambda spark, sf: SM.property_detail(domain(spark, sf).properties(), domain(spark, sf).leases(),
                                           PR.latest_of(domain(spark, sf)),
                                           domain(spark, sf).maintenance()))


def j19_lease(spark, sf):
    dom = domain(spark, sf)
    d = SM.lease_detail(dom.leases(), dom.tenants(), dom.properties(), dom.payments(),
                        PR.latest_of(dom))
    item = lambda x: F.concat(x["date"].cast("string"), F.lit(":"),
                              F.round(x["amount"] * 100).cast("long").cast("string"))
    return d.select("lease_id", "full_name", "address", "end_date", "monthly_rent", "status", "renewal_status", "risk_score",
                    "risk_level", "total_payments", "on_time_payments",
                    F.array_join(F.transform("recent_payments", item), ";").alias("recent_payments"))


register("j19_lease_detail", q("""
, tot AS (SELECT lease_id, count(*) AS total_payments, count(*) FILTER (WHERE days_late <= 0) AS on_time_payments
          FROM d_payment GROUP BY 1),
rk AS (SELECT lease_id, payment_date, amount,
              row_number() OVER (PARTITION BY lease_id ORDER BY payment_date DESC, amount DESC) AS rn FROM d_payment),
rec AS (SELECT lease_id,
               string_agg(CAST(payment_date AS VARCHAR) || ':' || CAST(CAST(round(amount * 100) AS BIGINT) AS VARCHAR),
                          ';' ORDER BY rn) AS recent_payments
        FROM rk WHERE rn <= 5 GROUP BY 1)
SELECT l.lease_id, t.full_name, p.address, CAST(l.end_date AS VARCHAR) AS end_date, l.monthly_rent, l.status, l.renewal_status,
       lt.risk_score, lt.risk_level, tot.total_payments, tot.on_time_payments, rec.recent_payments
FROM d_lease l LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id LEFT JOIN d_property p ON p.property_id = l.property_id
LEFT JOIN d_latest lt ON lt.lease_id = l.lease_id LEFT JOIN tot ON tot.lease_id = l.lease_id
LEFT JOIN rec ON rec.lease_id = l.lease_id
"""))(j19_lease)
