"""One query per join / window row of the inventory that is otherwise only
part of a larger query (J1-J5, J7, J8, W2-W4, W6, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.operators import features as FE
from leaserisk.operators import predictions as PR
from leaserisk.operators import semantic as SM
from leaserisk.operators import warehouse as WH
from leaserisk.plans.features import _AGG_CTES
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.warehouse import _EVENTS_SQL, _SNAP_SQL, _versions
from leaserisk.sources.driver import domain


def j01(spark, sf):
    dom = domain(spark, sf)
    t = dom.tenants().select("tenant_id", "full_name", "status", "email")
    return (FE.merge_suffixed(dom.leases().select("lease_id", "tenant_id", "status"), t, "tenant_id", "_tenant")
            .select("lease_id", "tenant_id", "status", "status_tenant", "full_name"))


register("j01_lease_tenant_join", q("""
SELECT l.lease_id, l.tenant_id, l.status, t.status AS status_tenant, t.full_name
FROM d_lease l LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id
"""))(j01)


def j02(spark, sf):
    dom = domain(spark, sf)
    p = dom.properties().select("property_id", "zip_code", "neighborhood", "state")
    l = dom.leases().select("lease_id", "property_id", F.lit("lease").alias("state"))
    return FE.merge_suffixed(l, p, "property_id", "_property").select(
        "lease_id", "property_id", "zip_code", "neighborhood", "state", "state_property")


register("j02_lease_property_join", q("""
SELECT l.lease_id, l.property_id, p.zip_code, p.neighborhood, 'lease' AS state, p.state AS state_property
FROM d_lease l LEFT JOIN d_property p ON p.property_id = l.property_id
"""))(j02)

register("j03_payment_aggregate_join", q(_AGG_CTES + """
SELECT c.lease_id, pa.payment_count, pa.max_days_late, pa.total_days_late
FROM d_lease c LEFT JOIN d_pay pa ON pa.lease_id = c.lease_id
"""))(lambda spark, sf: domain(spark, sf).leases().select("lease_id").join(
    FE.payment_aggregates(domain(spark, sf).payments()).select(
        "lease_id", "payment_count", "max_days_late", "total_days_late"), "lease_id", "left"))

register("j04_maintenance_aggregate_join", q(_AGG_CTES + """
SELECT c.lease_id, c.property_id, mn.maintenance_count, mn.high_priority_requests
FROM d_lease c LEFT JOIN d_mnt mn ON mn.property_id = c.property_id
"""))(lambda spark, sf: domain(spark, sf).leases().select("lease_id", "property_id").join(
    FE.maintenance_aggregates(domain(spark, sf).maintenance()).select(
        "property_id", "maintenance_count", "high_priority_requests"), "property_id", "left"))

register("j05_market_asof_join", q("""
SELECT lease_id, zip_code, CAST(data_date AS VARCHAR) AS data_date, market_rent_median, vacancy_rate FROM d_ctx
"""))(lambda spark, sf: FE.lease_context(domain(spark, sf)).select(
    "lease_id", "zip_code", "data_date", "market_rent_median", "vacancy_rate"))


register("j05_market_asof_rows", q("""
SELECT h.lease_id, h.zip_code, CAST(h.prediction_date AS VARCHAR) AS prediction_date, m.market_rent_median, m.vacancy_rate
FROM (SELECT lease_id, zip_code, prediction_date FROM d_hist) h
LEFT JOIN (SELECT p.zip_code, p.prediction_date, m.market_rent_median, m.vacancy_rate
           FROM (SELECT DISTINCT zip_code, prediction_date FROM d_hist) p
           JOIN d_market m ON m.zip_code = p.zip_code AND m.data_date <= p.prediction_date
           QUALIFY row_number() OVER (PARTITION BY p.zip_code, p.prediction_date ORDER BY m.data_date DESC) = 1) m
  ON m.zip_code = h.zip_code AND m.prediction_date = h.prediction_date
"""))(lambda spark, sf: FE.market_as_of_rows(
    PR.prediction_history(domain(spark, sf)).select("lease_id", "zip_code", "prediction_date"),
    domain(spark, sf).market_data(), "lease_id", "prediction_date").select(
        "lease_id", "zip_code", "prediction_date", "market_rent_median", "vacancy_rate"))


def j07(spark, sf):
    dom = domain(spark, sf)
    h = PR.prediction_history(dom).select("lease_id", "prediction_date", "zip_code")
    m = dom.market_data().select("zip_code", "data_date", "vacancy_rate", "market_rent_median")
    return (h.withColumn("data_date", F.trunc("prediction_date", "month"))
            .join(m, ["zip_code", "data_date"], "left")
            .select("lease_id", "prediction_date", "zip_code", "data_date", "vacancy_rate", "market_rent_median"))


register("j07_composite_key_market_join", q("""
SELECT h.lease_id, CAST(h.prediction_date AS VARCHAR) AS prediction_date, h.zip_code,
       CAST(CAST(date_trunc('month', h.prediction_date) AS DATE) AS VARCHAR) AS data_date,
       m.vacancy_rate, m.market_rent_median
FROM d_hist h LEFT JOIN d_market m
  ON m.zip_code = h.zip_code AND m.data_date = CAST(date_trunc('month', h.prediction_date) AS DATE)
"""))(j07)


def j08(spark, sf):
    dom = domain(spark, sf)
    ev = WH.lease_events(dom.leases(), None, with_context=False)
    return (ev.filter(F.col("event_type").isin("RENEWAL", "TERMINATION", "EXPIRATION"))
            .groupBy("lease_id")
            .agg(F.max_by(F.struct("event_type", "event_date"), "event_date").alias("o"))
            .select("lease_id", F.col("o.event_type").alias("outcome_type"),
                    F.col("o.event_date").alias("outcome_date")))


register("j08_latest_outcome", q(_EVENTS_SQL + """
SELECT lease_id, event_type AS outcome_type, CAST(event_date AS VARCHAR) AS outcome_date FROM ev
WHERE event_type IN ('RENEWAL', 'TERMINATION', 'EXPIRATION')
QUALIFY row_number() OVER (PARTITION BY lease_id ORDER BY event_date DESC) = 1
"""))(j08)


def _ev(spark, sf):
    dom = domain(spark, sf)
    return WH.lease_events(dom.leases(), None).filter(F.col("event_type") == "NEW")


register("w02_rent_change", q(_EVENTS_SQL + """
SELECT lease_id, tenant_id, monthly_rent - prev_rent AS rent_change_amount,
       round((monthly_rent - prev_rent) / nullif(prev_rent, 0) * 100, 4) AS rent_change_pct
FROM b
"""))(lambda spark, sf: _ev(spark, sf).select("lease_id", "tenant_id", "rent_change_amount", "rent_change_pct"))

register("w07_renewals_so_far", q(_EVENTS_SQL + """
SELECT lease_id, tenant_id, prior_leases, prior_months FROM b
"""))(lambda spark, sf: _ev(spark, sf).select("lease_id", "tenant_id", "prior_leases", "prior_months"))

register("w04_scd2_end_dates", q(_SNAP_SQL + """
SELECT tenant_id, CAST(effective_date AS VARCHAR) AS effective_date, CAST(end_date AS VARCHAR) AS end_date FROM v
"""))(lambda spark, sf: _versions(spark, sf).select("tenant_id", "effective_date", "end_date"))


def _pb(spark, sf):
    dom = domain(spark, sf)
    return WH.payment_behavior(dom.payments(), dom.leases())


_PB_SQL = """
, m AS (SELECT lease_id, CAST(date_trunc('month', payment_date) AS DATE) AS month, count(*) AS n, sum(days_late) AS d
        FROM d_payment GROUP BY 1, 2),
w AS (SELECT m.*, CAST(d AS DOUBLE) / n AS adl,
             lag(CAST(d AS DOUBLE) / n) OVER (PARTITION BY lease_id ORDER BY month) AS prev,
             CAST(sum(d) OVER (PARTITION BY lease_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
             / sum(n) OVER (PARTITION BY lease_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll
      FROM m)
"""

register("w03_payment_trend", q(_PB_SQL + """
SELECT lease_id, CAST(month AS VARCHAR) AS month,
       CASE WHEN prev IS NULL THEN 'STABLE' WHEN adl - prev < -1 THEN 'IMPROVING'
            WHEN adl - prev > 1 THEN 'DECLINING' ELSE 'STABLE' END AS payment_trend
FROM w
"""))(lambda spark, sf: _pb(spark, sf).select("lease_id", "month", "payment_trend"))

register("w06_rolling_lateness", q(_PB_SQL + """
SELECT lease_id, CAST(month AS VARCHAR) AS month, round(roll, 4) AS rolling_3m_days_late FROM w
"""))(lambda spark, sf: _pb(spark, sf).select("lease_id", "month", "rolling_3m_days_late"))


register("j18_link_path_counts", q("""
SELECT p.neighborhood, count(*) AS leases, count(DISTINCT l.tenant_id) AS tenants
FROM d_tenant t JOIN d_lease l ON l.tenant_id = t.tenant_id JOIN d_property p ON p.property_id = l.property_id
GROUP BY 1
"""))(lambda spark, sf: SM.traverse_links(domain(spark, sf), domain(spark, sf).tenants().select("tenant_id"),
                                          ["tenant_leases", "lease_property"])
      .groupBy("neighborhood").agg(F.count(F.lit(1)).alias("leases"),
                                   F.countDistinct("tenant_id").alias("tenants")))
