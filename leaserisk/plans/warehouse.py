"""Warehouse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.operators import predictions as PR
from leaserisk.operators import warehouse as WH
from leaserisk.operators.windows import dealt, tasks_for
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.sources.driver import domain

A = "DATE '1999-01-01'"


# -- D1 -------------------------------------------------------------------------
register("d01_date_dim", q("""
, r AS (SELECT min(start_date) AS lo, max(end_date) AS hi FROM d_lease),
dd AS (SELECT CAST(g AS DATE) AS date
       FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS g
             FROM r))
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, CAST(date AS VARCHAR) AS date,
       isodow(date) AS day_of_week, dayname(date) AS day_name, day(date) AS day_of_month,
       dayofyear(date) AS day_of_year, weekofyear(date) AS week_of_year, month(date) AS month,
       monthname(date) AS month_name, quarter(date) AS quarter, year(date) AS year,
       isodow(date) >= 6 AS is_weekend,
       month(date) * 100 + day(date) IN (101, 704, 1225) AS is_holiday,
       CASE WHEN month(date) >= 7 THEN year(date) + 1 ELSE year(date) END AS fiscal_year,
       CAST(((month(date) - 7 + 12) % 12) // 3 + 1 AS INTEGER) AS fiscal_quarter
FROM dd
"""))(lambda spark, sf: WH.date_dim(domain(spark, sf).leases()))

# -- D3 / D4 / D5 -------------------------------------------------------------------
register("d03_tenant_dim", q(f"""
SELECT tenant_id, first_name, last_name, concat_ws(' ', first_name, last_name) AS full_name, email, phone,
       1999 - year(date_of_birth) - CASE WHEN 101 < month(date_of_birth) * 100 + day(date_of_birth)
                                         THEN 1 ELSE 0 END AS age,
       household_size, annual_income,
       CASE WHEN annual_income < 50000 THEN '<50k' WHEN annual_income < 75000 THEN '50k-75k'
            WHEN annual_income < 100000 THEN '75k-100k' WHEN annual_income < 125000 THEN '100k-125k'
            ELSE '125k+' END AS income_bracket,
       employment_status,
       CAST(CAST(account_created_at AS DATE) AS VARCHAR) AS account_created_date,
       CAST(date_diff('day', CAST(account_created_at AS DATE), {A}) AS INTEGER) AS account_tenure_days,
       autopay_enabled, primary_payment_method,
       CASE WHEN annual_income >= 100000 THEN 'premium'
            WHEN date_diff('day', CAST(account_created_at AS DATE), {A}) >= 1825 THEN 'established'
            ELSE 'standard' END AS tenant_segment,
       CAST(CAST(account_created_at AS DATE) AS VARCHAR) AS effective_date,
       CAST(NULL AS VARCHAR) AS end_date, true AS is_current
FROM d_tenant
"""))(lambda spark, sf: WH.tenant_dim(domain(spark, sf).tenants()).drop("tenant_key"))

register("d04_property_dim", q("""
SELECT property_id, address, city, state, zip_code, neighborhood, square_feet,
       CASE WHEN square_feet < 1200 THEN '<1200' WHEN square_feet < 1600 THEN '1200-1599'
            WHEN square_feet < 2000 THEN '1600-1999' ELSE '2000+' END AS sqft_range,
       bedrooms, bathrooms, year_built, 1999 - year_built AS property_age,
       CASE WHEN 1999 - year_built <= 10 THEN '0-10' WHEN 1999 - year_built <= 25 THEN '11-25'
            WHEN 1999 - year_built <= 40 THEN '26-40' ELSE '40+' END AS age_bracket,
       property_type, has_garage, has_yard, has_ac,
       CAST(has_garage AS INTEGER) + CAST(has_yard AS INTEGER) + CAST(has_ac AS INTEGER) AS amenity_score,
       condition_rating, location_score, school_rating, latitude, longitude
FROM d_property
"""))(lambda spark, sf: WH.property_dim(domain(spark, sf).properties()).drop("property_key"))

register("d05_market_dim", q("""
, g AS (SELECT *, CAST(round(rent_growth_1yr_pct * 100) AS INTEGER) AS gi FROM d_market)
SELECT zip_code, CAST(data_date AS VARCHAR) AS data_date, market_rent_median, vacancy_rate,
       CASE WHEN vacancy_pct <= 4 THEN 'low' WHEN vacancy_pct <= 7 THEN 'medium' ELSE 'high' END AS vacancy_tier,
       rent_growth_1yr_pct,
       CASE WHEN gi < 2 THEN 'slow' WHEN gi < 4 THEN 'moderate' ELSE 'fast' END AS rent_growth_tier,
       median_hh_income,
       CASE WHEN median_hh_income < 70000 THEN 'low' WHEN median_hh_income < 80000 THEN 'middle'
            ELSE 'high' END AS income_tier,
       population_growth_rate,
       least(100, greatest(0, 50 + 5 * gi - 3 * vacancy_pct
             + CAST(trunc((median_hh_income - 60000) / 1000) AS INTEGER))) AS market_health_score
FROM g
"""))(lambda spark, sf: WH.market_dim(domain(spark, sf).market_data()).drop("market_key"))

# -- D2 / W4 ----------------------------------------------------------------------
_SNAP_SQL = """
, s0 AS (SELECT l.tenant_id, l.start_date AS snapshot_date,
                CAST(1 + l.lease_id % 5 AS INTEGER) AS household_size,
                t.employment_status, t.primary_payment_method
         FROM d_lease l JOIN d_tenant t ON t.tenant_id = l.tenant_id),
s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY tenant_id, snapshot_date
          ORDER BY household_size, employment_status, primary_payment_method) = 1),
s2 AS (SELECT s1.*,
              lag(household_size) OVER w AS p_hs, lag(employment_status) OVER w AS p_es,
              lag(primary_payment_method) OVER w AS p_pm,
              row_number() OVER w AS rn
       FROM s1 WINDOW w AS (PARTITION BY tenant_id ORDER BY snapshot_date)),
v AS (SELECT tenant_id, household_size, employment_status, primary_payment_method,
             snapshot_date AS effective_date,
             lead(snapshot_date) OVER (PARTITION BY tenant_id ORDER BY snapshot_date) AS end_date
      FROM s2
      WHERE rn = 1 OR p_hs IS DISTINCT FROM household_size OR p_es IS DISTINCT FROM employment_status
         OR p_pm IS DISTINCT FROM primary_payment_method)
"""


def _versions(spark, sf, parts=None):
    dom = domain(spark, sf)
    return WH.scd2_from_history(WH.tenant_snapshots(dom.tenants(), dom.leases()), parts=parts)


register("d02_scd2_tenant_versions", q(_SNAP_SQL + """
SELECT tenant_id, household_size, employment_status, primary_payment_method,
       CAST(effective_date AS VARCHAR) AS effective_date, CAST(end_date AS VARCHAR) AS end_date,
       end_date IS NULL AS is_current
FROM v
"""))(lambda spark, sf: _versions(spark, sf).drop("version_key"))


def d02_merge(spark, sf):
    """D2 incremental: versions up to a cut-off merged with each tenant's last snapshot."""
    dom = domain(spark, sf)
    snap = WH.tenant_snapshots(dom.tenants(), dom.leases())
    current = WH.scd2_from_history(snap.filter(F.col("snapshot_date") <= F.lit(MERGE_CUT).cast("date")))
    last = (snap.groupBy("tenant_id").agg(F.max_by(F.struct(*WH.SCD_TRACKED), F.struct("snapshot_date", *[
        F.col(c) for c in WH.SCD_TRACKED])).alias("r")).select("tenant_id", "r.*"))
    return WH.scd2_merge(current, last, "tenant_id", WH.SCD_TRACKED).drop("version_key")


MERGE_CUT = "1996-12-31"
register("d02_scd2_merge", q(_SNAP_SQL.replace(
    "JOIN d_tenant t ON t.tenant_id = l.tenant_id)", f"JOIN d_tenant t ON t.tenant_id = l.tenant_id WHERE l.start_date <= DATE '{MERGE_CUT}')") + f"""
, inc AS (SELECT l.tenant_id, CAST(1 + l.lease_id % 5 AS INTEGER) AS household_size, t.employment_status, t.primary_payment_method
          FROM d_lease l JOIN d_tenant t ON t.tenant_id = l.tenant_id
          QUALIFY row_number() OVER (PARTITION BY l.tenant_id ORDER BY l.start_date DESC, 1 + l.lease_id % 5 DESC) = 1),
ch AS (SELECT inc.*, v.tenant_id IS NOT NULL AS known FROM inc LEFT JOIN v ON v.tenant_id = inc.tenant_id AND v.end_date IS NULL
       WHERE v.tenant_id IS NULL OR v.household_size IS DISTINCT FROM inc.household_size
          OR v.employment_status IS DISTINCT FROM inc.employment_status
          OR v.primary_payment_method IS DISTINCT FROM inc.primary_payment_method),
m AS (SELECT v.tenant_id, v.household_size, v.employment_status, v.primary_payment_method, v.effective_date,
             CASE WHEN v.end_date IS NULL AND ch.known THEN DATE '1999-01-01' ELSE v.end_date END AS end_date,
             v.end_date IS NULL AND NOT coalesce(ch.known, false) AS is_current
      FROM v LEFT JOIN ch ON ch.tenant_id = v.tenant_id
      UNION ALL SELECT tenant_id, household_size, employment_status, primary_payment_method, DATE '1999-01-01', NULL, true FROM ch)
SELECT tenant_id, household_size, employment_status, primary_payment_method, CAST(effective_date AS VARCHAR) AS effective_date,
       CAST(end_date AS VARCHAR) AS end_date, is_current FROM m
"""))(d02_merge)


def j17(spark, sf):
    dom = domain(spark, sf)
    parts = tasks_for(dom.raw("lineitem"))
    pay = dealt(dom.payments(), parts, "lease_id").join(
        dealt(dom.leases().select("lease_id", "tenant_id"), parts, "lease_id"), "lease_id")
    return (WH.scd2_lookup(pay, _versions(spark, sf, parts), "tenant_id", "payment_date", parts)
            .select("lease_id", "tenant_id", "payment_date", "amount", "household_size",
                    "effective_date"))


register("j17_scd2_asof_lookup", q(_SNAP_SQL + """
SELECT p.lease_id, l.tenant_id, CAST(p.payment_date AS VARCHAR) AS payment_date, p.amount,
       v.household_size, CAST(v.effective_date AS VARCHAR) AS effective_date
FROM d_payment p JOIN d_lease l ON l.lease_id = p.lease_id
LEFT JOIN v ON v.tenant_id = l.tenant_id AND v.effective_date <= p.payment_date
           AND (v.end_date IS NULL OR p.payment_date < v.end_date)
"""))(j17)

# -- D6 / W3 / W6 -------------------------------------------------------------------
register("d06_payment_behavior", q("""
, m AS (SELECT lease_id, CAST(date_trunc('month', payment_date) AS DATE) AS month,
               count(*) AS total_payments,
               CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_amount,
               count(*) FILTER (WHERE days_late <= 0) AS on_time_payments,
               count(*) FILTER (WHERE days_late > 0) AS late_payments,
               sum(days_late) AS d, max(days_late) AS max_days_late, sum(late_fee) AS total_late_fees
        FROM d_payment GROUP BY 1, 2),
w AS (SELECT m.*, CAST(d AS DOUBLE) / total_payments AS adl,
             lag(CAST(d AS DOUBLE) / total_payments) OVER (PARTITION BY lease_id ORDER BY month) AS prev,
             CAST(sum(d) OVER (PARTITION BY lease_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
                  AS DOUBLE)
             / sum(total_payments) OVER (PARTITION BY lease_id ORDER BY month
                                         ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll
      FROM m)
SELECT l.tenant_id, w.lease_id, CAST(strftime(month, '%Y%m%d') AS INTEGER) AS month_key,
       CAST(month AS VARCHAR) AS month, total_payments, total_amount, on_time_payments, late_payments,
       round(adl, 4) AS avg_days_late, max_days_late, total_late_fees,
       round(CAST(on_time_payments AS DOUBLE) * 100 / total_payments, 2) AS payment_consistency_score,
       round(roll, 4) AS rolling_3m_days_late,
       CASE WHEN prev IS NULL THEN 'STABLE' WHEN adl - prev < -1 THEN 'IMPROVING'
            WHEN adl - prev > 1 THEN 'DECLINING' ELSE 'STABLE' END AS payment_trend
FROM w LEFT JOIN d_lease l ON l.lease_id = w.lease_id
"""), headline=True)(lambda spark, sf: WH.payment_behavior(domain(spark, sf).payments(),
                                                           domain(spark, sf).leases()).drop("behavior_key"))

# -- D7 / W2 / W7 -------------------------------------------------------------------
_EVENTS_SQL = f"""
, b AS (SELECT l.*,
          lag(monthly_rent) OVER (PARTITION BY tenant_id ORDER BY start_date, lease_id) AS prev_rent,
          count(*) OVER (PARTITION BY tenant_id ORDER BY start_date, lease_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_leases,
          CAST(coalesce(sum(lease_term_months) OVER (PARTITION BY tenant_id ORDER BY start_date, lease_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_months
        FROM d_lease l),
e AS (SELECT b.*, start_date AS event_date, 'NEW' AS event_type FROM b
      UNION ALL
      SELECT b.*, end_date AS event_date,
             CASE WHEN renewal_status = 'renewed' THEN 'RENEWAL' ELSE 'EXPIRATION' END AS event_type
      FROM b WHERE end_date <= {A}),
pj AS (SELECT e.lease_id, e.event_date, h.predicted_churn, h.risk_score
       FROM e JOIN d_hist h ON h.lease_id = e.lease_id AND h.prediction_date <= e.event_date
       QUALIFY row_number() OVER (PARTITION BY e.lease_id, e.event_date ORDER BY h.prediction_date DESC) = 1),
ev AS (SELECT e.*, pj.predicted_churn AS was_predicted_churn, pj.risk_score AS risk_score_at_event
       FROM e LEFT JOIN pj ON pj.lease_id = e.lease_id AND pj.event_date = e.event_date)
"""


def _events(spark, sf):
    dom = domain(spark, sf)
    return WH.lease_events(dom.leases(), PR.prediction_history(dom))


register("d07_lease_events", q(_EVENTS_SQL + """
SELECT lease_id, tenant_id, property_id, CAST(event_date AS VARCHAR) AS event_date, event_type,
       monthly_rent, security_deposit, lease_term_months,
       CASE WHEN event_type = 'NEW' THEN monthly_rent - prev_rent END AS rent_change_amount,
       CASE WHEN event_type = 'NEW' THEN round((monthly_rent - prev_rent) / nullif(prev_rent, 0) * 100, 4)
       END AS rent_change_pct,
       prior_leases, prior_months,
       CASE WHEN event_type IN ('TERMINATION', 'EXPIRATION') THEN 1 WHEN event_type = 'RENEWAL' THEN 0
       END AS churned,
       was_predicted_churn, risk_score_at_event
FROM ev
"""))(lambda spark, sf: _events(spark, sf).drop("event_key"))

# -- D10 / J6 / J7 / J8 / P14 / A24 / A26 ----------------------------------------------
_TRAIN_SQL = _EVENTS_SQL + f"""
, o AS (SELECT lease_id, event_type AS outcome_type, event_date AS outcome_date FROM ev
        WHERE event_type IN ('RENEWAL', 'TERMINATION', 'EXPIRATION')
        QUALIFY row_number() OVER (PARTITION BY lease_id ORDER BY event_date DESC) = 1),
tv AS (
  SELECT h.lease_id, h.tenant_id, h.property_id, h.prediction_date, h.risk_score, h.churn_probability,
         h.risk_level, h.predicted_churn,
         1999 - year(t.date_of_birth) - CASE WHEN 101 < month(t.date_of_birth) * 100 + day(t.date_of_birth)
                                             THEN 1 ELSE 0 END AS age,
         CASE WHEN t.annual_income < 50000 THEN '<50k' WHEN t.annual_income < 75000 THEN '50k-75k'
              WHEN t.annual_income < 100000 THEN '75k-100k' WHEN t.annual_income < 125000 THEN '100k-125k'
              ELSE '125k+' END AS income_bracket,
         1999 - p.year_built AS property_age,
         CAST(p.has_garage AS INTEGER) + CAST(p.has_yard AS INTEGER) + CAST(p.has_ac AS INTEGER) AS amenity_score,
         m.vacancy_rate, m.market_rent_median,
         o.outcome_type, o.outcome_date,
         CASE WHEN o.outcome_type IN ('TERMINATION', 'EXPIRATION') THEN 1 WHEN o.outcome_type = 'RENEWAL' THEN 0
         END AS churned,
         o.outcome_type IS NOT NULL AS training_set
  FROM d_hist h
  JOIN d_tenant t ON t.tenant_id = h.tenant_id
  LEFT JOIN d_property p ON p.property_id = h.property_id
  LEFT JOIN d_market m ON m.zip_code = p.zip_code
                      AND m.data_date = CAST(date_trunc('month', h.prediction_date) AS DATE)
  LEFT JOIN o ON o.lease_id = h.lease_id)
"""


def training_view(spark, sf):
    dom = domain(spark, sf)
    hist = PR.prediction_history(dom)
    preds = hist.select(*PR.PRED_COLS)
    return WH.training_view(preds, WH.tenant_dim(dom.tenants()), WH.property_dim(dom.properties()),
                            dom.market_data(), WH.lease_events(dom.leases(), None, with_context=False))


_TV_COLS = ["lease_id", "tenant_id", "property_id", "prediction_date", "risk_score", "churn_probability",
            "risk_level", "age", "income_bracket", "property_age", "amenity_score", "vacancy_rate",
            "market_rent_median", "outcome_type", "outcome_date", "churned", "training_set"]

register("d10_training_view", q(_TRAIN_SQL + """
SELECT lease_id, tenant_id, property_id, CAST(prediction_date AS VARCHAR) AS prediction_date, risk_score,
       churn_probability, risk_level, age, income_bracket, property_age, amenity_score, vacancy_rate,
       market_rent_median, outcome_type, CAST(outcome_date AS VARCHAR) AS outcome_date, churned, training_set
FROM tv
"""), headline=True)(lambda spark, sf: training_view(spark, sf).select(*_TV_COLS))

register("p14_training_rows", q(_TRAIN_SQL + """
SELECT lease_id, CAST(prediction_date AS VARCHAR) AS prediction_date, churned FROM tv WHERE training_set
"""))(lambda spark, sf: training_view(spark, sf).filter("training_set")
      .select("lease_id", "prediction_date", "churned"))

# -- J16: role-playing date dimension ---------------------------------------------------
def j16(spark, sf):
    dom = domain(spark, sf)
    dd = WH.date_dim(dom.leases())
    pdim = dd.select(F.col("date").alias("prediction_date"), F.col("day_name").alias("prediction_day_name"),
                     F.col("fiscal_quarter").alias("prediction_fiscal_quarter"))
    edim = dd.select(F.col("date").alias("end_date"), F.col("day_name").alias("end_day_name"),
                     F.col("is_weekend").alias("end_is_weekend"))
    h = PR.prediction_history(dom).select("lease_id", "prediction_date", "end_date")
    return h.join(pdim, "prediction_date", "left").join(edim, "end_date", "left")


register("j16_role_playing_dates", q("""
SELECT h.lease_id, CAST(h.prediction_date AS VARCHAR) AS prediction_date, CAST(h.end_date AS VARCHAR) AS end_date,
       dayname(h.prediction_date) AS prediction_day_name,
       CAST(((month(h.prediction_date) - 7 + 12) % 12) // 3 + 1 AS INTEGER) AS prediction_fiscal_quarter,
       dayname(h.end_date) AS end_day_name, isodow(h.end_date) >= 6 AS end_is_weekend
FROM d_hist h
"""))(j16)


# -- D2 for the property dimension ---------------------------------------------------------
def property_versions(spark, sf):
    """Property snapshots at each maintenance request; the tracked attribute is
    the latest request priority (our rule).  Same skew-safe SCD2 builder."""
    m = domain(spark, sf).maintenance().select("property_id", F.col("request_date").alias("snapshot_date"),
                                               F.col("priority").alias("last_priority"))
    return WH.scd2_from_history(m, "property_id", "snapshot_date", ["last_priority"])


register("d02_scd2_property_versions", q("""
, s1 AS (SELECT property_id, request_date AS snapshot_date, priority AS last_priority FROM d_maint
         QUALIFY row_number() OVER (PARTITION BY property_id, request_date ORDER BY priority) = 1),
s2 AS (SELECT s1.*, lag(last_priority) OVER (PARTITION BY property_id ORDER BY snapshot_date) AS prev,
              row_number() OVER (PARTITION BY property_id ORDER BY snapshot_date) AS rn FROM s1),
v AS (SELECT property_id, last_priority, snapshot_date AS effective_date,
             lead(snapshot_date) OVER (PARTITION BY property_id ORDER BY snapshot_date) AS end_date
      FROM s2 WHERE rn = 1 OR prev IS DISTINCT FROM last_priority)
SELECT property_id, last_priority, CAST(effective_date AS VARCHAR) AS effective_date,
       CAST(end_date AS VARCHAR) AS end_date, end_date IS NULL AS is_current
FROM v
"""))(lambda spark, sf: property_versions(spark, sf).drop("version_key"))
