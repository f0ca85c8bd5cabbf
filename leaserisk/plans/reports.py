"""Report queries (A3-A4, A7-A22, A28, K3, K4) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.functions import measures as M
from leaserisk.operators import predictions as PR
from leaserisk.operators import reports as R
from leaserisk.operators.ml import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.warehouse import _TRAIN_SQL
from leaserisk.sources.driver import domain


def _hist(spark, sf):
    return PR.prediction_history(domain(spark, sf))


def _lp(spark, sf):
    return PR.leases_with_prediction(domain(spark, sf))


def _latest(spark, sf):
    return PR.prediction_history(domain(spark, sf), newest_only=True)


# -- A3 / A4 / A28 -----------------------------------------------------------
_SUMMARY_SQL = """
, s AS (
  SELECT count(*) AS total_active,
         count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
         count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
         count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
         count(*) FILTER (WHERE risk_level IS NULL) AS unpredicted
  FROM d_lease_pred WHERE status = 'active')
"""


def _pct(c):
    return (f"CASE WHEN total_active = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE CAST({c} AS DOUBLE) / total_active * 100 END")


register("a03_risk_summary", q(_SUMMARY_SQL + f"""
SELECT total_active, high_risk, medium_risk, low_risk, unpredicted,
       {_pct('high_risk')} AS high_risk_pct FROM s
"""), headline=True)(lambda spark, sf: R.risk_summary(_lp(spark, sf)))

register("a04_risk_summary_extended", q(_SUMMARY_SQL + f"""
SELECT total_active, high_risk, medium_risk, low_risk, unpredicted,
       {_pct('high_risk')} AS high_risk_pct, {_pct('medium_risk')} AS medium_risk_pct,
       {_pct('low_risk')} AS low_risk_pct, high_risk * 4000 AS estimated_turnover_cost FROM s
"""))(lambda spark, sf: R.risk_summary(_lp(spark, sf), extended=True))

register("a28_business_impact", q(_SUMMARY_SQL + """
SELECT high_risk + medium_risk AS at_risk,
       CAST(round((high_risk + medium_risk) * CAST(0.35 AS DOUBLE)) AS BIGINT) AS preventable,
       CAST(round((high_risk + medium_risk) * CAST(0.35 AS DOUBLE)) AS BIGINT) * 3000 AS estimated_savings
FROM s
"""))(lambda spark, sf: R.business_impact(R.risk_summary(_lp(spark, sf))))

# -- A7-A14 measures ---------------------------------------------------------
_MEASURES_SQL = {
    "count": "count(*)",
    "count_high_risk": "count(*) FILTER (WHERE risk_level = 'HIGH')",
    "count_medium_risk": "count(*) FILTER (WHERE risk_level = 'MEDIUM')",
    "count_low_risk": "count(*) FILTER (WHERE risk_level = 'LOW')",
    "count_predicted_churn": "count(*) FILTER (WHERE predicted_churn)",
    "average_risk_score": "round(avg(risk_score), 4)",
    "average_churn_probability": "round(avg(churn_probability), 4)",
    "average_days_to_expiration": "round(avg(days_to_expiration), 4)",
    "median_risk_score": "quantile_cont(risk_score, 0.5)",
    "total_monthly_rent_at_risk":
        "CAST(sum(CASE WHEN risk_level = 'HIGH' THEN rent_cents END) AS DOUBLE) / 100",
    "estimated_turnover_cost": "count(*) FILTER (WHERE risk_level = 'HIGH') * 4000",
    "churn_rate": "round(CAST(count(*) FILTER (WHERE predicted_churn) AS DOUBLE) / nullif(count(*), 0), 6)",
    "high_risk_percentage":
        "round(CAST(count(*) FILTER (WHERE risk_level = 'HIGH') AS DOUBLE) / nullif(count(*), 0) * 100, 4)",
}


def msql(*names):
    return ",\n       ".join(f"{_MEASURES_SQL[n]} AS {n}" for n in names)


register("a07_prediction_measures", q(f"SELECT {msql(*M.ALL)} FROM d_hist"), headline=True)(
    lambda spark, sf: M.measure_frame(_hist(spark, sf), M.ALL))

_BY_DIMS = ("count", "average_risk_score", "total_monthly_rent_at_risk", "churn_rate",
            "median_risk_score")
register("a15_measures_by_dims", q(f"""
SELECT neighborhood, risk_level, {msql(*_BY_DIMS)} FROM d_hist GROUP BY neighborhood, risk_level
"""))(lambda spark, sf: M.measure_frame(_hist(spark, sf), _BY_DIMS, ["neighborhood", "risk_level"]))

_ONT = [("high_risk_tenant_count", "count_high_risk"), ("average_risk_score", "average_risk_score"),
        ("churn_ratio", "churn_rate")]
register("a23_ontology_metrics", q("SELECT " + ", ".join(
    f"{_MEASURES_SQL[m]} AS {n}" for n, m in _ONT) + " FROM d_latest"))(
    lambda spark, sf: _latest(spark, sf).agg(
        *[M.MEASURES[m]().alias(n) for n, m in M.ONTOLOGY_METRICS.items()]))

# -- A16 trend, A17 cohorts, A18 heatmap, A20 roll-up, A21 window counts --------
register("a16_risk_trend", q("""
SELECT CAST(CAST(date_trunc('month', prediction_date) AS DATE) AS VARCHAR) AS period,
       count(*) AS predictions,
       round(avg(risk_score), 4) AS avg_risk_score,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
       count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
       round(CAST(count(*) FILTER (WHERE predicted_churn) AS DOUBLE) / nullif(count(*), 0), 6)
         AS predicted_churn_rate
FROM d_hist WHERE prediction_date >= DATE '1998-01-01' GROUP BY 1
"""))(lambda spark, sf: R.trend(_hist(spark, sf), "month", since="1998-01-01"))

register("a17_cohorts", q(f"""
SELECT property_type, neighborhood, lease_term_months,
       {msql('count', 'count_high_risk', 'average_risk_score', 'churn_rate')}
FROM d_latest GROUP BY property_type, neighborhood, lease_term_months
"""))(lambda spark, sf: R.cohorts(_latest(spark, sf)))

register("a18_geo_heatmap", q("""
SELECT CAST(floor(latitude / CAST(0.05 AS DOUBLE)) AS BIGINT) AS lat_cell,
       CAST(floor(longitude / CAST(0.05 AS DOUBLE)) AS BIGINT) AS lon_cell,
       count(*) AS leases, round(avg(risk_score), 4) AS avg_risk_score,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk
FROM d_latest WHERE latitude IS NOT NULL GROUP BY 1, 2
"""))(lambda spark, sf: R.heatmap(_latest(spark, sf)))

register("a20_property_rollup", q("""
SELECT property_id, count(*) AS leases, round(avg(risk_score), 4) AS avg_risk_score,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
       CAST(sum(CASE WHEN risk_level = 'HIGH' THEN rent_cents ELSE 0 END) AS DOUBLE) / 100 AS rent_at_risk
FROM d_latest GROUP BY property_id
"""))(lambda spark, sf: R.property_rollup(_latest(spark, sf)))


def a21(spark, sf):
    from leaserisk.operators import filters as P
    lp = _lp(spark, sf).filter(P.renewal_window())
    return lp.agg(F.count(F.lit(1)).alias("total"),
                  M.count_level("HIGH").alias("high_risk"),
                  M.count_level("MEDIUM").alias("medium_risk"),
                  M.count_level("LOW").alias("low_risk"))


register("a21_renewal_window_counts", q("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
       count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk
FROM d_lease_pred
WHERE status = 'active' AND end_date > DATE '1999-01-01' AND end_date <= DATE '1999-01-01' + 90
"""))(a21)

register("a22_tenant_payment_history", q("""
SELECT l.tenant_id, count(*) AS total_payments,
       count(*) FILTER (WHERE p.days_late <= 0) AS on_time_payments,
       round(CAST(sum(p.days_late) AS DOUBLE) / count(*), 4) AS avg_days_late
FROM d_payment p JOIN d_lease l ON l.lease_id = p.lease_id GROUP BY l.tenant_id
"""))(lambda spark, sf: R.tenant_payment_history(domain(spark, sf).payments(), domain(spark, sf).leases()))

# -- K3 / K4 --------------------------------------------------------------------
register("k03_high_risk_list", q("""
SELECT lease_id, tenant_id, risk_score, risk_level, CAST(end_date AS VARCHAR) AS end_date
FROM d_lease_pred WHERE status = 'active' AND risk_level IN ('HIGH', 'MEDIUM')
ORDER BY risk_score DESC, lease_id LIMIT 50
"""))(lambda spark, sf: R.top_risk(_lp(spark, sf), 50)
      .select("lease_id", "tenant_id", "risk_score", "risk_level", "end_date"))

register("k04_lease_page", q("""
, a AS (SELECT lease_id, tenant_id, end_date, monthly_rent FROM d_lease WHERE status = 'active'),
t AS (SELECT count(*) AS total FROM a)
SELECT p.lease_id, p.tenant_id, CAST(p.end_date AS VARCHAR) AS end_date, p.monthly_rent, t.total, 3 AS page, 50 AS "limit", CAST(ceil(CAST(t.total AS DOUBLE) / 50) AS BIGINT) AS total_pages
FROM (SELECT * FROM a ORDER BY lease_id LIMIT 50 OFFSET 100) p, t
"""))(lambda spark, sf: R.page(domain(spark, sf).leases().filter(F.col("status") == "active")
                              .select("lease_id", "tenant_id", "end_date", "monthly_rent"),
                              "lease_id", page_no=3, limit=50))


# -- A19: dashboard KPIs (small aggregates joined on a literal key) ----------------------
def a19(spark, sf):
    from leaserisk.operators import evaluate as EV
    from leaserisk.operators import prep as PP
    from leaserisk.plans.facts import action_fact
    from leaserisk.plans.warehouse import training_view
    dom = domain(spark, sf)
    lp = PR.leases_with_prediction(dom).filter((F.col("status") == "active") & F.col("risk_level").isNotNull())
    k1 = lp.agg(F.count(F.lit(1)).alias("predicted_active"),
                (M.count_level("HIGH") + M.count_level("MEDIUM")).alias("at_risk"),
                F.round(M.ratio(M.count_predicted_churn(), F.count(F.lit(1))), 6).alias("churn_rate"))
    k1 = k1.withColumn("estimated_savings", F.round(F.col("at_risk") * 0.35).cast("long") * 3000)
    month = F.trunc(F.lit(str(dom.as_of)).cast("date"), "month")
    k2 = (PR.prediction_history(dom).filter(F.trunc("prediction_date", "month") == month)
          .agg(F.count(F.lit(1)).alias("predictions_this_month")))
    af = action_fact(dom)
    k3 = af.agg(F.count(F.lit(1)).alias("actions_sent"),
                F.round(M.ratio(F.count_if("response_received"), F.count(F.lit(1))), 6).alias("response_rate"))
    k4 = EV.confusion(training_view(spark, sf).filter("training_set")).select(
        F.col("accuracy").alias("prediction_accuracy"))
    return PP._attach(PP._attach(PP._attach(k1, k2), k3), k4)


register("a19_dashboard_kpis", q("""
, k1 AS (SELECT count(*) AS predicted_active,
                count(*) FILTER (WHERE risk_level IN ('HIGH', 'MEDIUM')) AS at_risk,
                round(CAST(count(*) FILTER (WHERE predicted_churn) AS DOUBLE) / nullif(count(*), 0), 6) AS churn_rate
         FROM d_lease_pred WHERE status = 'active' AND risk_level IS NOT NULL),
k2 AS (SELECT count(*) AS predictions_this_month FROM d_hist
       WHERE date_trunc('month', prediction_date) = DATE '1999-01-01'),
cur AS (SELECT tenant_id, lease_id FROM d_lease
        QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date DESC, lease_id DESC) = 1),
a AS (SELECT d.* FROM d_action d JOIN cur ON cur.tenant_id = d.tenant_id),
r AS (SELECT a.action_id, count(c.event_id) > 0 AS responded FROM a LEFT JOIN events c
        ON c.event_type = 'click' AND c.user_id = a.tenant_id AND c.ts >= a.triggered_at
       AND c.ts <= a.triggered_at + INTERVAL 48 HOUR GROUP BY 1),
k3 AS (SELECT count(*) AS actions_sent,
              round(CAST(count(*) FILTER (WHERE responded) AS DOUBLE) / nullif(count(*), 0), 6) AS response_rate
       FROM r)
""" + _TRAIN_SQL + """
, k4 AS (SELECT round(CASE WHEN count(*) = 0 THEN 0 ELSE CAST(count(*) FILTER (WHERE (churned = 1) = predicted_churn)
                AS DOUBLE) / count(*) END, 6) AS prediction_accuracy FROM tv WHERE training_set)
SELECT k1.predicted_active, k1.at_risk, k1.churn_rate,
       CAST(round(k1.at_risk * CAST(0.35 AS DOUBLE)) AS BIGINT) * 3000 AS estimated_savings,
       k2.predictions_this_month, k3.actions_sent, k3.response_rate, k4.prediction_accuracy
FROM k1, k2, k3, k4
"""))(a19)


# -- A25: per-column profile in one pass ------------------------------------------------------
_PROFILE = NUMERIC_FEATURES + CATEGORICAL_FEATURES


def a25(spark, sf):
    from leaserisk.operators import features as FE
    fm = FE.feature_matrix(FE.feature_input(domain(spark, sf)))
    agg = fm.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in _PROFILE],
                 *[F.count(F.lit(1)).alias("rows")])
    stack = "stack({}, {}) AS (column_name, null_count)".format(
        len(_PROFILE), ", ".join(f"'{c}', n_{c}" for c in _PROFILE))
    return agg.selectExpr("rows", stack).select("column_name", "null_count",
                                                (F.col("null_count") > 0).alias("has_nulls"), "rows")


def _a25_sql():
    from leaserisk.plans.features import GROUP_SQL, _AGG_CTES
    fm = _AGG_CTES + ", fm AS (SELECT lease_id, " + ",\n  ".join(
        c for g in GROUP_SQL.values() for c in g) + " FROM d_fin)\n"
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
             f"count(*) FILTER (WHERE {c} IS NULL) > 0 AS has_nulls, count(*) AS rows FROM fm" for c in _PROFILE]
    return q(fm + "\nUNION ALL\n".join(parts))


register("a25_column_profile", _a25_sql())(a25)


# -- K4 keyset form ------------------------------------------------------------------------
register("k04_lease_keyset_page", q("""
SELECT lease_id, tenant_id, CAST(end_date AS VARCHAR) AS end_date, monthly_rent FROM d_lease
WHERE status = 'active' AND lease_id > 1000 ORDER BY lease_id LIMIT 50
"""))(lambda spark, sf: R.keyset_page(domain(spark, sf).leases().filter(F.col("status") == "active")
                                      .select("lease_id", "tenant_id", "end_date", "monthly_rent"),
                                      "lease_id", after=1000, limit=50))


# -- A16: the other grains and ranges ---------------------------------------------------------
def _trend_sql(bucket, since):
    return q(f"""
SELECT CAST({bucket} AS VARCHAR) AS period,
       count(*) AS predictions,
       round(avg(risk_score), 4) AS avg_risk_score,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
       count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
       round(CAST(count(*) FILTER (WHERE predicted_churn) AS DOUBLE) / nullif(count(*), 0), 6)
         AS predicted_churn_rate
FROM d_hist WHERE prediction_date >= DATE '{since}' AND prediction_date <= DATE '1999-01-01' GROUP BY 1
""")


for _name, _grain, _since in (("daily_7d", "day", "1998-12-25"), ("daily_30d", "day", "1998-12-02"),
                              ("monthly_1y", "month", "1998-01-01")):
    register(f"a16_risk_trend_{_name}", _trend_sql(
        "prediction_date" if _grain == "day" else "CAST(date_trunc('month', prediction_date) AS DATE)", _since))(
        lambda spark, sf, g=_grain, d=_since: R.trend(_hist(spark, sf), g, since=d, until="1999-01-01"))


# -- A16 weekly grain within the last 90 days ------------------------------------------------
register("a16_risk_trend_weekly_90d", q("""
SELECT CAST(CAST(date_trunc('week', prediction_date) AS DATE) AS VARCHAR) AS period,
       count(*) AS predictions,
       round(avg(risk_score), 4) AS avg_risk_score,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
       count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
       round(CAST(count(*) FILTER (WHERE predicted_churn) AS DOUBLE) / nullif(count(*), 0), 6)
         AS predicted_churn_rate
FROM d_hist WHERE prediction_date >= DATE '1999-01-01' - 90 AND prediction_date <= DATE '1999-01-01' GROUP BY 1
"""))(lambda spark, sf: R.trend(_hist(spark, sf), "week", since="1998-10-03", until="1999-01-01"))
