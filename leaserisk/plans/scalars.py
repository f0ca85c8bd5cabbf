"""Scalar function groups (F1-F21) checked as one query per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.config import AS_OF, EXPIRY_TIERS, RENT_TIERS, SCORE_TIERS, TENURE_TIERS
from leaserisk.functions import scalars as X
from leaserisk.functions import tiers as TI
from leaserisk.operators import predictions as PR
from leaserisk.operators import scoring as S
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.sources.driver import domain


def f_dates(spark, sf):
    dom = domain(spark, sf)
    l = dom.leases().join(dom.properties().select("property_id", "year_built"), "property_id", "left")
    end = F.col("end_date")
    return l.select(
        "lease_id",
        X.days_between(end, AS_OF).alias("days_to_end"),
        X.tenure_months(F.col("start_date"), AS_OF).alias("tenure_months"),
        X.in_renewal_window(end, AS_OF).alias("in_window"),
        X.date_key(end).alias("end_key"),
        X.date_from_key(X.date_key(end)).alias("end_from_key"),
        X.timeframe(end, "week").alias("end_week"),
        X.timeframe(end, "month").alias("end_month"),
        X.timeframe(end, "quarter").alias("end_quarter"),
        X.timeframe(end, "year").alias("end_year"),
        F.month(end).alias("end_month_num"),
        X.is_summer(F.month(end)).alias("is_summer"),
        X.property_age(F.col("year_built"), AS_OF).alias("property_age"),
    )


register("f_dates", q("""
SELECT l.lease_id,
       CAST(date_diff('day', DATE '1999-01-01', end_date) AS INTEGER) AS days_to_end,
       CASE WHEN start_date IS NULL THEN 0
            ELSE (1999 - year(start_date)) * 12 + 1 - month(start_date) END AS tenure_months,
       date_diff('day', DATE '1999-01-01', end_date) > 0
         AND date_diff('day', DATE '1999-01-01', end_date) <= 90 AS in_window,
       CAST(strftime(end_date, '%Y%m%d') AS INTEGER) AS end_key,
       CAST(CAST(strptime(strftime(end_date, '%Y%m%d'), '%Y%m%d') AS DATE) AS VARCHAR) AS end_from_key,
       CAST(CAST(date_trunc('week', end_date) AS DATE) AS VARCHAR) AS end_week,
       CAST(CAST(date_trunc('month', end_date) AS DATE) AS VARCHAR) AS end_month,
       CAST(CAST(date_trunc('quarter', end_date) AS DATE) AS VARCHAR) AS end_quarter,
       CAST(CAST(date_trunc('year', end_date) AS DATE) AS VARCHAR) AS end_year,
       month(end_date) AS end_month_num,
       month(end_date) IN (6, 7, 8) AS is_summer,
       1999 - p.year_built AS property_age
FROM d_lease l LEFT JOIN d_property p ON p.property_id = l.property_id
"""))(f_dates)


def f_tiers(spark, sf):
    lr = PR.prediction_history(domain(spark, sf), newest_only=True)
    return lr.select(
        "lease_id",
        TI.tier(F.col("days_to_expiration"), EXPIRY_TIERS).alias("expiry_tier"),
        TI.tier(F.col("risk_score"), SCORE_TIERS).alias("score_tier"),
        TI.tier(X.tenure_months(F.col("start_date"), AS_OF), TENURE_TIERS).alias("tenure_tier"),
        TI.tier(F.col("monthly_rent"), RENT_TIERS).alias("rent_tier"),
    )


_TEN = "(1999 - year(start_date)) * 12 + 1 - month(start_date)"
register("f_tiers", q(f"""
SELECT lease_id,
       {TI.tier_sql('days_to_expiration', EXPIRY_TIERS)} AS expiry_tier,
       {TI.tier_sql('risk_score', SCORE_TIERS)} AS score_tier,
       {TI.tier_sql(_TEN, TENURE_TIERS)} AS tenure_tier,
       {TI.tier_sql('monthly_rent', RENT_TIERS)} AS rent_tier
FROM d_latest
"""))(f_tiers)


def f_scores(spark, sf):
    h = PR.prediction_history(domain(spark, sf))
    p = F.col("churn_probability")
    return h.select(
        "lease_id", "prediction_date",
        S.score_from_probability(p).alias("score_from_prob"),
        S.level_from_probability(p).alias("level_from_prob"),
        (p >= 0.5).alias("predicted"),
        (F.abs(p - 0.5) * 2).alias("confidence_f"),
        X.safe_ratio(F.col("risk_score"), F.col("days_to_expiration") - 30).alias("score_per_day"),
        X.inverse_one_plus(F.col("risk_score")).alias("inverse_score"),
        X.clip_upper(p * 2, 1.0).alias("clipped_double_prob"),
    )


register("f_scores", q("""
SELECT lease_id, CAST(prediction_date AS VARCHAR) AS prediction_date,
       CAST(trunc(churn_probability * 100) AS INTEGER) AS score_from_prob,
       CASE WHEN churn_probability >= 0.8 THEN 'HIGH' WHEN churn_probability >= 0.5 THEN 'MEDIUM'
            WHEN churn_probability IS NOT NULL THEN 'LOW' END AS level_from_prob,
       churn_probability >= 0.5 AS predicted,
       abs(churn_probability - CAST(0.5 AS DOUBLE)) * 2 AS confidence_f,
       CAST(risk_score AS DOUBLE) / nullif(days_to_expiration - 30, 0) AS score_per_day,
       1 / (1 + CAST(risk_score AS DOUBLE)) AS inverse_score,
       least(churn_probability * 2, CAST(1 AS DOUBLE)) AS clipped_double_prob
FROM d_hist
"""))(f_scores)


register("f_text", q("""
SELECT tenant_id, concat_ws(' ', first_name, last_name) AS name_joined, lower(trim(email)) AS email_lower
FROM d_tenant
"""))(lambda spark, sf: domain(spark, sf).tenants().select(
    "tenant_id", X.full_name(F.col("first_name"), F.col("last_name")).alias("name_joined"),
    X.lower_email(F.col("email")).alias("email_lower")))
