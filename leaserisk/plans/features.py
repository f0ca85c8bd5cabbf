"""Feature queries: A1, A2, E1, E2 and the five E3 groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.operators import features as FE
from leaserisk.plans.oracle_prefix import AS_OF_SQL, q
from leaserisk.plans.registry import register
from leaserisk.sources.driver import domain

# Columns whose value comes from a floating-point aggregate (order dependent
# in the last bits) are rounded in both engines.
ROUND4 = {"avg_days_late", "payment_consistency", "payment_std",
          "avg_resolution_days"}


def _rounded(df):
    return df.select(*[F.round(F.col(c), 4).alias(c) if c in ROUND4 else F.col(c) for c in df.columns])


_AGG_CTES = """
, d_pay AS (
  SELECT lease_id, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_paid,
         CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / count(amount) / 100 AS avg_payment,
         stddev_samp(amount) AS payment_std, count(amount) AS payment_count,
         avg(days_late) AS avg_days_late, max(days_late) AS max_days_late,
         CAST(sum(days_late) AS BIGINT) AS total_days_late, max(payment_date) AS last_payment_date,
         sum(late_fee) AS total_late_fees
  FROM d_payment GROUP BY lease_id),
d_mnt AS (
  SELECT property_id, count(request_id) AS maintenance_count,
         count(*) FILTER (WHERE priority = 'HIGH') AS high_priority_requests,
         avg(resolution_days) AS avg_resolution_days
  FROM d_maint GROUP BY property_id),
d_fin AS (
  SELECT c.*, pa.total_paid, pa.avg_payment, pa.payment_std, pa.payment_count, pa.avg_days_late,
         pa.max_days_late, pa.total_days_late, pa.last_payment_date, pa.total_late_fees,
         mn.maintenance_count, mn.high_priority_requests, mn.avg_resolution_days,
         (1999 - year(c.start_date)) * 12 + 1 - month(c.start_date) AS tenure_months
  FROM d_ctx c LEFT JOIN d_pay pa ON pa.lease_id = c.lease_id
               LEFT JOIN d_mnt mn ON mn.property_id = c.property_id)
"""

GROUP_SQL = {
    "behavior": [
        "round(CAST(coalesce(avg_days_late, 0) AS DOUBLE), 4) AS avg_days_late",
        "CAST(coalesce(max_days_late, 0) AS DOUBLE) AS max_days_late",
        "coalesce(CAST(total_days_late AS DOUBLE) / payment_count, CAST(0 AS DOUBLE)) AS late_payment_rate",
        "round(1 / (1 + coalesce(payment_std, 0)), 4) AS payment_consistency",
        f"CAST(date_diff('day', last_payment_date, {AS_OF_SQL}) AS INTEGER) AS days_since_last_payment",
        "CAST(autopay_enabled AS INTEGER) AS has_autopay",
        "CAST(portal_login_count AS DOUBLE) / greatest(tenure_months, 1) AS portal_logins_per_month",
        "CAST(coalesce(maintenance_count, 0) AS DOUBLE) / greatest(CAST(tenure_months AS DOUBLE) / 12, "
        "CAST(1 AS DOUBLE)) AS maintenance_requests_per_year",
        "CAST(coalesce(high_priority_requests, 0) AS BIGINT) AS high_priority_requests",
        "avg_response_time_hours",
        "0 AS missed_communication_count",
        "complaint_count",
        "0 AS escalation_count",
        "renewal_count AS previous_renewals",
        "tenure_months",
    ],
    "property": [
        "square_feet", "bedrooms", "bathrooms",
        "1999 - year_built AS property_age",
        "location_score", "school_rating",
        "CAST(has_garage AS INTEGER) AS has_garage",
        "CAST(has_yard AS INTEGER) AS has_yard",
        "CAST(has_ac AS INTEGER) AS has_ac",
        "condition_rating AS property_condition",
        "10 AS years_since_renovation",
        "'suburban' AS neighborhood_type",
    ],
    "financial": [
        "monthly_rent",
        "monthly_rent / square_feet AS rent_per_sqft",
        "CASE WHEN annual_income IS NULL THEN NULL "
        "ELSE least(monthly_rent * 12 / annual_income, CAST(1 AS DOUBLE)) END AS rent_to_income_ratio",
        "last_rent_increase_pct AS rent_increase_pct",
        "0 AS total_rent_increases",
        "primary_payment_method AS payment_method",
        "security_deposit / monthly_rent AS security_deposit_months",
        "total_late_fees",
    ],
    "market": [
        "market_rent_median",
        "monthly_rent / market_rent_median AS rent_vs_market",
        "vacancy_rate AS neighborhood_vacancy_rate",
        "rent_growth_1yr_pct AS market_rent_growth_1yr",
        "rent_growth_3yr_pct AS market_rent_growth_3yr",
        "new_listings_30d AS new_listings_count",
        "avg_days_on_market",
        "median_hh_income AS median_household_income",
        "population_growth_rate",
        "competitor_count_1mi AS competitor_properties_1mi",
    ],
    "temporal": [
        f"CAST(date_diff('day', {AS_OF_SQL}, end_date) AS INTEGER) AS days_to_expiration",
        "lease_term_months",
        "month(end_date) AS lease_end_month",
        "CAST(month(end_date) IN (6, 7, 8) AS INTEGER) AS is_summer_expiration",
    ],
}


def _group_query(group):
    def run(spark, sf):
        df = FE.feature_input(domain(spark, sf))
        return _rounded(df.select("lease_id", *FE.FEATURE_GROUPS[group](df)))
    return run


for _g in GROUP_SQL:
    register(f"e3_{_g}_features",
             q(_AGG_CTES + "SELECT lease_id, " + ",\n  ".join(GROUP_SQL[_g]) + " FROM d_fin"))(
        _group_query(_g))


def e2(spark, sf):
    df = FE.feature_input(domain(spark, sf))
    return _rounded(FE.feature_matrix(df))


register("e2_feature_matrix", q(_AGG_CTES + "SELECT lease_id, tenant_id, property_id, " + ",\n  ".join(
    c for g in GROUP_SQL.values() for c in g) + " FROM d_fin"), headline=True)(e2)

register("a01_payment_aggregates", q("""
SELECT lease_id, round(CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100, 2) AS total_paid,
       CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / count(amount) / 100 AS avg_payment,
       round(stddev_samp(amount), 4) AS payment_std, count(amount) AS payment_count,
       round(avg(days_late), 4) AS avg_days_late, max(days_late) AS max_days_late,
       CAST(sum(days_late) AS BIGINT) AS total_days_late, CAST(max(payment_date) AS VARCHAR) AS last_payment_date,
       sum(late_fee) AS total_late_fees
FROM d_payment GROUP BY lease_id
"""))(lambda spark, sf: _rounded(FE.payment_aggregates(domain(spark, sf).payments())
                                 .withColumn("total_paid", F.round("total_paid", 2))))

register("a02_maintenance_aggregates", q("""
SELECT property_id, count(request_id) AS maintenance_count,
       count(*) FILTER (WHERE priority = 'HIGH') AS high_priority_requests,
       round(avg(resolution_days), 4) AS avg_resolution_days
FROM d_maint GROUP BY property_id
"""))(lambda spark, sf: _rounded(FE.maintenance_aggregates(domain(spark, sf).maintenance())))


def e1(spark, sf):
    df = FE.merged_sources(domain(spark, sf))
    return _rounded(df.select("lease_id", "tenant_id", "property_id", "zip_code", "neighborhood",
                              "data_date", "payment_count", F.round("total_paid", 2).alias("total_paid"),
                              "last_payment_date", "maintenance_count", "high_priority_requests",
                              "avg_resolution_days"))


register("e1_merged_sources", q(_AGG_CTES + """
SELECT lease_id, tenant_id, property_id, zip_code, neighborhood, CAST(data_date AS VARCHAR) AS data_date,
       payment_count, round(total_paid, 2) AS total_paid, CAST(last_payment_date AS VARCHAR) AS last_payment_date,
       maintenance_count, high_priority_requests,
       round(avg_resolution_days, 4) AS avg_resolution_days
FROM d_fin
"""))(e1)
