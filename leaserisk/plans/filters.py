"""Filter / list / validation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leaserisk.config import AS_OF
from leaserisk.operators import features as FE
from leaserisk.operators import filters as P
from leaserisk.operators import predictions as PR
from leaserisk.operators import validation as V
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.sources.driver import domain


def _dom(spark, sf):
    return domain(spark, sf)


register("p02_expiring_within_60", q("""
SELECT lease_id, tenant_id, CAST(end_date AS VARCHAR) AS end_date FROM d_lease
WHERE status = 'active' AND end_date BETWEEN DATE '1999-01-01' AND DATE '1999-01-01' + 60
"""))(lambda spark, sf: _dom(spark, sf).leases_ending(AS_OF, AS_OF + dt.timedelta(days=60))
      .filter(P.expiring_within(days=60)).select("lease_id", "tenant_id", "end_date"))

for _lvl, _id in (("HIGH", "p04_high_risk_active"), ("MEDIUM", "p05_medium_risk_active")):
    register(_id, q(f"""
SELECT lease_id, tenant_id, risk_score FROM d_lease_pred WHERE status = 'active' AND risk_level = '{_lvl}'
"""))((lambda lvl: lambda spark, sf: PR.leases_with_prediction(_dom(spark, sf))
       .filter(P.risk_active(lvl)).select("lease_id", "tenant_id", "risk_score"))(_lvl))

register("p06_tenant_by_email", q("""
SELECT tenant_id, full_name, email FROM d_tenant WHERE lower(email) = lower('TENANT17@mail.example')
"""))(lambda spark, sf: _dom(spark, sf).tenants().filter(P.email_is("TENANT17@mail.example"))
      .select("tenant_id", "full_name", "email"))

register("p08_tenant_search", q("""
SELECT tenant_id, full_name, email FROM d_tenant
WHERE status = 'active' AND (contains(lower(full_name), '00001') OR contains(lower(email), '00001'))
"""))(lambda spark, sf: _dom(spark, sf).tenants().filter(P.tenant_search("active", "00001"))
      .select("tenant_id", "full_name", "email"))

register("p09_lease_list", q("""
SELECT lease_id, renewal_status, risk_level, CAST(end_date AS VARCHAR) AS end_date FROM d_lease_pred
WHERE status = 'active' AND renewal_status = 'pending-renewal' AND risk_level = 'MEDIUM'
  AND end_date BETWEEN DATE '1999-01-01' AND DATE '1999-01-01' + 60
"""))(lambda spark, sf: PR.leases_with_prediction(_dom(spark, sf))
      .filter(P.lease_list(status="active", renewal_status="pending-renewal", risk_level="MEDIUM",
                           expiring_in_days=60))
      .select("lease_id", "renewal_status", "risk_level", "end_date"))

register("p10_property_list", q("""
SELECT property_id, address, zip_code, bedrooms FROM d_property WHERE city = 'AMERICA' AND bedrooms = 3
"""))(lambda spark, sf: _dom(spark, sf).properties().filter(P.property_list(city="AMERICA", bedrooms=3))
      .select("property_id", "address", "zip_code", "bedrooms"))

register("p11_campaign_list", q("""
SELECT action_id, tenant_id, action_type, status,
       strftime(triggered_at, '%Y-%m-%d %H:%M:%S.%f') AS triggered_at FROM d_action
WHERE status = 'completed' AND triggered_at >= TIMESTAMP '2024-01-10 00:00:00'
  AND triggered_at <= TIMESTAMP '2024-01-20 00:00:00'
"""))(lambda spark, sf: _dom(spark, sf).actions()
      .filter(P.campaign_list(status="completed", start="2024-01-10 00:00:00", end="2024-01-20 00:00:00"))
      .select("action_id", "tenant_id", "action_type", "status", "triggered_at"))


def p11_by_level(spark, sf):
    """P11 with the risk level of the tenant's current lease."""
    from leaserisk.operators import retention as RT
    dom = _dom(spark, sf)
    level = PR.latest_of(dom).select("lease_id", "risk_level")
    acts = RT.action_leases(dom.actions(), dom.leases()).join(level, "lease_id", "left")
    return acts.filter(P.campaign_list(status="completed", risk_level="HIGH")).select(
        "action_id", "tenant_id", "action_type", "lease_id", "risk_level")


register("p11_campaign_list_by_level", q("""
, cur AS (SELECT tenant_id, lease_id FROM d_lease
          QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY start_date DESC, lease_id DESC) = 1)
SELECT a.action_id, a.tenant_id, a.action_type, cur.lease_id, lt.risk_level
FROM d_action a JOIN cur ON cur.tenant_id = a.tenant_id JOIN d_latest lt ON lt.lease_id = cur.lease_id
WHERE a.status = 'completed' AND lt.risk_level = 'HIGH'
"""))(p11_by_level)


def p13(spark, sf):
    dom = _dom(spark, sf)
    lp = PR.leases_with_prediction(dom).join(dom.properties().select("property_id", "neighborhood"),
                                             "property_id", "left")
    return (lp.filter(P.lease_list(risk_level="MEDIUM", expiring_in_days=60)
                      & P.property_list(neighborhood="NATION_5"))
            .select("lease_id", "risk_score", "neighborhood"))


register("p13_dashboard_filters", q("""
SELECT l.lease_id, l.risk_score, p.neighborhood
FROM d_lease_pred l LEFT JOIN d_property p ON p.property_id = l.property_id
WHERE l.risk_level = 'MEDIUM' AND l.end_date BETWEEN DATE '1999-01-01' AND DATE '1999-01-01' + 60
  AND p.neighborhood = 'NATION_5'
"""))(p13)

register("p15_mask_columns", q("""
SELECT tenant_id, full_name, sha256(email) AS email, sha256(phone) AS phone FROM d_tenant
"""))(lambda spark, sf: P.mask_columns(_dom(spark, sf).tenants()
                                       .select("tenant_id", "full_name", "email", "phone"),
                                       ["email", "phone"], allowed=False))

register("p16_retention_cutoff", q("""
SELECT lease_id, CAST(start_date AS VARCHAR) AS start_date FROM d_lease WHERE start_date >= DATE '1995-06-01'
"""))(lambda spark, sf: _dom(spark, sf).leases()
      .filter(P.retention_cutoff("start_date", as_of=dt.date(2002, 6, 1)))
      .select("lease_id", "start_date"))


# -- P7: scoring rows with null-only defaults -----------------------------------
# The request's fields and the defaults of missing ones.
SCORING_DEFAULTS = [
    ("avg_days_late", 0.0), ("max_days_late", 0), ("payment_count", 12), ("autopay_enabled", False),
    ("portal_login_count", 0), ("maintenance_count", 0), ("complaint_count", 0), ("tenure_months", 12),
    ("square_feet", 1500), ("bedrooms", 3), ("bathrooms", 2.0), ("year_built", 2010), ("location_score", 7),
    ("has_garage", False), ("property_condition", 4),
    ("monthly_rent", 2000.0), ("annual_income", None), ("last_rent_increase_pct", 0.03), ("payment_method", "ach"),
    ("market_rent_median", 2100), ("vacancy_rate", 0.05), ("rent_growth_1yr_pct", 0.03),
    ("lease_end_date", None), ("lease_term_months", 12),
]


def p07(spark, sf):
    dom = _dom(spark, sf)
    window = dom.leases_ending(AS_OF, AS_OF + dt.timedelta(days=90)).filter(P.renewal_window())
    df = FE.feature_input(dom, leases=window).withColumns({
        "payment_count": F.coalesce("payment_count", "tenure_months"), "property_condition": F.col("condition_rating"),
        "payment_method": F.col("primary_payment_method"), "lease_end_date": F.col("end_date").cast("string")})
    return (V.with_defaults(df, SCORING_DEFAULTS, keys=("lease_id", "tenant_id", "property_id"))
            .withColumn("avg_days_late", F.round("avg_days_late", 4)))


_P07_SQL = {
    "avg_days_late": "round(coalesce(pa.avg_days_late, CAST(0 AS DOUBLE)), 4)",
    "max_days_late": "coalesce(pa.max_days_late, 0)",
    "payment_count": "coalesce(pa.payment_count, (1999 - year(c.start_date)) * 12 + 1 - month(c.start_date), 12)",
    "maintenance_count": "coalesce(mt.maintenance_count, 0)",
    "tenure_months": "coalesce((1999 - year(c.start_date)) * 12 + 1 - month(c.start_date), 12)",
    "property_condition": "coalesce(c.condition_rating, 4)",
    "payment_method": "coalesce(c.primary_payment_method, 'ach')",
    "annual_income": "c.annual_income",
    "lease_end_date": "CAST(c.end_date AS VARCHAR)",
}


def _default_sql(c, v):
    lit = str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{_P07_SQL.get(c, f'coalesce(c.{c}, {lit})')} AS {c}"


register("p07_scoring_rows", q("""
, d_pay AS (SELECT lease_id, avg(days_late) AS avg_days_late, max(days_late) AS max_days_late, count(*) AS payment_count
            FROM d_payment GROUP BY lease_id),
d_mt AS (SELECT property_id, count(*) AS maintenance_count FROM d_maint GROUP BY property_id)
SELECT c.lease_id, c.tenant_id, c.property_id, """ + ", ".join(_default_sql(c, v) for c, v in SCORING_DEFAULTS) + """
FROM d_ctx c LEFT JOIN d_pay pa ON pa.lease_id = c.lease_id LEFT JOIN d_mt mt ON mt.property_id = c.property_id
WHERE c.status = 'active' AND c.end_date > DATE '1999-01-01' AND c.end_date <= DATE '1999-01-01' + 90
"""))(p07)


# -- P12: constraint validation in one pass -------------------------------------
def p12(spark, sf):
    dom = _dom(spark, sf)
    return V.validate(dom.leases(), V.LEASE_RULES, unique=["lease_id"]).unionByName(
        V.validate(dom.tenants(), V.TENANT_RULES, unique=["tenant_id", "email"]))


register("p12_validation", q(f"""
{V.rules_sql('d_lease', V.LEASE_RULES, ['lease_id'])}
UNION ALL
{V.rules_sql('d_tenant', V.TENANT_RULES, ['tenant_id', 'email'])}
"""))(p12)
