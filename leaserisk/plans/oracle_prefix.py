"""The driver-table -> domain mapping as DuckDB CTEs.

This is an independent second writing of ``leaserisk.sources.driver`` (same
rules, SQL form).  Every oracle query is ``PREFIX + <its own CTEs/SELECT>``;
CTEs a query does not reference are never evaluated.
"""

AS_OF_SQL = "DATE '1999-01-01'"

SCORE_SQL = """CAST(least(greatest(
           30
           + CASE WHEN NOT autopay_enabled THEN 10 ELSE 0 END
           + CASE WHEN complaint_count > 1 THEN 15 ELSE 0 END
           + CASE WHEN condition_rating < 3 THEN 10 ELSE 0 END
           + CASE WHEN property_age > 40 THEN 5 ELSE 0 END
           + CASE WHEN rent_cents * 10 > market_rent_median * 1100 THEN 15
                  WHEN rent_cents * 10 < market_rent_median * 900 THEN -10 ELSE 0 END
           + CASE WHEN tenure_days > 720 THEN -10 WHEN tenure_days < 180 THEN 10 ELSE 0 END
           + CASE WHEN vacancy_pct > 7 THEN -5 ELSE 0 END, 0), 100) AS INTEGER)"""

RISK_SQL = """CAST(risk_score AS DOUBLE) / 100 AS churn_probability,
         CASE WHEN risk_score >= 80 THEN 'HIGH' WHEN risk_score >= 50 THEN 'MEDIUM'
              WHEN risk_score IS NOT NULL THEN 'LOW' END AS risk_level,
         risk_score >= 50 AS predicted_churn,
         CAST(abs(risk_score - 50) AS DOUBLE) / 50 AS confidence"""

PREFIX = f"""
WITH
d_evc AS (
  SELECT user_id AS tenant_id,
         count(*) FILTER (WHERE event_type = 'view') AS portal_login_count,
         count(*) FILTER (WHERE event_type = 'error' AND value >= 60) AS complaint_count,
         max(CASE WHEN event_type = 'view' THEN ts END) AS last_login_at
  FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id),
d_tenant AS (
  SELECT c_custkey AS tenant_id,
         split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         c_name AS full_name,
         'Tenant' || CAST(c_custkey AS VARCHAR) || '@Mail.Example' AS email,
         printf('303-555-%04d', c_custkey % 10000) AS phone,
         DATE '1940-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS date_of_birth,
         CAST(1 + c_custkey % 5 AS INTEGER) AS household_size,
         CAST(40000 AS DOUBLE) + CAST(CAST(round(c_acctbal * 100) AS BIGINT) + 100000 AS DOUBLE) / 10
           AS annual_income,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'retired' WHEN 'MACHINERY' THEN 'employed'
              WHEN 'BUILDING' THEN 'self-employed' WHEN 'AUTOMOBILE' THEN 'student'
              WHEN 'FURNITURE' THEN 'unemployed' END AS employment_status,
         CAST(DATE '1990-01-01' + CAST(c_custkey % 1800 AS INTEGER) AS TIMESTAMP) AS account_created_at,
         c_custkey % 5 >= 2 AS autopay_enabled,
         CASE WHEN c_custkey % 10 < 5 THEN 'ach' WHEN c_custkey % 10 < 8 THEN 'credit-card'
              ELSE 'debit-card' END AS primary_payment_method,
         CAST(c_custkey % 48 AS DOUBLE) / 2 AS avg_response_time_hours,
         'active' AS status,
         c_nationkey AS nation_key,
         CAST(coalesce(e.portal_login_count, 0) AS INTEGER) AS portal_login_count,
         CAST(coalesce(e.complaint_count, 0) AS INTEGER) AS complaint_count,
         e.last_login_at
  FROM customer LEFT JOIN d_evc e ON e.tenant_id = c_custkey),
d_property AS (
  SELECT p_partkey AS property_id,
         CAST(p_partkey AS VARCHAR) || ' ' || p_name || ' St' AS address,
         r_name AS city, 'CO' AS state,
         CAST(p_partkey % 25 AS VARCHAR) AS zip_code,
         n_name AS neighborhood,
         CAST(1000 + p_size * 40 AS INTEGER) AS square_feet,
         CAST(2 + p_size % 4 AS INTEGER) AS bedrooms,
         1 + CAST(p_size % 3 AS DOUBLE) / 2 AS bathrooms,
         CAST(1950 + p_partkey % 50 AS INTEGER) AS year_built,
         p_type AS property_type,
         p_partkey % 10 >= 3 AS has_garage,
         p_partkey % 10 >= 2 AS has_yard,
         p_partkey % 10 >= 4 AS has_ac,
         CAST(1 + p_partkey % 5 AS INTEGER) AS condition_rating,
         CAST(1 + p_partkey % 10 AS INTEGER) AS location_score,
         CAST(1 + (p_partkey * 3) % 10 AS INTEGER) AS school_rating,
         CAST(39.6392 AS DOUBLE) + CAST(p_partkey % 200 AS DOUBLE) / 1000 AS latitude,
         CAST(-105.0903 AS DOUBLE) + CAST((p_partkey * 7) % 200 AS DOUBLE) / 1000 AS longitude
  FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25
            LEFT JOIN region ON r_regionkey = n_regionkey),
d_market AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS zip_code,
         CAST(DATE '1995-01-01' + to_months(CAST(m AS INTEGER)) AS DATE) AS data_date,
         CAST(1800 + 56 * n_nationkey AS DOUBLE) AS market_rent_median,
         CAST(3 + n_nationkey % 8 AS INTEGER) AS vacancy_pct,
         CAST(3 + n_nationkey % 8 AS DOUBLE) / 100 AS vacancy_rate,
         CAST(n_nationkey % 6 AS DOUBLE) / 100 AS rent_growth_1yr_pct,
         CAST(n_nationkey % 6 + 4 AS DOUBLE) / 100 AS rent_growth_3yr_pct,
         CAST(5 + n_nationkey % 20 AS INTEGER) AS new_listings_30d,
         CAST(20 + n_nationkey % 30 AS INTEGER) AS avg_days_on_market,
         CAST(60000 + 1000 * n_nationkey AS DOUBLE) AS median_hh_income,
         CAST(n_nationkey % 4 AS DOUBLE) / 100 AS population_growth_rate,
         CAST(30 + n_nationkey AS INTEGER) AS competitor_count_1mi
  FROM nation CROSS JOIN range(0, 80) t(m)),
d_mkt AS (
  SELECT * FROM d_market WHERE data_date <= {AS_OF_SQL}
  QUALIFY row_number() OVER (PARTITION BY zip_code ORDER BY data_date DESC) = 1),
d_lprop AS (
  SELECT l_orderkey AS lease_id, min(l_partkey) AS property_id FROM lineitem GROUP BY l_orderkey),
d_lease0 AS (
  SELECT o_orderkey AS lease_id, o_custkey AS tenant_id, CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderkey % 10 = 0 THEN 24 ELSE 12 END AS term,
         150000 + (CAST(round(o_totalprice * 100) AS BIGINT) + 125) // 250 AS rent_cents,
         o_orderstatus
  FROM orders),
d_lease1 AS (
  SELECT l.*, CAST(start_date + CAST(term * 30 AS INTEGER) AS DATE) AS end_date FROM d_lease0 l),
d_lease AS (
  SELECT l.lease_id, l.tenant_id, lp.property_id, l.start_date, l.end_date,
         CAST(l.term AS INTEGER) AS lease_term_months,
         l.rent_cents,
         CAST(l.rent_cents AS DOUBLE) / 100 AS monthly_rent,
         CAST(l.rent_cents * (2 + l.lease_id % 3) AS DOUBLE) / 200 AS security_deposit,
         CAST(l.lease_id % 6 AS INTEGER) AS renewal_count,
         CAST(l.lease_id % 9 AS DOUBLE) / 100 AS last_rent_increase_pct,
         CASE WHEN l.end_date > {AS_OF_SQL} + 90 THEN 'active'
              WHEN l.end_date > {AS_OF_SQL} THEN 'pending-renewal'
              WHEN l.o_orderstatus = 'F' THEN 'not-renewed' ELSE 'renewed' END AS renewal_status,
         CASE WHEN l.end_date > {AS_OF_SQL} THEN 'active' ELSE 'expired' END AS status
  FROM d_lease1 l LEFT JOIN d_lprop lp ON lp.lease_id = l.lease_id),
d_payment AS (
  SELECT l_orderkey AS lease_id, CAST(l_shipdate AS DATE) AS payment_date,
         CAST((CAST(round(l_extendedprice * 100) AS BIGINT)
               * (100 - CAST(round(l_discount * 100) AS BIGINT)) + 50) // 100 AS DOUBLE) / 100 AS amount,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 + l_suppkey % 15 ELSE 0 END AS INTEGER) AS days_late,
         CASE WHEN l_returnflag = 'R' AND 1 + l_suppkey % 15 > 5 THEN CAST(50 AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS late_fee,
         'paid' AS status
  FROM lineitem),
d_maint AS (
  SELECT event_id AS request_id, user_id AS property_id, CAST(ts AS DATE) AS request_date,
         'repair' AS request_type,
         CASE WHEN value >= 100 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
         'closed' AS status,
         CAST(1 + event_id % 14 AS INTEGER) AS resolution_days,
         value AS cost
  FROM events WHERE event_type = 'error'),
d_action AS (
  SELECT event_id AS action_id, user_id AS tenant_id, ts AS triggered_at,
         CASE event_id % 5 WHEN 0 THEN 'email-campaign' WHEN 1 THEN 'phone-call'
              WHEN 2 THEN 'incentive-offer' WHEN 3 THEN 'property-manager-visit'
              ELSE 'rent-adjustment' END AS action_type,
         CASE WHEN event_id % 10 < 6 THEN 'completed' WHEN event_id % 10 < 9 THEN 'pending'
              ELSE 'failed' END AS status,
         value AS cost
  FROM events WHERE event_type = 'purchase'),
d_engage AS (
  SELECT event_id, user_id AS tenant_id, ts, event_type, value
  FROM events WHERE event_type IN ('click', 'view', 'signup')),
d_ctx AS (
  SELECT l.*,
         t.full_name, t.email, t.annual_income, t.employment_status, t.autopay_enabled,
         t.primary_payment_method, t.portal_login_count, t.complaint_count, t.avg_response_time_hours,
         p.zip_code, p.neighborhood, p.city, p.property_type, p.square_feet, p.bedrooms, p.bathrooms,
         p.year_built, p.has_garage, p.has_yard, p.has_ac, p.condition_rating, p.location_score,
         p.school_rating, p.latitude, p.longitude,
         m.data_date, m.market_rent_median, m.vacancy_pct, m.vacancy_rate, m.rent_growth_1yr_pct,
         m.rent_growth_3yr_pct, m.new_listings_30d, m.avg_days_on_market, m.median_hh_income,
         m.population_growth_rate, m.competitor_count_1mi,
         1999 - p.year_built AS property_age,
         CAST(date_diff('day', l.start_date, {AS_OF_SQL}) AS INTEGER) AS tenure_days,
         CAST(date_diff('day', {AS_OF_SQL}, l.end_date) AS INTEGER) AS days_to_expiration
  FROM d_lease l
  LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id
  LEFT JOIN d_property p ON p.property_id = l.property_id
  LEFT JOIN d_mkt m ON m.zip_code = p.zip_code),
d_scored0 AS (SELECT c.*, @SCORE@ AS risk_score FROM d_ctx c),
d_scored AS (SELECT s.*, @RISK@ FROM d_scored0 s),
d_runs AS (
  SELECT CAST(unnest(generate_series(date_trunc('month', e - 90)::TIMESTAMP, TIMESTAMP '1999-01-01',
                                     INTERVAL 1 MONTH)) AS DATE) AS run_date
  FROM (SELECT min(end_date) AS e FROM d_lease1)),
d_mkt_run AS (
  SELECT m.*, r.run_date FROM d_market m JOIN d_runs r ON m.data_date <= r.run_date
  QUALIFY row_number() OVER (PARTITION BY m.zip_code, r.run_date ORDER BY m.data_date DESC) = 1),
d_hctx AS (
  SELECT l.*, r.run_date,
         t.autopay_enabled, t.complaint_count,
         p.zip_code, p.neighborhood, p.property_type, p.year_built, p.condition_rating,
         p.latitude, p.longitude,
         m.market_rent_median, m.vacancy_pct,
         year(r.run_date) - p.year_built AS property_age,
         CAST(date_diff('day', l.start_date, r.run_date) AS INTEGER) AS tenure_days,
         CAST(date_diff('day', r.run_date, l.end_date) AS INTEGER) AS days_to_expiration
  FROM d_lease l
  JOIN d_runs r ON l.end_date > r.run_date AND l.end_date <= r.run_date + 90
  LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id
  LEFT JOIN d_property p ON p.property_id = l.property_id
  LEFT JOIN d_mkt_run m ON m.zip_code = p.zip_code AND m.run_date = r.run_date),
d_hist0 AS (SELECT c.*, @SCORE@ AS risk_score FROM d_hctx c),
d_hist AS (
  SELECT s.*, @RISK@, s.run_date AS prediction_date, CAST(s.run_date AS TIMESTAMP) AS predicted_at,
         'rules-1.0' AS model_version
  FROM d_hist0 s),
d_latest AS (
  SELECT * FROM d_hist
  QUALIFY row_number() OVER (PARTITION BY lease_id ORDER BY predicted_at DESC) = 1),
d_lease_pred AS (
  SELECT l.*, h.prediction_date, h.predicted_at, h.risk_score, h.churn_probability, h.risk_level,
         h.predicted_churn, h.confidence, h.model_version
  FROM d_lease l LEFT JOIN d_latest h ON h.lease_id = l.lease_id)
""".replace("@SCORE@", SCORE_SQL).replace("@RISK@", RISK_SQL)


def q(body: str) -> str:
    """PREFIX + body.  ``body`` is either ``SELECT ...`` or ``, x AS (...) SELECT ...``."""
    body = body.strip()
    if body.startswith(","):
        return PREFIX + body
    return PREFIX + "\n" + body


def ds(expr: str, name: str) -> str:
    """DATE output column as a yyyy-MM-dd string."""
    return f"CAST({expr} AS VARCHAR) AS {name}"


def ts(expr: str, name: str) -> str:
    """TIMESTAMP output column as a fixed 6-digit-fraction string."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"
