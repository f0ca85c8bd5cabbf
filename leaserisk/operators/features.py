"""Source merge (E1 = A1 + A2 + J1..J5) and the feature matrix.

Aggregates are computed before they are joined (payments per lease,
maintenance per property), so every join is many-to-one on its key and
nothing fans out.  The as-of market row is reduced to one row per zip before
the join, which bounds it by the number of zips (safe to broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaserisk.config import AS_OF

TENANT_COLS = ["tenant_id", "full_name", "email", "annual_income", "employment_status",
               "autopay_enabled", "primary_payment_method", "portal_login_count",
               "complaint_count", "avg_response_time_hours"]
PROPERTY_COLS = ["property_id", "zip_code", "neighborhood", "city", "property_type", "square_feet",
                 "bedrooms", "bathrooms", "year_built", "has_garage", "has_yard", "has_ac",
                 "condition_rating", "location_score", "school_rating", "latitude", "longitude"]
MARKET_COLS = ["zip_code", "data_date", "market_rent_median", "vacancy_pct", "vacancy_rate",
               "rent_growth_1yr_pct", "rent_growth_3yr_pct", "new_listings_30d",
               "avg_days_on_market", "median_hh_income", "population_growth_rate",
               "competitor_count_1mi"]


def as_of_col(as_of) -> Column:
    return F.lit(str(as_of)).cast("date")


def market_as_of(market: DataFrame, as_of=AS_OF) -> DataFrame:
    """Latest market row per zip with data_date <= as_of.

    ``max_by`` over a struct is a plain hash aggregate (partial + final), no
    sort window; the result has one row per zip.
    """
    cols = [c for c in MARKET_COLS if c != "zip_code"]
    return (market.filter(F.col("data_date") <= as_of_col(as_of))
            .groupBy("zip_code")
            .agg(F.max_by(F.struct(*cols), F.col("data_date")).alias("m"))
            .select("zip_code", "m.*"))


def market_as_of_rows(rows: DataFrame, market: DataFrame, row_key: str, date_col: str) -> DataFrame:
    """General J5 form: per row, the latest market row of its zip with
    data_date <= the row's own date.  The as-of scan runs over the distinct
    (zip, date) pairs, so neither a hot zip nor a hot day sends its rows to
    one task; rows without a zip or date have no market row."""
    from leaserisk.operators.windows import asof_lookup
    cols = [c for c in MARKET_COLS if c != "zip_code"]
    m = market.select("zip_code", F.col("data_date").alias("_md"), *cols)
    pairs = rows.select("zip_code", date_col).filter(F.col("zip_code").isNotNull() & F.col(date_col).isNotNull()).distinct()
    found = asof_lookup(pairs, m, "zip_code", date_col, "_md", cols, lambda c: F.trunc(c, "year"))
    return rows.select(row_key, "zip_code", date_col).join(found, ["zip_code", date_col], "left")


def lease_context(dom, as_of=AS_OF, leases: DataFrame | None = None) -> DataFrame:
    """Leases (all, or the given subset) with tenant, property and as-of market
    columns (J1, J2, J5).  The all-leases form is built once per domain."""
    if leases is None:
        return dom._memo(("lease_context", str(as_of)), lambda: _lease_context(dom, as_of, None))
    return _lease_context(dom, as_of, leases)


def _lease_context(dom, as_of, leases) -> DataFrame:
    a = as_of_col(as_of)
    t = dom.tenants().select(*TENANT_COLS)
    p = dom.properties().select(*PROPERTY_COLS)
    m = market_as_of(dom.market_data(), as_of)  # one row per zip
    return ((leases if leases is not None else dom.leases())
            .join(t, "tenant_id", "left")
            .join(p, "property_id", "left")
            .join(m, "zip_code", "left")
            .withColumns({
                "property_age": F.year(a) - F.col("year_built"),
                "tenure_days": F.datediff(a, F.col("start_date")),
                "days_to_expiration": F.datediff(F.col("end_date"), a),
            }))


# --------------------------------------------------------------------------
# A1 / A2: aggregates before the join
# --------------------------------------------------------------------------
def payment_aggregates(payments: DataFrame) -> DataFrame:
    """A1: per lease sum/mean/sample-std/count of amount, days-late stats, last date.

    Money sums run on integer cents (exact and order independent).
    """
    c = F.round(F.col("amount") * 100).cast("long")
    return payments.groupBy("lease_id").agg(
        (F.sum(c) / 100.0).alias("total_paid"),
        (F.sum(c) / F.count("amount") / 100.0).alias("avg_payment"),
        F.stddev_samp("amount").alias("payment_std"),
        F.count("amount").alias("payment_count"),
        F.avg("days_late").alias("avg_days_late"),
        F.max("days_late").alias("max_days_late"),
        F.sum("days_late").alias("total_days_late"),
        F.max("payment_date").alias("last_payment_date"),
        F.sum("late_fee").alias("total_late_fees"),
    )


def maintenance_aggregates(maint: DataFrame) -> DataFrame:
    """A2: per property request count, HIGH-priority count, mean resolution days."""
    return maint.groupBy("property_id").agg(
        F.count("request_id").alias("maintenance_count"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority_requests"),
        F.avg("resolution_days").alias("avg_resolution_days"),
    )


def merged_sources(dom, as_of=AS_OF, leases: DataFrame | None = None) -> DataFrame:
    """Lease context + payment aggregate (J3) + maintenance aggregate (J4), for
    all leases or the given ones, whose payments alone are then aggregated."""
    payments = dom.payments()
    if leases is not None:
        payments = payments.join(leases.select("lease_id"), "lease_id", "left_semi")
    return (lease_context(dom, as_of, leases)
            .join(payment_aggregates(payments), "lease_id", "left")
            .join(maintenance_aggregates(dom.maintenance()), "property_id", "left"))


# --------------------------------------------------------------------------
# Feature groups.  ``d`` = default when the column is absent (plan time);
# nulls in a present column are left to imputation unless marked fill.
# --------------------------------------------------------------------------
def _col(df: DataFrame, name: str, default, *alts: str) -> Column:
    for n in (name, *alts):
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def _fill(df, name, value=0):
    return F.coalesce(_col(df, name, value), F.lit(value))


def behaviour_features(df: DataFrame, as_of=AS_OF) -> list[Column]:
    a = as_of_col(as_of)
    tenure = _col(df, "tenure_months", 0)
    last = _col(df, "last_payment_date", None)
    return [
        _fill(df, "avg_days_late").cast("double").alias("avg_days_late"),
        _fill(df, "max_days_late").cast("double").alias("max_days_late"),
        F.coalesce(_col(df, "total_days_late", 0) / _col(df, "payment_count", None), F.lit(0.0))
        .alias("late_payment_rate"),
        (1.0 / (1.0 + _fill(df, "payment_std", 0.0))).alias("payment_consistency"),
        (F.datediff(a, last) if "last_payment_date" in df.columns else F.lit(0)).alias("days_since_last_payment"),
        _col(df, "autopay_enabled", False).cast("int").alias("has_autopay"),
        (_col(df, "portal_login_count", 0) / F.greatest(_col(df, "tenure_months", 1), F.lit(1)))
        .alias("portal_logins_per_month"),
        (_fill(df, "maintenance_count") / F.greatest(_col(df, "tenure_months", 12) / 12.0, F.lit(1.0)))
        .alias("maintenance_requests_per_year"),
        _fill(df, "high_priority_requests").cast("long").alias("high_priority_requests"),
        _col(df, "avg_response_time_hours", 24).cast("double").alias("avg_response_time_hours"),
        _col(df, "missed_communication_count", 0).alias("missed_communication_count"),
        _col(df, "complaint_count", 0).alias("complaint_count"),
        _col(df, "escalation_count", 0).alias("escalation_count"),
        _col(df, "renewal_count", 0).alias("previous_renewals"),
        tenure.alias("tenure_months"),
    ]


def property_features(df: DataFrame, as_of=AS_OF) -> list[Column]:
    a = as_of_col(as_of)
    return [
        _col(df, "square_feet", 1500).alias("square_feet"),
        _col(df, "bedrooms", 3).alias("bedrooms"),
        _col(df, "bathrooms", 2).alias("bathrooms"),
        (F.year(a) - _col(df, "year_built", 2000)).alias("property_age"),
        _col(df, "location_score", 5).alias("location_score"),
        _col(df, "school_rating", 5).alias("school_rating"),
        _col(df, "has_garage", False, "garage").cast("int").alias("has_garage"),
        _col(df, "has_yard", False, "yard").cast("int").alias("has_yard"),
        _col(df, "has_ac", False, "air_conditioning").cast("int").alias("has_ac"),
        _col(df, "condition_rating", 3).alias("property_condition"),
        _col(df, "years_since_renovation", 10).alias("years_since_renovation"),
        _col(df, "neighborhood_type", "suburban").alias("neighborhood_type"),
    ]


def financial_features(df: DataFrame) -> list[Column]:
    rent = _col(df, "monthly_rent", 2000)
    if "annual_income" in df.columns:
        ratio = rent * 12 / F.col("annual_income")
        # least() skips nulls, so a null ratio must stay null explicitly
        r2i = F.when(ratio.isNull(), F.lit(None)).otherwise(F.least(ratio, F.lit(1.0)))
    else:
        r2i = F.lit(0.30)
    return [
        rent.alias("monthly_rent"),
        (rent / _col(df, "square_feet", 1500)).alias("rent_per_sqft"),
        r2i.cast("double").alias("rent_to_income_ratio"),
        _col(df, "last_rent_increase_pct", 0).alias("rent_increase_pct"),
        _col(df, "rent_increase_count", 0).alias("total_rent_increases"),
        _col(df, "primary_payment_method", "ach").alias("payment_method"),
        (_col(df, "security_deposit", 2000) / rent).alias("security_deposit_months"),
        _col(df, "total_late_fees", 0).alias("total_late_fees"),
    ]


def market_features(df: DataFrame) -> list[Column]:
    rent = _col(df, "monthly_rent", 2000)
    median = _col(df, "market_rent_median", 2000)
    return [
        median.alias("market_rent_median"),
        (rent / median).alias("rent_vs_market"),
        _col(df, "vacancy_rate", 0.05).alias("neighborhood_vacancy_rate"),
        _col(df, "rent_growth_1yr_pct", 0.03).alias("market_rent_growth_1yr"),
        _col(df, "rent_growth_3yr_pct", 0.10).alias("market_rent_growth_3yr"),
        _col(df, "new_listings_30d", 10).alias("new_listings_count"),
        _col(df, "avg_days_on_market", 30).alias("avg_days_on_market"),
        _col(df, "median_hh_income", 75000).alias("median_household_income"),
        _col(df, "population_growth_rate", 0.01).alias("population_growth_rate"),
        _col(df, "competitor_count_1mi", 50).alias("competitor_properties_1mi"),
    ]


def temporal_features(df: DataFrame, as_of=AS_OF) -> list[Column]:
    a = as_of_col(as_of)
    end = _col(df, "lease_end_date", None, "end_date")
    has_end = any(c in df.columns for c in ("lease_end_date", "end_date"))
    month = F.month(end) if has_end else F.lit(1)
    return [
        (F.datediff(end, a) if has_end else F.lit(90)).alias("days_to_expiration"),
        _col(df, "lease_term_months", 12).alias("lease_term_months"),
        month.alias("lease_end_month"),
        (month.isin(6, 7, 8).cast("int") if has_end else F.lit(0)).alias("is_summer_expiration"),
    ]


FEATURE_GROUPS = {
    "behavior": behaviour_features,
    "property": property_features,
    "financial": lambda df, as_of=AS_OF: financial_features(df),
    "market": lambda df, as_of=AS_OF: market_features(df),
    "temporal": temporal_features,
}


def feature_input(dom, as_of=AS_OF, leases: DataFrame | None = None) -> DataFrame:
    """E1 plus the columns the feature definitions read (tenure months)."""
    if leases is not None:
        return _feature_input(dom, as_of, leases)
    return dom._memo(("feature_input", str(as_of)), lambda: _feature_input(dom, as_of, None))


def _feature_input(dom, as_of, leases) -> DataFrame:
    a = as_of_col(as_of)
    df = merged_sources(dom, as_of, leases)
    start = F.col("start_date")
    return df.withColumn(
        "tenure_months",
        F.when(start.isNull(), F.lit(0)).otherwise(
            (F.year(a) - F.year(start)) * 12 + F.month(a) - F.month(start)))


def feature_matrix(df: DataFrame, as_of=AS_OF, with_market: bool = True,
                   keys=("lease_id", "tenant_id", "property_id")) -> DataFrame:
    """All feature columns in one select (49 names; tenure_months once)."""
    cols = [F.col(k) for k in keys if k in df.columns]
    for name, fn in FEATURE_GROUPS.items():
        if name == "market" and not with_market:
            continue
        cols += fn(df, as_of)
    return df.select(*cols)


def feature_catalog() -> list[tuple[str, str]]:
    """(feature, category) pairs in matrix order."""
    names = {
        "behavior": ["avg_days_late", "max_days_late", "late_payment_rate", "payment_consistency",
                     "days_since_last_payment", "has_autopay", "portal_logins_per_month",
                     "maintenance_requests_per_year", "high_priority_requests",
                     "avg_response_time_hours", "missed_communication_count", "complaint_count",
                     "escalation_count", "previous_renewals", "tenure_months"],
        "property": ["square_feet", "bedrooms", "bathrooms", "property_age", "location_score",
                     "school_rating", "has_garage", "has_yard", "has_ac", "property_condition",
                     "years_since_renovation", "neighborhood_type"],
        "financial": ["monthly_rent", "rent_per_sqft", "rent_to_income_ratio", "rent_increase_pct",
                      "total_rent_increases", "payment_method", "security_deposit_months",
                      "total_late_fees"],
        "market": ["market_rent_median", "rent_vs_market", "neighborhood_vacancy_rate",
                   "market_rent_growth_1yr", "market_rent_growth_3yr", "new_listings_count",
                   "avg_days_on_market", "median_household_income", "population_growth_rate",
                   "competitor_properties_1mi"],
        "temporal": ["days_to_expiration", "lease_term_months", "lease_end_month",
                     "is_summer_expiration"],
    }
    return [(f, g) for g, fs in names.items() for f in fs]


def merge_suffixed(left: DataFrame, right: DataFrame, on: str, suffix: str, how: str = "left") -> DataFrame:
    """Join where right-side columns that collide with left-side ones
    get ``suffix`` (the left value keeps its name)."""
    ren = [F.col(c).alias(c + suffix if c in left.columns and c != on else c) for c in right.columns]
    return left.join(right.select(*ren), on, how)
