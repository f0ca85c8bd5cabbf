"""Star schema: dimensions, facts, SCD2 and the training view.

Scale notes
-----------
* Windows are partitioned by lease (months of payments per lease are bounded
  by the lease term).  Per-tenant orderings (previous lease, running counts,
  SCD2 change detection) use ``windows.ordered_neighbors``: windows inside
  (tenant, month) plus a per-tenant window over monthly summaries, so a hot
  tenant is spread over its months instead of one task.
* Surrogate keys are ``xxhash64`` of the natural key (+ version date), so
  they are stable across runs without a global ``row_number``.
* The date dimension is generated from the data's own date range with
  ``sequence`` + ``explode`` (bounded by days in the range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.config import AS_OF, FISCAL_YEAR_START_MONTH, INCOME_BRACKETS, PAYMENT_TREND_DELTA
from leaserisk.functions import scalars as X
from leaserisk.operators.windows import asof_lookup, dealt, ordered_neighbors

# Fixed holiday list (month, day) used for is_holiday; a parameter.
HOLIDAYS = [(1, 1), (7, 4), (12, 25)]


def _a(as_of) -> Column:
    return F.lit(str(as_of)).cast("date")


# -- D1 ---------------------------------------------------------------------
def date_dim(leases: DataFrame, fiscal_start: int = FISCAL_YEAR_START_MONTH,
             holidays=HOLIDAYS) -> DataFrame:
    """One row per day from the first lease start to the last lease end."""
    rng = leases.agg(F.min("start_date").alias("lo"), F.max("end_date").alias("hi"))
    d = F.col("date")
    md = F.month(d) * 100 + F.dayofmonth(d)
    hol = F.lit(False)
    for m, day in holidays:
        hol = hol | (md == m * 100 + day)
    fy = F.when(F.month(d) >= fiscal_start, F.year(d) + 1).otherwise(F.year(d)) if fiscal_start > 1 \
        else F.year(d)
    fmonth = F.pmod(F.month(d) - fiscal_start, F.lit(12))  # 0..11 within fiscal year
    return (rng.select(F.explode(F.sequence("lo", "hi")).alias("date"))
            .select(X.date_key(d).alias("date_key"), d,
                    (F.weekday(d) + 1).alias("day_of_week"),
                    F.date_format(d, "EEEE").alias("day_name"),
                    F.dayofmonth(d).alias("day_of_month"),
                    F.dayofyear(d).alias("day_of_year"),
                    F.weekofyear(d).alias("week_of_year"),
                    F.month(d).alias("month"),
                    F.date_format(d, "MMMM").alias("month_name"),
                    F.quarter(d).alias("quarter"),
                    F.year(d).alias("year"),
                    (F.weekday(d) >= 5).alias("is_weekend"),
                    hol.alias("is_holiday"),
                    fy.alias("fiscal_year"),
                    (F.floor(fmonth / 3) + 1).cast("int").alias("fiscal_quarter")))


# -- D3 / D4 / D5 ---------------------------------------------------------------
def age_on(dob: Column, as_of) -> Column:
    a = _a(as_of)
    before = (F.month(a) * 100 + F.dayofmonth(a)) < (F.month(dob) * 100 + F.dayofmonth(dob))
    return F.year(a) - F.year(dob) - F.when(before, 1).otherwise(0)


def income_bracket(income: Column, edges=INCOME_BRACKETS) -> Column:
    names = [f"<{edges[0] // 1000}k"] + [f"{a // 1000}k-{b // 1000}k" for a, b in zip(edges, edges[1:])] \
        + [f"{edges[-1] // 1000}k+"]
    e = F.when(income.isNull(), F.lit(None))
    for edge, name in zip(edges, names):
        e = e.when(income < edge, F.lit(name))
    return e.otherwise(F.lit(names[-1]))


def tenant_dim(tenants: DataFrame, as_of=AS_OF) -> DataFrame:
    a = _a(as_of)
    created = F.to_date("account_created_at")
    tenure = F.datediff(a, created)
    return tenants.select(
        F.xxhash64("tenant_id").alias("tenant_key"), "tenant_id", "first_name", "last_name",
        X.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "email", "phone",
        age_on(F.col("date_of_birth"), as_of).alias("age"),
        "household_size", "annual_income",
        income_bracket(F.col("annual_income")).alias("income_bracket"),
        "employment_status", created.alias("account_created_date"),
        tenure.alias("account_tenure_days"), "autopay_enabled", "primary_payment_method",
        F.when(F.col("annual_income") >= 100000, "premium").when(tenure >= 1825, "established")
        .otherwise("standard").alias("tenant_segment"),
        created.alias("effective_date"), F.lit(None).cast("date").alias("end_date"),
        F.lit(True).alias("is_current"))


def property_dim(properties: DataFrame, as_of=AS_OF) -> DataFrame:
    age = X.property_age(F.col("year_built"), as_of)
    sq = F.col("square_feet")
    return properties.select(
        F.xxhash64("property_id").alias("property_key"), "property_id", "address", "city", "state",
        "zip_code", "neighborhood", "square_feet",
        F.when(sq < 1200, "<1200").when(sq < 1600, "1200-1599").when(sq < 2000, "1600-1999")
        .otherwise("2000+").alias("sqft_range"),
        "bedrooms", "bathrooms", "year_built", age.alias("property_age"),
        F.when(age <= 10, "0-10").when(age <= 25, "11-25").when(age <= 40, "26-40")
        .otherwise("40+").alias("age_bracket"),
        "property_type", "has_garage", "has_yard", "has_ac",
        (F.col("has_garage").cast("int") + F.col("has_yard").cast("int") + F.col("has_ac").cast("int"))
        .alias("amenity_score"),
        "condition_rating", "location_score", "school_rating", "latitude", "longitude")


def market_dim(market: DataFrame) -> DataFrame:
    g = F.round(F.col("rent_growth_1yr_pct") * 100).cast("int")
    vac = F.col("vacancy_pct")
    inc = F.col("median_hh_income")
    health = F.least(F.lit(100), F.greatest(
        F.lit(0), 50 + 5 * g - 3 * vac + ((inc - 60000) / 1000).cast("int")))
    return market.select(
        F.xxhash64("zip_code", "data_date").alias("market_key"), "zip_code", "data_date",
        "market_rent_median", "vacancy_rate",
        F.when(vac <= 4, "low").when(vac <= 7, "medium").otherwise("high").alias("vacancy_tier"),
        "rent_growth_1yr_pct",
        F.when(g < 2, "slow").when(g < 4, "moderate").otherwise("fast").alias("rent_growth_tier"),
        "median_hh_income",
        F.when(inc < 70000, "low").when(inc < 80000, "middle").otherwise("high").alias("income_tier"),
        "population_growth_rate", health.alias("market_health_score"))


# -- D2 / W4 / J17: SCD2 ----------------------------------------------------------
def tenant_snapshots(tenants: DataFrame, leases: DataFrame) -> DataFrame:
    """Tenant attribute snapshots taken at each lease start (household size
    as recorded on the lease application)."""
    return (leases.select("tenant_id", "lease_id", F.col("start_date").alias("snapshot_date"))
            .join(tenants.select("tenant_id", "employment_status", "primary_payment_method"),
                  "tenant_id")
            .withColumn("household_size", (1 + F.col("lease_id") % 5).cast("int"))
            .drop("lease_id"))


SCD_TRACKED = ["household_size", "employment_status", "primary_payment_method"]


def scd2_from_history(snap: DataFrame, key: str = "tenant_id", date_col: str = "snapshot_date",
                      tracked=SCD_TRACKED, parts: int | None = None) -> DataFrame:
    """D2 from full history: keep rows whose tracked attributes differ from
    the previous snapshot, then end_date = next version's effective date (W4)."""
    # one snapshot per (key, date): the smallest attribute tuple wins
    dedup = (dealt(snap, parts, key, date_col).groupBy(key, date_col).agg(F.min(F.struct(*tracked)).alias("attrs")))
    # One row per key and day is left, so a key's window holds its days at most.
    w = Window.partitionBy(key).orderBy(date_col)
    prev = F.lag("attrs").over(w)
    changes = dealt(dedup, parts, key).withColumn("prev_attrs", prev).filter(F.col("prev_attrs").isNull() | (F.col("prev_attrs") != F.col("attrs")))
    nxt = changes.withColumn(f"next_{date_col}", F.lead(date_col).over(w))
    return (nxt.select(F.xxhash64(key, date_col).alias("version_key"), key,
                       *[F.col(f"attrs.{c}").alias(c) for c in tracked],
                       F.col(date_col).alias("effective_date"),
                       F.col(f"next_{date_col}").alias("end_date"))
            .withColumn("is_current", F.col("end_date").isNull()))


def scd2_merge(current: DataFrame, incoming: DataFrame, key: str, tracked, as_of=AS_OF) -> DataFrame:
    """D2 incremental: compare hash-diff of incoming rows with current versions;
    expire changed ones (end_date = as_of) and insert new versions."""
    hc = F.xxhash64(*[F.col(c) for c in tracked])
    cur = current.filter("is_current").withColumn("_h", hc)
    inc = incoming.select(key, *tracked).withColumn("_hn", hc)
    j = cur.select(key, "_h").join(inc.select(key, "_hn"), key, "full")
    changed = j.filter(F.col("_h").isNull() | (F.col("_hn").isNotNull() & (F.col("_h") != F.col("_hn"))))
    expire_keys = changed.filter(F.col("_h").isNotNull()).select(key)
    a = _a(as_of)
    kept = current.join(expire_keys.withColumn("_x", F.lit(True)), key, "left")
    kept = kept.select(
        *[c for c in current.columns if c not in ("end_date", "is_current")],
        F.when(F.col("_x") & F.col("is_current"), a).otherwise(F.col("end_date")).alias("end_date"),
        F.when(F.col("_x") & F.col("is_current"), F.lit(False)).otherwise(F.col("is_current"))
        .alias("is_current"))
    new = (inc.join(changed.select(key), key, "left_semi")
           .select(F.xxhash64(key, a).alias("version_key"), key, *tracked,
                   a.alias("effective_date"), F.lit(None).cast("date").alias("end_date"),
                   F.lit(True).alias("is_current")))
    return kept.unionByName(new.select(*kept.columns))


def scd2_lookup(facts: DataFrame, versions: DataFrame, key: str, date_col: str, parts: int | None = None) -> DataFrame:
    """Attach the version valid at the fact's date (effective <= d < end).

    Versions of a key are contiguous (end = next version's effective date),
    so the valid version is the latest one with effective_date <= d: an as-of
    scan per (key, day) (``windows.asof_lookup``) instead of a range join,
    which would pair every fact of a hot key with every version of that key.
    """
    cols = ["version_key", "effective_date", "end_date"] + [c for c in versions.columns if c in SCD_TRACKED]
    v = versions.select(key, F.col("effective_date").alias("_eff"), *cols)
    out = asof_lookup(facts, v, key, date_col, "_eff", cols, lambda c: c.cast("date"), parts)
    return out.withColumnRenamed("end_date", "version_end_date")


# -- D6 / W3 / W6: monthly payment behaviour -------------------------------------
def payment_behavior(payments: DataFrame, leases: DataFrame,
                     delta: float = PAYMENT_TREND_DELTA) -> DataFrame:
    cents = F.round(F.col("amount") * 100).cast("long")
    m = (payments.groupBy("lease_id", F.trunc("payment_date", "month").alias("month"))
         .agg(F.count(F.lit(1)).alias("total_payments"),
              (F.sum(cents) / 100.0).alias("total_amount"),
              F.count_if(F.col("days_late") <= 0).alias("on_time_payments"),
              F.count_if(F.col("days_late") > 0).alias("late_payments"),
              F.sum("days_late").alias("_days"),
              F.max("days_late").alias("max_days_late"),
              F.sum("late_fee").alias("total_late_fees")))
    w = Window.partitionBy("lease_id").orderBy("month")
    avg_late = F.col("_days") / F.col("total_payments")
    m = (m.withColumn("avg_days_late", avg_late)
         .withColumn("_prev", F.lag("avg_days_late").over(w))
         .withColumn("rolling_3m_days_late",
                     F.sum("_days").over(w.rowsBetween(-2, 0)) /
                     F.sum("total_payments").over(w.rowsBetween(-2, 0))))
    d = F.col("avg_days_late") - F.col("_prev")
    return (m.join(leases.select("lease_id", "tenant_id"), "lease_id", "left")
            .select(F.xxhash64("lease_id", "month").alias("behavior_key"), "tenant_id", "lease_id",
                    X.date_key(F.col("month")).alias("month_key"), "month", "total_payments",
                    "total_amount", "on_time_payments", "late_payments",
                    F.round("avg_days_late", 4).alias("avg_days_late"), "max_days_late",
                    "total_late_fees",
                    F.round(F.col("on_time_payments") * 100.0 / F.col("total_payments"), 2)
                    .alias("payment_consistency_score"),
                    F.round("rolling_3m_days_late", 4).alias("rolling_3m_days_late"),
                    F.when(F.col("_prev").isNull(), "STABLE").when(d < -delta, "IMPROVING")
                    .when(d > delta, "DECLINING").otherwise("STABLE").alias("payment_trend")))


# -- D7 / W2 / W7: lease events ---------------------------------------------------
def lease_events(leases: DataFrame, history: DataFrame | None = None, as_of=AS_OF,
                 with_context: bool = True) -> DataFrame:
    """NEW at start; at end (if end <= as_of) RENEWAL when renewed else EXPIRATION.

    Rent change vs the tenant's previous lease (W2) and renewals/tenure so far
    (W7) are skew-safe ordered windows per tenant (``with_context=False``
    skips them for callers that only need the outcome events).  Risk at the event is the latest
    prediction made on or before the event date (as-of join per lease).
    """
    a = _a(as_of)
    if with_context:
        # lag / running count / running sum per tenant, skew safe (month buckets)
        base = (ordered_neighbors(leases, "tenant_id", F.trunc("start_date", "month"), ["start_date", "lease_id"],
                                  prev_cols=["monthly_rent"],
                                  prior_sums={"prior_months": F.col("lease_term_months")},
                                  prior_count="prior_leases")
                .withColumnRenamed("prev_monthly_rent", "prev_rent")
                .withColumn("prior_months", F.coalesce(F.col("prior_months"), F.lit(0))))
    else:  # outcome-only callers (training view, explores) skip the tenant ordering
        base = leases.withColumns({"prev_rent": F.lit(None).cast("double"),
                                   "prior_leases": F.lit(None).cast("long"),
                                   "prior_months": F.lit(None).cast("long")})
    end_type = F.when(F.col("renewal_status") == "renewed", "RENEWAL").otherwise("EXPIRATION")
    ev = F.array(
        F.struct(F.col("start_date").alias("event_date"), F.lit("NEW").alias("event_type")),
        F.when(F.col("end_date") <= a,
               F.struct(F.col("end_date").alias("event_date"), end_type.alias("event_type"))))
    out = (base.select("*", F.explode(F.filter(ev, lambda x: x.isNotNull())).alias("e"))
           .select("lease_id", "tenant_id", "property_id", "e.event_date", "e.event_type",
                   "monthly_rent", "security_deposit", "lease_term_months",
                   F.when(F.col("e.event_type") == "NEW", F.col("monthly_rent") - F.col("prev_rent"))
                   .alias("rent_change_amount"),
                   F.when(F.col("e.event_type") == "NEW",
                          F.round(X.rent_increase_pct(F.col("monthly_rent"), F.col("prev_rent")), 4))
                   .alias("rent_change_pct"),
                   "prior_leases", "prior_months",
                   X.churn_label(F.col("e.event_type")).alias("churned")))
    if history is not None:
        h = history.select("lease_id", F.col("prediction_date").alias("_pd"),
                           F.struct("predicted_churn", "risk_score").alias("_p"))
        j = (out.select("lease_id", "event_date").join(h, "lease_id")
             .filter(F.col("_pd") <= F.col("event_date"))
             .groupBy("lease_id", "event_date").agg(F.max_by("_p", "_pd").alias("_p")))
        out = (out.join(j, ["lease_id", "event_date"], "left")
               .withColumn("was_predicted_churn", F.col("_p.predicted_churn"))
               .withColumn("risk_score_at_event", F.col("_p.risk_score")).drop("_p"))
    return out.withColumn("event_key", F.xxhash64("lease_id", "event_type"))


# -- D10 / J6 / J8: training view -------------------------------------------------
def training_view(predictions: DataFrame, tenants_dim: DataFrame, properties_dim: DataFrame,
                  market: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions joined to the current tenant dim (inner, as the reference's
    ``WHERE t.is_current`` makes it), the property dim, the market row of the
    prediction month (composite key zip + month, J7), and the latest outcome
    event (RENEWAL / TERMINATION / EXPIRATION, J8) with its churn label (F18)."""
    outcome = (events.filter(F.col("event_type").isin("RENEWAL", "TERMINATION", "EXPIRATION"))
               .groupBy("lease_id")
               .agg(F.max_by(F.struct("event_type", "event_date"), "event_date").alias("o"))
               .select("lease_id", F.col("o.event_type").alias("outcome_type"),
                       F.col("o.event_date").alias("outcome_date")))
    t = tenants_dim.filter("is_current").select("tenant_id", "age", "income_bracket", "tenant_segment")
    p = properties_dim.select("property_id", "zip_code", "property_age", "amenity_score", "sqft_range")
    m = market.select("zip_code", "data_date", "vacancy_rate", "market_rent_median")
    return (predictions
            .join(t, "tenant_id")
            .join(p, "property_id", "left")
            .withColumn("data_date", F.trunc("prediction_date", "month"))
            .join(m, ["zip_code", "data_date"], "left")
            .join(outcome, "lease_id", "left")
            .withColumn("churned", X.churn_label(F.col("outcome_type")))
            .withColumn("training_set", F.col("outcome_type").isNotNull()))

