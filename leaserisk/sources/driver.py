"""Driver tables -> lease domain tables (deterministic mapping).

The driver data are TPC-H-like tables.  Every domain table below is a lazy
DataFrame derived from them, so its work grows with the input:

    customer (+ events aggregates) -> tenants
    part + nation + region          -> properties
    nation x months                 -> market_data
    orders + min(l_partkey)         -> leases
    lineitem                        -> payments
    events of type error            -> maintenance
    events of type purchase         -> retention actions
    events of type click/view/signup -> responses / engagement

All numbers go through integer arithmetic followed by one IEEE division, so
Spark and the DuckDB oracle produce bit-identical values.  The same rules are
written once more as SQL CTEs in ``leaserisk.plans.oracle``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaserisk.config import ACTION_TYPES, AS_OF
from leaserisk.session import ensure_utc


# Lease terms of the mapping are 12 or 24 months of 30 days.
MIN_TERM_DAYS = 360
MAX_TERM_DAYS = 720


def _lit_date(d) -> Column:
    return F.lit(d).cast("date")


def cents(c: Column) -> Column:
    """A 2-decimal double amount -> exact integer cents."""
    return F.round(c * 100).cast("long")


@dataclass
class Domain:
    """Lazy domain tables over one driver folder."""

    spark: SparkSession
    sf_dir: str
    as_of: object = AS_OF
    _cache: dict = field(default_factory=dict)

    # -- raw driver tables ---------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[key]

    def _memo(self, name, fn):
        if name not in self._cache:
            self._cache[name] = fn()
        return self._cache[name]

    # -- events-derived tenant counters -------------------------------------
    def tenant_event_counts(self) -> DataFrame:
        """Per user: portal logins (view) and complaints (error, value >= 60).

        Partial aggregation happens map-side before the shuffle on user_id.
        """
        def build():
            ev = self.raw("events")
            return (ev.filter(F.col("event_type").isin("view", "error"))
                    .groupBy(F.col("user_id").alias("tenant_id"))
                    .agg(F.count_if(F.col("event_type") == "view").alias("portal_login_count"),
                         F.count_if((F.col("event_type") == "error") & (F.col("value") >= 60))
                         .alias("complaint_count"),
                         F.max(F.when(F.col("event_type") == "view", F.col("ts")))
                         .cast("timestamp").alias("last_login_at")))
        return self._memo("tenant_event_counts", build)

    # -- domain tables -------------------------------------------------------
    def tenants(self) -> DataFrame:
        def build():
            c = self.raw("customer")
            k = F.col("c_custkey")
            seg = F.col("c_mktsegment")
            base = c.select(
                k.alias("tenant_id"),
                F.split(F.col("c_name"), "#").getItem(0).alias("first_name"),
                F.split(F.col("c_name"), "#").getItem(1).alias("last_name"),
                F.col("c_name").alias("full_name"),
                F.concat(F.lit("Tenant"), k.cast("string"), F.lit("@Mail.Example")).alias("email"),
                F.format_string("303-555-%04d", k % 10000).alias("phone"),
                F.date_add(F.lit("1940-01-01").cast("date"), ((k * 37) % 18000).cast("int"))
                .alias("date_of_birth"),
                (1 + k % 5).cast("int").alias("household_size"),
                (F.lit(40000.0) + (cents(F.col("c_acctbal")) + 100000) / 10.0).alias("annual_income"),
                F.when(seg == "HOUSEHOLD", "retired").when(seg == "MACHINERY", "employed")
                .when(seg == "BUILDING", "self-employed").when(seg == "AUTOMOBILE", "student")
                .when(seg == "FURNITURE", "unemployed").alias("employment_status"),
                F.date_add(F.lit("1990-01-01").cast("date"), (k % 1800).cast("int"))
                .cast("timestamp").alias("account_created_at"),
                (k % 5 >= 2).alias("autopay_enabled"),
                F.when(k % 10 < 5, "ach").when(k % 10 < 8, "credit-card").otherwise("debit-card")
                .alias("primary_payment_method"),
                ((k % 48) / 2.0).alias("avg_response_time_hours"),
                F.lit("active").alias("status"),
                F.col("c_nationkey").alias("nation_key"),
            )
            ev = self.tenant_event_counts()
            return (base.join(ev, "tenant_id", "left")
                    .withColumn("portal_login_count",
                                F.coalesce(F.col("portal_login_count"), F.lit(0)).cast("int"))
                    .withColumn("complaint_count",
                                F.coalesce(F.col("complaint_count"), F.lit(0)).cast("int")))
        return self._memo("tenants", build)

    def properties(self) -> DataFrame:
        def build():
            p = self.raw("part")
            n = self.raw("nation")
            r = self.raw("region")
            k = F.col("p_partkey")
            geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                              .select(F.col("n_nationkey").alias("nk"), "n_name", "r_name"))
            base = p.select(
                k.alias("property_id"),
                F.concat(k.cast("string"), F.lit(" "), F.col("p_name"), F.lit(" St"))
                .alias("address"),
                (k % 25).cast("int").alias("nk"),
                (1000 + F.col("p_size") * 40).cast("int").alias("square_feet"),
                (2 + F.col("p_size") % 4).cast("int").alias("bedrooms"),
                (1 + (F.col("p_size") % 3) / 2.0).alias("bathrooms"),
                (1950 + k % 50).cast("int").alias("year_built"),
                F.col("p_type").alias("property_type"),
                (k % 10 >= 3).alias("has_garage"),
                (k % 10 >= 2).alias("has_yard"),
                (k % 10 >= 4).alias("has_ac"),
                (1 + k % 5).cast("int").alias("condition_rating"),
                (1 + k % 10).cast("int").alias("location_score"),
                (1 + (k * 3) % 10).cast("int").alias("school_rating"),
                (F.lit(39.6392) + (k % 200) / 1000.0).alias("latitude"),
                (F.lit(-105.0903) + ((k * 7) % 200) / 1000.0).alias("longitude"),
            )
            return (base.join(geo, "nk", "left")
                    .select("property_id", "address",
                            F.col("r_name").alias("city"),
                            F.lit("CO").alias("state"),
                            F.col("nk").cast("string").alias("zip_code"),
                            F.col("n_name").alias("neighborhood"),
                            "square_feet", "bedrooms", "bathrooms", "year_built", "property_type",
                            "has_garage", "has_yard", "has_ac", "condition_rating",
                            "location_score", "school_rating", "latitude", "longitude"))
        return self._memo("properties", build)

    def market_data(self) -> DataFrame:
        """One row per (zip, month) from 1995-01 to 2001-08 (80 months)."""
        def build():
            n = self.raw("nation")
            nk = F.col("n_nationkey")
            months = F.explode(F.sequence(F.lit(0), F.lit(79))).alias("m")
            return (n.select(nk, months)
                    .select(nk.cast("string").alias("zip_code"),
                            F.add_months(F.lit("1995-01-01").cast("date"), F.col("m")).alias("data_date"),
                            (1800 + 56 * nk).cast("double").alias("market_rent_median"),
                            (3 + nk % 8).cast("int").alias("vacancy_pct"),
                            ((3 + nk % 8) / 100.0).alias("vacancy_rate"),
                            ((nk % 6) / 100.0).alias("rent_growth_1yr_pct"),
                            ((nk % 6 + 4) / 100.0).alias("rent_growth_3yr_pct"),
                            (5 + nk % 20).cast("int").alias("new_listings_30d"),
                            (20 + nk % 30).cast("int").alias("avg_days_on_market"),
                            (60000 + 1000 * nk).cast("double").alias("median_hh_income"),
                            ((nk % 4) / 100.0).alias("population_growth_rate"),
                            (30 + nk).cast("int").alias("competitor_count_1mi")))
        return self._memo("market_data", build)

    def lease_property(self) -> DataFrame:
        """Property of a lease = min(l_partkey) of its order (map-side partial min)."""
        return self._memo("lease_property", lambda: self.raw("lineitem")
                          .groupBy(F.col("l_orderkey").alias("lease_id"))
                          .agg(F.min("l_partkey").alias("property_id")))

    def leases(self) -> DataFrame:
        return self._memo("leases", lambda: leases_from_orders(self.raw("orders"), self.lease_property(),
                                                               self.as_of))

    def leases_ending(self, lo, hi) -> DataFrame:
        """Leases with lo < end_date <= hi (``lo`` None: no lower bound), built only from the orders that can
        end in that range.  A lease ends start + term * 30 days with a term
        of 12 or 24 months, so the start lies in [lo - 720 d, hi - 360 d]: a
        plain range on ``o_orderdate`` that parquet min/max statistics prune.
        Line items are reduced to those orders (semi join) before their
        per-order aggregate."""
        import datetime as dt
        lo_d = lo if lo is None or isinstance(lo, dt.date) else dt.date.fromisoformat(str(lo))
        hi_d = hi if isinstance(hi, dt.date) else dt.date.fromisoformat(str(hi))
        last = hi_d - dt.timedelta(days=MIN_TERM_DAYS) + dt.timedelta(days=1)
        o = self.raw("orders").filter(F.col("o_orderdate") < F.lit(f"{last} 00:00:00").cast("timestamp_ntz"))
        if lo_d is not None:
            first = lo_d - dt.timedelta(days=MAX_TERM_DAYS)
            o = o.filter(F.col("o_orderdate") >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
        keys = o.select(F.col("o_orderkey").alias("l_orderkey"))
        lp = (self.raw("lineitem").select("l_orderkey", "l_partkey").join(keys, "l_orderkey", "left_semi")
              .groupBy(F.col("l_orderkey").alias("lease_id")).agg(F.min("l_partkey").alias("property_id")))
        end = F.col("end_date")
        ending = leases_from_orders(o, lp, self.as_of).filter(end <= F.lit(str(hi_d)).cast("date"))
        return ending if lo_d is None else ending.filter(end > F.lit(str(lo_d)).cast("date"))

    def payments(self) -> DataFrame:
        def build():
            li = self.raw("lineitem")
            disc_pct = F.round(F.col("l_discount") * 100).cast("long")
            amount_cents = F.floor((cents(F.col("l_extendedprice")) * (100 - disc_pct) + 50) / 100).cast("long")
            days_late = F.when(F.col("l_returnflag") == "R", 1 + F.col("l_suppkey") % 15).otherwise(0).cast("int")
            return li.select(
                F.col("l_orderkey").alias("lease_id"),
                F.to_date(F.col("l_shipdate")).alias("payment_date"),
                (amount_cents / 100.0).alias("amount"),
                days_late.alias("days_late"),
                F.when(days_late > 5, 50.0).otherwise(0.0).alias("late_fee"),
                F.lit("paid").alias("status"),
            )
        return self._memo("payments", build)

    def maintenance(self) -> DataFrame:
        def build():
            ev = self.raw("events").filter(F.col("event_type") == "error")
            v = F.col("value")
            return ev.select(
                F.col("event_id").alias("request_id"),
                F.col("user_id").alias("property_id"),
                F.to_date(F.col("ts")).alias("request_date"),
                F.lit("repair").alias("request_type"),
                F.when(v >= 100, "HIGH").when(v >= 30, "MEDIUM").otherwise("LOW").alias("priority"),
                F.lit("closed").alias("status"),
                (1 + F.col("event_id") % 14).cast("int").alias("resolution_days"),
                v.alias("cost"),
            )
        return self._memo("maintenance", build)

    def actions(self) -> DataFrame:
        """Retention action log: purchase events = an action sent to a tenant."""
        def build():
            ev = self.raw("events").filter(F.col("event_type") == "purchase")
            idx = (F.col("event_id") % len(ACTION_TYPES)).cast("int")
            types = F.array(*[F.lit(t) for t in ACTION_TYPES])
            st = F.col("event_id") % 10
            return ev.select(
                F.col("event_id").alias("action_id"),
                F.col("user_id").alias("tenant_id"),
                F.col("ts").cast("timestamp").alias("triggered_at"),
                F.element_at(types, idx + 1).alias("action_type"),
                F.when(st < 6, "completed").when(st < 9, "pending").otherwise("failed").alias("status"),
                F.col("value").alias("cost"),
            )
        return self._memo("actions", build)

    def engagement(self) -> DataFrame:
        """Responses and engagement: click / view / signup events."""
        def build():
            ev = self.raw("events").filter(F.col("event_type").isin("click", "view", "signup"))
            return ev.select(F.col("event_id"), F.col("user_id").alias("tenant_id"),
                             F.col("ts").cast("timestamp").alias("ts"),
                             F.col("event_type"), F.col("value"))
        return self._memo("engagement", build)


def leases_from_orders(orders: DataFrame, lease_property: DataFrame, as_of=AS_OF) -> DataFrame:
    """orders (+ property of the lease) -> leases; works on batch and streaming
    frames alike (the property side is a static, pre-aggregated table)."""
    o = orders
    k = F.col("o_orderkey")
    a = _lit_date(as_of)
    start = F.to_date(F.col("o_orderdate"))
    term = F.when(k % 10 == 0, 24).otherwise(12)
    rent_cents = 150000 + F.floor((cents(F.col("o_totalprice")) + 125) / 250).cast("long")
    base = o.select(
        k.alias("lease_id"),
        F.col("o_custkey").alias("tenant_id"),
        start.alias("start_date"),
        term.cast("int").alias("lease_term_months"),
        F.date_add(start, (term * 30).cast("int")).alias("end_date"),
        rent_cents.alias("rent_cents"),
        (rent_cents / 100.0).alias("monthly_rent"),
        (rent_cents * (2 + k % 3) / 200.0).alias("security_deposit"),
        (k % 6).cast("int").alias("renewal_count"),
        ((k % 9) / 100.0).alias("last_rent_increase_pct"),
        F.col("o_orderstatus").alias("order_status"),
    )
    end = F.col("end_date")
    return (base.join(lease_property, "lease_id", "left")
            .select("lease_id", "tenant_id", "property_id", "start_date", "end_date",
                    "lease_term_months", "rent_cents", "monthly_rent", "security_deposit",
                    "renewal_count", "last_rent_increase_pct",
                    F.when(end > F.date_add(a, 90), "active")
                    .when(end > a, "pending-renewal")
                    .when(F.col("order_status") == "F", "not-renewed")
                    .otherwise("renewed").alias("renewal_status"),
                    F.when(end > a, "active").otherwise("expired").alias("status")))


_DOMAINS: dict = {}


def table_files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files as they are now."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for table in fs.listStatus(path):
        for f in (fs.listStatus(table.getPath()) if table.isDirectory() else [table]):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def domain(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> Domain:
    """One Domain per (application, folder, as_of) as long as the folder's files
    stay the same: its tables are immutable lazy plans, so queries reuse the same
    definitions instead of re-analysing them.  New or changed files make a new one."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001  (Spark Connect sessions have no SparkContext)
        app = spark.conf.get("spark.app.id", "connect")
    key = (app, sf_dir.rstrip("/"), str(as_of))
    ensure_utc(spark)
    files = table_files(spark, sf_dir)
    kept = _DOMAINS.get(key)
    if kept is None or kept[0] != files or kept[1].spark is not spark:
        _DOMAINS[key] = kept = (files, Domain(spark, sf_dir, as_of))
    return kept[1]
