"""BI semantic layer: explores, query builder, fan-out-safe measures,
link traversal, nested documents and detail views (A15, J9-J13, J18, J19, F19, F20).

An explore is a base DataFrame plus named joins.  ``query`` joins only the
tables whose fields are asked for, and when a one-to-many join is present it
first reduces rows to (base primary key, dimensions) so base measures are
never summed over fanned-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.functions import measures as M


@dataclass
class Join:
    name: str
    df: DataFrame
    on: list
    relationship: str = "many_to_one"  # or one_to_many
    how: str = "left"


@dataclass
class Explore:
    base: DataFrame
    primary_key: str
    joins: list = field(default_factory=list)

    def fields_of(self, j: Join) -> set:
        return set(j.df.columns) - set(j.on)


def query(ex: Explore, dims, measures, filters=None, order=None, limit=None) -> DataFrame:
    """One groupBy/agg over the explore, joining only what is needed."""
    filters = filters or {}
    needed = set(dims) | set(filters)
    df = ex.base
    fanout = False
    for j in ex.joins:
        wanted = (needed - set(df.columns)) & ex.fields_of(j)
        if not wanted:
            continue
        right = j.df
        if j.relationship == "one_to_many":
            # only the requested fields matter: the many side shrinks to its
            # distinct (key, fields) rows, so the fan-out is bounded by the
            # distinct values per key, not by the rows per key
            right = right.select(*j.on, *sorted(wanted)).dropDuplicates()
            fanout = True
        df = df.join(right, j.on, j.how)
    for c, v in filters.items():
        df = df.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    if fanout:  # J13: measure grain = base primary key
        df = df.dropDuplicates([ex.primary_key, *dims])
    out = df.groupBy(*dims).agg(*M.measures(*measures))
    if order:
        out = out.orderBy(*order)
    if limit:
        out = out.limit(limit)
    return out


def fanout_compare(base: DataFrame, many: DataFrame, on: str, pk: str, dim: str) -> DataFrame:
    """The fan-out-safe count (distinct base rows per dimension value) next
    to the row count a naive one-to-many join would produce.  The naive count
    is computed from per-key counts (base rows x many rows per key; an
    unmatched base row counts once), so no pairs are materialised."""
    safe = base.dropDuplicates([pk]).groupBy(dim).agg(F.count(F.lit(1)).alias("predictions"))
    per_key = many.groupBy(on).agg(F.count(F.lit(1)).alias("_m"))
    naive = (base.groupBy(on, dim).agg(F.count(F.lit(1)).alias("_b"))
             .join(per_key, on, "left")
             .groupBy(dim).agg(F.sum(F.col("_b") * F.coalesce(F.col("_m"), F.lit(1))).alias("joined_rows")))
    return safe.join(naive, dim, "full")


# -- J18 ---------------------------------------------------------------------------
def traverse(start: DataFrame, links: list[tuple[DataFrame, str]]) -> DataFrame:
    """Follow a path of links (each: target DataFrame, key) as equi joins."""
    df = start
    for target, key in links:
        df = df.join(target, key)
    return df


# -- J9 / F20 ------------------------------------------------------------------------
def lease_documents(leases: DataFrame, tenants: DataFrame, properties: DataFrame,
                    latest: DataFrame | None = None) -> DataFrame:
    """Lease rows with nested tenant / property (populate) and churnPrediction structs."""
    t = tenants.select("tenant_id", F.struct(*[c for c in tenants.columns]).alias("tenant"))
    p = properties.select("property_id", F.struct(*[c for c in properties.columns]).alias("property"))
    df = leases.join(t, "tenant_id", "left").join(p, "property_id", "left")
    if latest is not None:
        cp = latest.select("lease_id", F.struct(
            F.col("prediction_date").alias("lastPredictionDate"),
            F.col("churn_probability").alias("churnProbability"),
            F.col("risk_score").alias("riskScore"), F.col("risk_level").alias("riskLevel"),
            F.col("predicted_churn").alias("predictedChurn"),
            F.col("model_version").alias("modelVersion")).alias("churnPrediction"))
        df = df.join(cp, "lease_id", "left")
    return df


# -- top-k per group -----------------------------------------------------------------------
def top_k_per_group(df: DataFrame, key: str, order_cols, k: int) -> DataFrame:
    """Top-k rows per key.  Spark trims every map task to k rows per key before
    the shuffle (``WindowGroupLimit``), so a hot key sends k rows per task."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -- J19 ----------------------------------------------------------------------------------
def tenant_detail(tenants: DataFrame, leases: DataFrame, payments: DataFrame,
                  latest: DataFrame, n_payments: int = 5) -> DataFrame:
    """Tenant with current lease, its latest prediction, payment totals and the
    last ``n_payments`` payments (bounded per tenant)."""
    cur = (leases.groupBy("tenant_id")
           .agg(F.max_by(F.struct("lease_id", "monthly_rent", "end_date", "status"),
                         F.struct("start_date", "lease_id")).alias("current_lease"),
                F.count(F.lit(1)).alias("lease_count")))
    order = [F.col("payment_date").desc(), F.col("amount").desc()]
    of_lease = top_k_per_group(payments.select("lease_id", "payment_date", "amount"), "lease_id", order, n_payments).drop("rank")
    per_lease = payments.groupBy("lease_id").agg(F.count(F.lit(1)).alias("n"),
                                                 F.count_if(F.col("days_late") <= 0).alias("on_time"))
    totals = (per_lease.join(leases.select("lease_id", "tenant_id"), "lease_id")
              .groupBy("tenant_id").agg(F.sum("n").alias("total_payments"),
                                        F.sum("on_time").alias("on_time_payments")))
    # k payments per lease first, so the join to tenants carries no more.
    last = top_k_per_group(of_lease.join(leases.select("lease_id", "tenant_id"), "lease_id")
                           .select("tenant_id", "payment_date", "amount"), "tenant_id", order, n_payments)
    recent = (last.groupBy("tenant_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "payment_date", "amount"))).alias("r"))
              .select("tenant_id", F.transform("r", lambda x: F.struct(x["payment_date"].alias("date"),
                                                                       x["amount"].alias("amount")))
                      .alias("recent_payments")))
    lp = latest.select(F.col("lease_id").alias("_lid"), "risk_score", "risk_level")
    return (tenants.select("tenant_id", "full_name", "email", "status")
            .join(cur, "tenant_id", "left")
            .join(lp, F.col("current_lease.lease_id") == F.col("_lid"), "left").drop("_lid")
            .join(totals, "tenant_id", "left")
            .join(recent, "tenant_id", "left"))


def lease_detail(leases: DataFrame, tenants: DataFrame, properties: DataFrame, payments: DataFrame,
                 latest: DataFrame, n_payments: int = 5) -> DataFrame:
    """Lease with tenant, property, latest prediction, payment totals and its last ``n_payments`` payments."""
    totals = payments.groupBy("lease_id").agg(F.count(F.lit(1)).alias("total_payments"),
                                              F.count_if(F.col("days_late") <= 0).alias("on_time_payments"))
    last = top_k_per_group(payments.select("lease_id", "payment_date", "amount"), "lease_id",
                           [F.col("payment_date").desc(), F.col("amount").desc()], n_payments)
    recent = (last.groupBy("lease_id").agg(F.array_sort(F.collect_list(F.struct("rank", "payment_date", "amount"))).alias("r"))
              .select("lease_id", F.transform("r", lambda x: F.struct(x["payment_date"].alias("date"), x["amount"].alias("amount")))
                      .alias("recent_payments")))
    return (leases.select("lease_id", "tenant_id", "property_id", "start_date", "end_date", "monthly_rent", "status", "renewal_status")
            .join(tenants.select("tenant_id", "full_name", "email"), "tenant_id", "left")
            .join(properties.select("property_id", "address", "neighborhood"), "property_id", "left")
            .join(latest.select("lease_id", "risk_score", "risk_level"), "lease_id", "left")
            .join(totals, "lease_id", "left").join(recent, "lease_id", "left"))


# -- J18: link registry --------------------------------------------------------------------
# link name -> (target table builder on a Domain, join key)
LINKS = {
    "tenant_leases": (lambda dom: dom.leases().select("tenant_id", "lease_id", "property_id", "status"), "tenant_id"),
    "lease_property": (lambda dom: dom.properties().select("property_id", "neighborhood", "zip_code"), "property_id"),
    "lease_payments": (lambda dom: dom.payments().select("lease_id", "payment_date", "amount"), "lease_id"),
    "property_maintenance": (lambda dom: dom.maintenance().select("property_id", "request_id", "priority"),
                             "property_id"),
    "tenant_actions": (lambda dom: dom.actions().select("tenant_id", "action_id", "action_type"), "tenant_id"),
}


def traverse_links(dom, start: DataFrame, path: list[str]) -> DataFrame:
    """Follow named links from the registry (equi joins in order)."""
    return traverse(start, [(LINKS[name][0](dom), LINKS[name][1]) for name in path])


def property_detail(properties: DataFrame, leases: DataFrame, latest: DataFrame, maintenance: DataFrame,
                    n_requests: int = 3) -> DataFrame:
    """J19 (property view): lease and risk roll-up plus the last ``n_requests``
    maintenance requests (bounded per property)."""
    lr = (leases.select("lease_id", "property_id", "status")
          .join(latest.select("lease_id", "risk_score", "risk_level"), "lease_id", "left")
          .groupBy("property_id")
          .agg(F.count_if(F.col("status") == "active").alias("active_leases"),
               F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
               F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_leases")))
    mc = maintenance.groupBy("property_id").agg(F.count(F.lit(1)).alias("maintenance_requests"))
    last = top_k_per_group(maintenance.select("property_id", "request_id", "request_date", "priority"),
                           "property_id", [F.col("request_date").desc(), F.col("request_id").desc()], n_requests)
    recent = (last.groupBy("property_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "request_date", "priority"))).alias("r"))
              .select("property_id", F.array_join(F.transform("r", lambda x: F.concat(
                  x["request_date"].cast("string"), F.lit(":"), x["priority"])), ";").alias("recent_requests")))
    return (properties.select("property_id", "address", "neighborhood")
            .join(lr, "property_id", "left").join(mc, "property_id", "left").join(recent, "property_id", "left"))
