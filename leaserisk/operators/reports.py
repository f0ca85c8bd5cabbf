"""Report operators: risk summaries, trends, cohorts, heatmap, KPIs, top-k, pages
(A3-A4, A16-A22, A28, K3, K4).

All counts are taken in one aggregation pass with ``count_if`` rather than
one query per count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.config import PREVENTABLE_SHARE, SAVING_PER_PREVENTED, TURNOVER_COST
from leaserisk.functions import measures as M
from leaserisk.functions.stats import with_stats


def risk_summary(leases_pred: DataFrame, extended: bool = False) -> DataFrame:
    """A3/A4 over active leases with their latest prediction."""
    a = leases_pred.filter(F.col("status") == "active")
    total = F.count(F.lit(1))
    df = a.agg(total.alias("total_active"),
               M.count_level("HIGH").alias("high_risk"),
               M.count_level("MEDIUM").alias("medium_risk"),
               M.count_level("LOW").alias("low_risk"),
               F.count_if(F.col("risk_level").isNull()).alias("unpredicted"))

    def pct(c):  # (count / total) * 100, 0 when there is no active lease
        return F.when(F.col("total_active") == 0, F.lit(0.0)).otherwise(
            F.col(c) / F.col("total_active") * 100)

    df = df.withColumn("high_risk_pct", pct("high_risk"))
    if extended:
        df = df.withColumns({"medium_risk_pct": pct("medium_risk"),
                             "low_risk_pct": pct("low_risk"),
                             "estimated_turnover_cost": F.col("high_risk") * TURNOVER_COST})
    return df


def business_impact(summary: DataFrame, share: float = PREVENTABLE_SHARE,
                    saving: int = SAVING_PER_PREVENTED) -> DataFrame:
    """At-risk (HIGH + MEDIUM), preventable share, savings."""
    at_risk = F.col("high_risk") + F.col("medium_risk")
    return summary.select(at_risk.alias("at_risk"),
                          F.round(at_risk * share).cast("long").alias("preventable"),
                          (F.round(at_risk * share).cast("long") * saving).alias("estimated_savings"))


def trend(history: DataFrame, grain: str = "month", date_col: str = "prediction_date",
          since=None, until=None) -> DataFrame:
    """Per day/week/month bucket: avg score, H/M/L counts, predicted churn rate."""
    d = F.col(date_col)
    df = history
    if since is not None:
        df = df.filter(d >= F.lit(str(since)).cast("date"))
    if until is not None:
        df = df.filter(d <= F.lit(str(until)).cast("date"))
    bucket = F.trunc(d, grain) if grain in ("month", "year", "quarter", "week") else d
    if grain == "week":
        bucket = F.date_trunc("week", d).cast("date")
    return (df.groupBy(bucket.alias("period"))
            .agg(F.count(F.lit(1)).alias("predictions"),
                 F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
                 M.count_level("HIGH").alias("high_risk"),
                 M.count_level("MEDIUM").alias("medium_risk"),
                 M.count_level("LOW").alias("low_risk"),
                 F.round(M.ratio(M.count_predicted_churn(), F.count(F.lit(1))), 6)
                 .alias("predicted_churn_rate")))


def cohorts(scored: DataFrame, dims=("property_type", "neighborhood", "lease_term_months")) -> DataFrame:
    """Measures per cohort."""
    return scored.groupBy(*dims).agg(*M.measures("count", "count_high_risk", "average_risk_score",
                                                 "churn_rate"))


def heatmap(scored: DataFrame, cell: float = 0.05) -> DataFrame:
    """Risk per map cell (floor(lat / cell), floor(lon / cell))."""
    return (scored.filter(F.col("latitude").isNotNull())
            .groupBy(F.floor(F.col("latitude") / cell).alias("lat_cell"),
                     F.floor(F.col("longitude") / cell).alias("lon_cell"))
            .agg(F.count(F.lit(1)).alias("leases"),
                 F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
                 M.count_level("HIGH").alias("high_risk")))


def top_risk(scored: DataFrame, n: int = 50, levels=("HIGH", "MEDIUM")) -> DataFrame:
    """K3: highest risk first (score desc, lease id asc) = TakeOrderedAndProject."""
    return (scored.filter((F.col("status") == "active") & F.col("risk_level").isin(*levels))
            .orderBy(F.col("risk_score").desc(), F.col("lease_id").asc())
            .limit(n))


def page(df: DataFrame, key: str, page_no: int = 1, limit: int = 50, max_limit: int = 100) -> DataFrame:
    """K4: page/offset form with total and total_pages columns.

    The total is one count aggregate attached as a scalar subquery.  For deep paging use ``keyset_page``.
    """
    if not 1 <= limit <= max_limit or page_no < 1:
        raise ValueError(f"page from 1 and limit from 1 to {max_limit}, not {page_no} and {limit}")
    rows = df.orderBy(F.col(key)).offset((page_no - 1) * limit).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return (with_stats(rows, total)
            .withColumns({"page": F.lit(page_no), "limit": F.lit(limit),
                          "total_pages": F.ceil(F.col("total") / F.lit(limit)).cast("long")}))


def keyset_page(df: DataFrame, key: str, after=None, limit: int = 50) -> DataFrame:
    """K4 keyset form: rows with key > after, first ``limit`` by key."""
    if after is not None:
        df = df.filter(F.col(key) > F.lit(after))
    return df.orderBy(F.col(key)).limit(limit)


def tenant_payment_history(payments: DataFrame, leases: DataFrame) -> DataFrame:
    """Per tenant total payments, on-time (days_late <= 0), avg days late.

    Payments are first reduced per lease (map-side partial aggregation), so
    the join to leases and the per-tenant shuffle carry one row per lease.
    """
    per_lease = payments.groupBy("lease_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("days_late") <= 0).alias("on_time"),
        F.sum("days_late").alias("days"))
    return (per_lease.join(leases.select("lease_id", "tenant_id"), "lease_id")
            .groupBy("tenant_id")
            .agg(F.sum("n").alias("total_payments"),
                 F.sum("on_time").alias("on_time_payments"),
                 F.round(F.sum("days") / F.sum("n"), 4).alias("avg_days_late")))


def property_rollup(scored: DataFrame) -> DataFrame:
    """Per property roll-up."""
    return scored.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("leases"),
        F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
        M.count_level("HIGH").alias("high_risk"),
        (F.sum(F.when(F.col("risk_level") == "HIGH", F.col("rent_cents")).otherwise(0)) / 100.0)
        .alias("rent_at_risk"))
