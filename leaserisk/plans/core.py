"""Flagship and scoring queries (P3 + J1/J2/J5 + M14 + F11-F13)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leaserisk.config import AS_OF
from leaserisk.operators import features as FE
from leaserisk.operators import filters as P
from leaserisk.operators import scoring as S
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.sources.driver import domain


def scored_leases(spark, sf_dir, as_of=AS_OF):
    dom = domain(spark, sf_dir, as_of)
    return S.with_rule_risk(FE.lease_context(dom, as_of))


def renewal_risk_by_neighborhood(spark, sf_dir, as_of=AS_OF, days=90):
    dom = domain(spark, sf_dir, as_of)
    window = dom.leases_ending(as_of, as_of + dt.timedelta(days=days))
    w = S.with_rule_risk(FE.lease_context(dom, as_of, window)).filter(P.renewal_window(as_of, days))
    return (w.groupBy("neighborhood").agg(
        F.count("*").alias("leases"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk"),
        F.count_if(F.col("risk_level") == "LOW").alias("low_risk"),
        F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
        (F.sum(F.when(F.col("risk_level") == "HIGH", F.col("rent_cents")).otherwise(0)) / 100.0)
        .alias("rent_at_risk")))


register("p03_renewal_risk_by_neighborhood", q("""
SELECT neighborhood,
       count(*) AS leases,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
       count(*) FILTER (WHERE risk_level = 'LOW') AS low_risk,
       round(avg(risk_score), 4) AS avg_risk_score,
       CAST(sum(CASE WHEN risk_level = 'HIGH' THEN rent_cents ELSE 0 END) AS DOUBLE) / 100 AS rent_at_risk
FROM d_scored
WHERE status = 'active' AND end_date <= DATE '1999-01-01' + 90
GROUP BY neighborhood
"""), headline=True)(renewal_risk_by_neighborhood)


def m14_rule_score(spark, sf_dir):
    """M14 + F11-F13 for every lease (scored row per lease)."""
    s = scored_leases(spark, sf_dir)
    return s.select("lease_id", "tenant_id", "property_id", "risk_score", "churn_probability",
                    "risk_level", "predicted_churn", "confidence")


register("m14_rule_score", q("""
SELECT lease_id, tenant_id, property_id, risk_score, churn_probability, risk_level,
       predicted_churn, confidence
FROM d_scored
"""), headline=True)(m14_rule_score)
