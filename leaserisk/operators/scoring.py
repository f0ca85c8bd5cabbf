"""Risk scoring columns: rule score (M14) and score -> probability/level.

The rule score is kept in integer hundredths of probability so that every
engine computes it exactly; probability = score / 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaserisk import config as C


def _pts(cond: Column, pts: int) -> Column:
    # Null inputs (no property / market row) add nothing.
    return F.when(cond, F.lit(pts)).otherwise(F.lit(0))


def rule_score(autopay: Column, complaints: Column, condition: Column, property_age: Column,
               rent_cents: Column, market_median: Column, tenure_days: Column,
               vacancy_pct: Column) -> Column:
    """Integer rule score 0..100 (hundredths of a churn probability)."""
    rent_vs_market = (F.when(rent_cents * 10 > market_median * 1100, F.lit(C.RULE_RENT_ABOVE_MARKET))
                      .when(rent_cents * 10 < market_median * 900, F.lit(C.RULE_RENT_BELOW_MARKET))
                      .otherwise(F.lit(0)))
    # tenure months = days / 30: > 24 months <=> days > 720; < 6 <=> days < 180
    tenure = (F.when(tenure_days > 720, F.lit(C.RULE_LONG_TENURE))
              .when(tenure_days < 180, F.lit(C.RULE_SHORT_TENURE))
              .otherwise(F.lit(0)))
    raw = (F.lit(C.RULE_BASE)
           + _pts(~autopay, C.RULE_NO_AUTOPAY)
           + _pts(complaints > 1, C.RULE_COMPLAINTS)
           + _pts(condition < 3, C.RULE_POOR_CONDITION)
           + _pts(property_age > 40, C.RULE_OLD_PROPERTY)
           + rent_vs_market + tenure
           + _pts(vacancy_pct > 7, C.RULE_HIGH_VACANCY))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(100)).cast("int")


def risk_level(score: Column, high: int = C.HIGH_THRESHOLD, medium: int = C.MEDIUM_THRESHOLD) -> Column:
    return (F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM")
            .when(score.isNotNull(), "LOW"))


def score_from_probability(p: Column) -> Column:
    """int(p * 100), truncating like the reference."""
    return (p * 100).cast("int")


def level_from_probability(p: Column) -> Column:
    """Probability variant of the level (>= 0.8 HIGH, >= 0.5 MEDIUM)."""
    return F.when(p >= 0.8, "HIGH").when(p >= 0.5, "MEDIUM").when(p.isNotNull(), "LOW")


def with_rule_risk(df: DataFrame, as_of_col: Column | None = None) -> DataFrame:
    """Adds risk_score, churn_probability, risk_level, predicted_churn, confidence.

    Expects the lease context columns produced by
    ``features.lease_context`` (autopay_enabled, complaint_count,
    condition_rating, property_age, rent_cents, market_rent_median,
    tenure_days, vacancy_pct).
    """
    s = rule_score(F.col("autopay_enabled"), F.col("complaint_count"), F.col("condition_rating"),
                   F.col("property_age"), F.col("rent_cents"), F.col("market_rent_median"),
                   F.col("tenure_days"), F.col("vacancy_pct"))
    return (df.withColumn("risk_score", s)
            .withColumns({
                "churn_probability": F.col("risk_score") / 100.0,
                "risk_level": risk_level(F.col("risk_score")),
                "predicted_churn": F.col("risk_score") >= 50,
                "confidence": F.abs(F.col("risk_score") - 50) / 50.0,
            }))


def risk_factors() -> Column:
    """Names of the rule terms that raised the score, comma separated (the
    'top features' of a rule prediction).  concat_ws skips the nulls."""
    return F.concat_ws(
        ",",
        F.when(~F.col("autopay_enabled"), F.lit("no_autopay")),
        F.when(F.col("complaint_count") > 1, F.lit("complaints")),
        F.when(F.col("condition_rating") < 3, F.lit("poor_condition")),
        F.when(F.col("property_age") > 40, F.lit("old_property")),
        F.when(F.col("rent_cents") * 10 > F.col("market_rent_median") * 1100, F.lit("rent_above_market")),
        F.when(F.col("tenure_days") < 180, F.lit("short_tenure")))
