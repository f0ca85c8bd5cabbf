"""Named measures of the BI view (A7-A14) and the ontology metric registry.

A measure is a function returning an aggregate ``Column``; any set of them
is evaluated in a single ``groupBy().agg(...)`` pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.config import CAMPAIGN_COST, TURNOVER_COST
from leaserisk.functions.stats import with_stats


def _lvl(level: str) -> Column:
    return F.col("risk_level") == level


def count() -> Column:
    return F.count(F.lit(1))


def count_level(level: str) -> Column:
    return F.count_if(_lvl(level))


def count_predicted_churn() -> Column:
    return F.count_if(F.col("predicted_churn"))


def ratio(num: Column, den: Column) -> Column:
    """Num / nullif(den, 0) as double."""
    return num.cast("double") / F.nullif(den, F.lit(0))


MEASURES = {
    "count": lambda: count(),
    "count_high_risk": lambda: count_level("HIGH"),
    "count_medium_risk": lambda: count_level("MEDIUM"),
    "count_low_risk": lambda: count_level("LOW"),
    "count_predicted_churn": lambda: count_predicted_churn(),
    "average_risk_score": lambda: F.round(F.avg("risk_score"), 4),
    "average_churn_probability": lambda: F.round(F.avg("churn_probability"), 4),
    "average_days_to_expiration": lambda: F.round(F.avg("days_to_expiration"), 4),
    "median_risk_score": lambda: F.median("risk_score"),  # measure_frame uses the histogram form
    "total_monthly_rent_at_risk": lambda: F.sum(F.when(_lvl("HIGH"), F.col("rent_cents"))) / 100.0,
    "estimated_turnover_cost": lambda: count_level("HIGH") * TURNOVER_COST,
    "churn_rate": lambda: F.round(ratio(count_predicted_churn(), count()), 6),
    "high_risk_percentage": lambda: F.round(ratio(count_level("HIGH"), count()) * 100, 4),
}


def measures(*names: str) -> list[Column]:
    return [MEASURES[n]().alias(n) for n in names]


ALL = list(MEASURES)

#: Grain -> base metrics of that grain, evaluated together in one aggregation of its rows.
GRAINS = {
    "prediction": MEASURES,
    "action": {"campaign_actions": lambda: count()},
    "campaign_lease": {"campaign_leases": lambda: count(),
                       "renewed_leases": lambda: F.count_if(F.col("renewal_status") == "renewed")},
}
#: Metric -> (metrics it is made of, of any grain; formula over their columns).
DERIVED = {
    "high_risk_tenant_count": (("count_high_risk",), lambda a: a),
    "churn_ratio": (("churn_rate",), lambda a: a),
    "turnovers_avoided": (("campaign_actions", "renewed_leases", "campaign_leases"),
                          lambda n, r, c: F.coalesce(n, F.lit(0)) * ratio(F.coalesce(r, F.lit(0)), c)),
    "campaign_costs": (("campaign_actions",), lambda n: F.coalesce(n, F.lit(0)) * CAMPAIGN_COST),
    "retention_campaign_roi": (("turnovers_avoided", "campaign_costs"), lambda a, c: F.round(
        ratio(a * TURNOVER_COST - c, c) * 100, 4)),
}


def _bases(name: str) -> set[str]:
    return set().union(*map(_bases, DERIVED[name][0])) if name in DERIVED else {name}


def _value(name: str) -> Column:
    if name not in DERIVED:
        return F.col(name)
    parts, formula = DERIVED[name]
    return formula(*map(_value, parts))


def metric_frame(names, frames: dict[str, DataFrame], dims=()) -> DataFrame:
    """Named metrics by ``dims`` (or one row): each grain that they need is aggregated on its own rows, the aggregates are
    joined on the dimensions (a null value is a group too), and formulas run over the joined row.

    ``frames``: rows of each grain, all with the dimensions.  A group that one grain lacks has null (formulas may
    take that as none).  A name or grain that isn't there raises KeyError.
    """
    needed, dims, out = set().union(*map(_bases, names)), list(dims), None
    for grain, own in GRAINS.items():
        wanted = [n for n in own if n in needed]
        if not wanted:
            continue
        part = frames[grain].groupBy(*dims).agg(*[own[n]().alias(n) for n in wanted])
        if out is None:
            out = part
        elif dims:
            left, right = out.alias("_a"), part.alias("_b")
            same = [F.col(f"_a.{d}").eqNullSafe(F.col(f"_b.{d}")) for d in dims]
            out = left.join(right, same, "full").select(
                *[F.coalesce(f"_a.{d}", f"_b.{d}").alias(d) for d in dims],
                *[F.col(f"_a.{c}") for c in out.columns if c not in dims], *[F.col(f"_b.{c}") for c in wanted])
        else:
            out = with_stats(out, part)
        needed -= set(wanted)
    if needed:
        raise KeyError(f"no metric {sorted(needed)}")
    return out.select(*dims, *[_value(n).alias(n) for n in names])


# Ontology metrics by name -> measure name
ONTOLOGY_METRICS = {
    "high_risk_tenant_count": "count_high_risk",
    "average_risk_score": "average_risk_score",
    "churn_ratio": "churn_rate",
}


def median_small_domain(df: DataFrame, value: str, group_cols=(), name: str = "median") -> DataFrame:
    """Exact (interpolated) median of an integer column with a small domain
    (risk scores 0..100): count per value (partial aggregation, at most 101
    rows per group), cumulative counts over those rows, then the one or two
    middle values.  Memory does not grow with the rows, unlike ``median``."""
    g = list(group_cols)
    h = df.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g).orderBy(value)
    h = h.withColumns({"_cum": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                       "_n": F.sum("_c").over(Window.partitionBy(*g))})
    lo = F.floor((F.col("_n") + 1) / 2)
    hi = F.floor(F.col("_n") / 2) + 1
    out = h.groupBy(*g).agg(F.min(F.when(F.col("_cum") >= lo, F.col(value))).alias("_lo"),
                            F.min(F.when(F.col("_cum") >= hi, F.col(value))).alias("_hi"))
    return out.select(*g, ((F.col("_lo") + F.col("_hi")) / 2.0).alias(name))


def measure_frame(df: DataFrame, names, group_cols=()) -> DataFrame:
    """Evaluate named measures in one aggregation; ``median_risk_score`` is
    computed with ``median_small_domain`` and attached by group."""
    g = list(group_cols)
    plain = [n for n in names if n != "median_risk_score"]
    agg = df.groupBy(*g).agg(*measures(*plain)) if g else df.agg(*measures(*plain))
    if "median_risk_score" not in names:
        return agg
    med = median_small_domain(df, "risk_score", g, "median_risk_score")
    if not g:
        return with_stats(agg, med)
    # null-safe on the group keys: a null dimension value is a group too
    a, m = agg.alias("_a"), med.alias("_m")
    cond = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_m.{c}")) for c in g]
    return a.join(m, cond, "left").select(*[F.col(f"_a.{c}") for c in g], *[F.col(f"_a.{n}") for n in plain],
                                          F.col("_m.median_risk_score"))
