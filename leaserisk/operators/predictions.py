"""Scheduled scoring runs and the latest prediction per lease.

A scoring run at date ``d``, the first of a month, scores the leases whose end
date falls in the renewal window of ``d`` (0 < end - d <= 90).  Runs follow
from the rows: a lease is scored by the months' firsts before its end, so no list
of run dates is kept, and the newest run of a lease is a date expression of its
end.  ``latest_predictions`` finds the latest row of any stored history
(``max_by``, no sort window); ``latest_of`` scores each lease's newest run alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.config import RENEWAL_WINDOW_DAYS
from leaserisk.operators import features as FE
from leaserisk.operators import scoring as S

MODEL_VERSION = "rules-1.0"


def _date(d) -> Column:
    return F.lit(str(d)).cast("date")


def first_run_from(day: Column) -> Column:
    """The first of a month on or after ``day``."""
    month = F.trunc(day, "month")
    return F.when(month == day, day).otherwise(F.to_date(F.add_months(month, 1)))


def last_run_before(day: Column) -> Column:
    """The newest first of a month before ``day``."""
    return F.to_date(F.trunc(F.date_sub(day, 1), "month"))


def runs_between(lo: Column, hi: Column) -> Column:
    """array<date>: the runs from ``lo`` on and before ``hi``."""
    first, last = first_run_from(lo), last_run_before(hi)
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def market_for_runs(market: DataFrame, first=None, last=None) -> DataFrame:
    """As-of market row per (zip, run_date): each row holds for the runs from its date to the next row's
    (one window over a zip's dates), so only pairs of the result are made."""
    cols = [c for c in FE.MARKET_COLS if c != "zip_code"]
    after = F.lead("data_date").over(Window.partitionBy("zip_code").orderBy("data_date", *[c for c in cols if c != "data_date"]))
    until = _date(last + dt.timedelta(days=1))
    lo = F.col("data_date") if first is None else F.greatest("data_date", _date(first))
    held = market.withColumn("_until", F.least(F.coalesce(after, until), until))
    return held.select("zip_code", F.explode(runs_between(lo, F.col("_until"))).alias("run_date"), *cols)


def prediction_history(dom, first: dt.date | None = None, last: dt.date | None = None,
                       days: int = RENEWAL_WINDOW_DAYS, newest_only: bool = False) -> DataFrame:
    """One row per (lease, run) for leases inside the run's renewal window, runs from ``first`` (default: no bound)
    to ``last`` (default: as_of); ``newest_only``: the newest such run of each lease alone."""
    last = last or dom.as_of
    return dom._memo(("history", first, last, days, newest_only), lambda: _prediction_history(dom, first, last, days, newest_only))


def _prediction_history(dom, first, last, days: int, newest_only: bool) -> DataFrame:
    end, rd = F.col("end_date"), F.col("run_date")
    lo = F.date_sub(end, days) if first is None else F.greatest(F.date_sub(end, days), _date(first))
    hi = F.least(end, _date(last + dt.timedelta(days=1)))
    leases = dom.leases_ending(first, last + dt.timedelta(days=days))
    if newest_only:
        leases = leases.withColumn("run_date", last_run_before(hi)).filter(rd >= lo)
    else:
        leases = leases.select("*", F.explode(runs_between(lo, hi)).alias("run_date"))
    t = dom.tenants().select(*FE.TENANT_COLS)
    p = dom.properties().select(*FE.PROPERTY_COLS)
    m = market_for_runs(dom.market_data(), first, last)
    ctx = (leases.join(t, "tenant_id", "left")
           .join(p, "property_id", "left")
           .join(m, ["zip_code", "run_date"], "left")
           .withColumns({"property_age": F.year(rd) - F.col("year_built"),
                         "tenure_days": F.datediff(rd, F.col("start_date")),
                         "days_to_expiration": F.datediff(end, rd)}))
    scored = S.with_rule_risk(ctx)
    return scored.withColumns({
        "prediction_date": rd,
        "predicted_at": rd.cast("timestamp"),
        "prediction_key": F.xxhash64("lease_id", "run_date"),
        "model_version": F.lit(MODEL_VERSION),
    })


PRED_COLS = ["prediction_key", "lease_id", "tenant_id", "property_id", "prediction_date",
             "predicted_at", "risk_score", "churn_probability", "risk_level", "predicted_churn",
             "confidence", "model_version"]


def latest_predictions(history: DataFrame) -> DataFrame:
    """Latest prediction per lease by (predicted_at, prediction_key)."""
    cols = [c for c in PRED_COLS if c != "lease_id"]
    return (history.groupBy("lease_id")
            .agg(F.max_by(F.struct(*cols), F.struct("predicted_at", "prediction_key")).alias("p"))
            .select("lease_id", "p.*"))


def latest_of(dom) -> DataFrame:
    """The latest prediction of each lease that a run has scored: its newest run alone is scored."""
    return prediction_history(dom, newest_only=True).select("lease_id", *[c for c in PRED_COLS if c != "lease_id"])


def leases_with_prediction(dom, history: DataFrame | None = None) -> DataFrame:
    """Every lease with its latest prediction columns (null if never scored)."""
    latest = latest_predictions(history) if history is not None else latest_of(dom)
    lp = latest.drop("tenant_id", "property_id")
    return dom.leases().join(lp, "lease_id", "left")


def unpredicted_active(dom, history: DataFrame | None = None) -> DataFrame:
    """Active leases without any prediction (anti join)."""
    history = history if history is not None else prediction_history(dom, newest_only=True)
    return (dom.leases().filter(F.col("status") == "active")
            .join(history.select("lease_id"), "lease_id", "left_anti"))


