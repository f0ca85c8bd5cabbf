"""Predicates and list filters.

Each function returns a ``Column`` (or a filtered DataFrame), so Catalyst can
push the predicate into the parquet scan where it references scan columns.
Optional filters compose: ``None`` or ``'all'`` switches a filter off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaserisk.config import AS_OF, DATA_RETENTION_MONTHS, RENEWAL_WINDOW_DAYS


def _d(as_of) -> Column:
    return F.lit(str(as_of)).cast("date")


def _and(preds) -> Column:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def _on(v) -> bool:
    return v is not None and v != "all"


def expiring_within(as_of=AS_OF, days: int = 60, end_col: str = "end_date") -> Column:
    """Active leases with as_of <= end <= as_of + days."""
    end = F.col(end_col)
    return (F.col("status") == "active") & end.between(_d(as_of), F.date_add(_d(as_of), days))


def renewal_window(as_of=AS_OF, days: int = RENEWAL_WINDOW_DAYS, end_col: str = "end_date",
                   strict_lower: bool = True) -> Column:
    """0 < days_to_end <= 90 (strict lower bound), or P2 with 90."""
    end = F.col(end_col)
    if strict_lower:
        return (F.col("status") == "active") & (end > _d(as_of)) & (end <= F.date_add(_d(as_of), days))
    return expiring_within(as_of, days, end_col)


def risk_active(level: str) -> Column:
    """Active leases at a risk level."""
    return (F.col("status") == "active") & (F.col("risk_level") == level)


def email_is(email: str, col: str = "email") -> Column:
    """E-mail look-up, case-insensitive (stored lower-case)."""
    return F.lower(F.col(col)) == F.lower(F.lit(email))


def tenant_search(status: str | None = None, search: str | None = None) -> Column:
    """Status filter + name/e-mail contains (case-insensitive)."""
    preds = []
    if _on(status):
        preds.append(F.col("status") == status)
    if search:
        s = search.lower()
        preds.append(F.lower(F.col("full_name")).contains(s) | F.lower(F.col("email")).contains(s))
    return _and(preds)


def lease_list(as_of=AS_OF, status=None, renewal_status=None, risk_level=None,
               expiring_in_days=None) -> Column:
    """Composed optional predicates on the lease list."""
    preds = []
    if _on(status):
        preds.append(F.col("status") == status)
    if _on(renewal_status):
        preds.append(F.col("renewal_status") == renewal_status)
    if _on(risk_level):
        preds.append(F.col("risk_level") == risk_level)
    if _on(expiring_in_days):
        preds.append(F.col("end_date").between(_d(as_of), F.date_add(_d(as_of), int(expiring_in_days))))
    return _and(preds)


def property_list(city=None, zip_code=None, bedrooms=None, neighborhood=None) -> Column:
    """P10 (+ neighbourhood for P13)."""
    preds = []
    if _on(city):
        preds.append(F.col("city") == city)
    if _on(zip_code):
        preds.append(F.col("zip_code") == zip_code)
    if _on(bedrooms):
        preds.append(F.col("bedrooms") == int(bedrooms))
    if _on(neighborhood):
        preds.append(F.col("neighborhood") == neighborhood)
    return _and(preds)


def campaign_list(status=None, risk_level=None, start=None, end=None, ts_col="triggered_at") -> Column:
    """Action rows by status, risk level and time range."""
    preds = []
    if _on(status):
        preds.append(F.col("status") == status)
    if _on(risk_level):
        preds.append(F.col("risk_level") == risk_level)
    if start is not None:
        preds.append(F.col(ts_col) >= F.lit(start).cast("timestamp"))
    if end is not None:
        preds.append(F.col(ts_col) <= F.lit(end).cast("timestamp"))
    return _and(preds)


def retention_cutoff(ts_col: str, as_of=AS_OF, months: int = DATA_RETENTION_MONTHS) -> Column:
    """Keep rows newer than as_of - 7 years."""
    return F.col(ts_col) >= F.add_months(_d(as_of), -months)


def split_target(df: DataFrame, target: str, ids=("tenant_id", "lease_id", "property_id")):
    """(features, label) with id columns dropped; error if the target is absent."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in data")
    return df.drop(*ids, target), df.select(target)


def mask_columns(df: DataFrame, cols, allowed: bool, mode: str = "hash") -> DataFrame:
    """Role-based masking; not allowed -> sha2 (or null)."""
    if allowed:
        return df
    out = []
    for f in df.columns:
        if f in cols:
            m = F.sha2(F.col(f).cast("string"), 256) if mode == "hash" else F.lit(None).cast("string")
            out.append(m.alias(f))
        else:
            out.append(F.col(f))
    return df.select(*out)
