"""Scalar Column builders (F1-F21).  All are built-in expressions (codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(d) -> Column:
    return F.lit(str(d)).cast("date")


def days_between(end: Column, as_of) -> Column:
    """whole days from as_of to end."""
    return F.datediff(end, as_date(as_of))


def tenure_months(start: Column, as_of) -> Column:
    """12 * year difference + month difference; 0 when there is no start."""
    a = as_date(as_of)
    return F.when(start.isNull(), F.lit(0)).otherwise(
        (F.year(a) - F.year(start)) * 12 + F.month(a) - F.month(start))


def in_renewal_window(end: Column, as_of, days: int = 90) -> Column:
    """0 < days to end <= 90."""
    d = days_between(end, as_of)
    return (d > 0) & (d <= days)


def full_name(first: Column, last: Column) -> Column:
    """F4."""
    return F.concat_ws(" ", first, last)


def lower_email(c: Column) -> Column:
    """F5."""
    return F.lower(F.trim(c))


def date_key(d: Column) -> Column:
    """Integer yyyyMMdd key of a date."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def date_from_key(k: Column) -> Column:
    """DATE from an integer yyyyMMdd key."""
    return F.to_date(k.cast("string"), "yyyyMMdd")


def timeframe(d: Column, grain: str) -> Column:
    """date / week (Monday) / month / quarter / year bucket as DATE."""
    if grain == "date":
        return d.cast("date")
    return F.date_trunc(grain, d).cast("date")


def clip_upper(c: Column, hi) -> Column:
    """min(c, hi) that keeps null (least() alone would skip it)."""
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(c, F.lit(hi)))


def clip_lower(c: Column, lo) -> Column:
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lo)))


def inverse_one_plus(c: Column) -> Column:
    """1 / (1 + x)."""
    return 1.0 / (1.0 + c)


def rent_increase_pct(new: Column, old: Column) -> Column:
    """(new - old) / old * 100."""
    return (new - old) / F.nullif(old, F.lit(0)) * 100


def is_summer(month: Column) -> Column:
    """F15."""
    return month.isin(6, 7, 8)


def geopoint(lat: Column, lon: Column) -> Column:
    """F16."""
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / nullif(den, 0) as double."""
    return num.cast("double") / F.nullif(den, F.lit(0))


def churn_label(event_type: Column) -> Column:
    """TERMINATION / EXPIRATION -> 1, RENEWAL -> 0, else null."""
    return (F.when(event_type.isin("TERMINATION", "EXPIRATION"), F.lit(1))
            .when(event_type == "RENEWAL", F.lit(0)))


def append_struct(arr: Column, item: Column) -> Column:
    """append one struct to a (possibly null) array of structs."""
    return F.when(arr.isNull(), F.array(item)).otherwise(F.concat(arr, F.array(item)))


def property_age(year_built: Column, as_of) -> Column:
    """F21."""
    return F.year(as_date(as_of)) - year_built
