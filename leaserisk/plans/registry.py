"""Named queries paired with their DuckDB oracle SQL.

``@register(name, sql)`` records a callable ``(spark, sf_dir) -> DataFrame``.
Results are normalised for comparison in one final projection: dates become
``yyyy-MM-dd`` strings, timestamps ``yyyy-MM-dd HH:mm:ss.SSSSSS`` strings and
decimals doubles (the oracle SQL formats the same way, see ``ds``/``ts``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from leaserisk.plans import (core, features, filters, modeling, reports, retention, scalars,  # noqa: F401
                                 semantic, ml_models, streams, sources, facts, joins,
                                 layers, warehouse)
