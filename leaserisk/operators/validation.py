"""Constraint validation (P12) and null-only defaults for scoring rows.

Rules are SQL predicate strings, so the same rule text runs in Spark
(``F.expr``) and in any SQL engine.  All rules of a table are counted in a
single aggregation pass; uniqueness is one ``groupBy(key)`` per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Allowed values and bounds of the lease and tenant documents.
# ---------------------------------------------------------------------------
LEASE_RULES = [
    ("status_allowed", "status IN ('active', 'expired', 'terminated', 'renewed')"),
    ("renewal_status_allowed",
     "renewal_status IN ('active', 'pending-renewal', 'renewed', 'not-renewed', 'expired')"),
    ("rent_positive", "monthly_rent > 0"),
    ("term_bounds", "lease_term_months BETWEEN 1 AND 60"),
    ("start_required", "start_date IS NOT NULL"),
    ("end_after_start", "end_date > start_date"),
    ("property_required", "property_id IS NOT NULL"),
]
TENANT_RULES = [
    ("email_required", "email IS NOT NULL"),
    ("employment_allowed",
     "employment_status IN ('employed', 'self-employed', 'unemployed', 'retired', 'student')"),
    ("payment_method_allowed",
     "primary_payment_method IN ('ach', 'credit-card', 'debit-card', 'check', 'cash')"),
    ("household_bounds", "household_size BETWEEN 1 AND 20"),
    ("income_non_negative", "annual_income >= 0"),
    ("complaints_non_negative", "complaint_count >= 0"),
]


def validate(df: DataFrame, rules, unique=(), entity: str | None = None) -> DataFrame:
    """One row per rule: (rule, violations).  A null predicate counts as a violation."""
    agg = df.agg(*[F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(f"r{i}")
                   for i, (_, p) in enumerate(rules)])
    stack = "stack({n}, {items}) AS (rule, violations)".format(
        n=len(rules), items=", ".join(f"'{name}', r{i}" for i, (name, _) in enumerate(rules)))
    out = [agg.selectExpr(stack)]
    for key in unique:
        dup = (df.groupBy(key).count().filter(F.col("count") > 1)
               .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("violations"))
               .select(F.lit(f"unique_{key}").alias("rule"), "violations"))
        out.append(dup)
    res = reduce(DataFrame.unionByName, out)
    return res.select("rule", F.col("violations").cast("long").alias("violations"))


def rules_sql(table: str, rules, unique=()) -> str:
    parts = [f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT coalesce({p}, false)) AS violations "
             f"FROM {table}" for name, p in rules]
    parts += [f"SELECT 'unique_{k}' AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations FROM "
              f"(SELECT count(*) AS n FROM {table} GROUP BY {k} HAVING count(*) > 1)" for k in unique]
    return "\nUNION ALL\n".join(parts)


def with_defaults(df: DataFrame, defaults, keys=(), js_falsy: bool = False) -> DataFrame:
    """Fill each field with its default when null (or absent from the frame).

    ``js_falsy=True`` replicates ``value || default``: 0, false and '' are
    replaced as well (Q16).
    """
    cols = [F.col(k) for k in keys if k in df.columns]
    for name, default in defaults:
        if name not in df.columns:
            cols.append(F.lit(default).alias(name))
            continue
        c = F.col(name)
        if js_falsy:
            falsy = c.isNull() | (c.cast("string").isin("0", "0.0", "false", ""))
            cols.append(F.when(falsy, F.lit(default)).otherwise(c).alias(name))
        else:
            cols.append(F.coalesce(c, F.lit(default)).alias(name))
    return df.select(*cols)
