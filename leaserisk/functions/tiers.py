"""F8: integer-style tier buckets generated from an edge list.

Labels: "Below a", "a to b-1", ..., "z or Above", and "Undefined" for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels(edges) -> list[str]:
    out = [f"Below {edges[0]}"]
    out += [f"{a} to {b - 1}" for a, b in zip(edges, edges[1:])]
    out.append(f"{edges[-1]} or Above")
    return out


def tier(c: Column, edges) -> Column:
    names = labels(edges)
    expr = F.when(c.isNull(), F.lit("Undefined"))
    for edge, name in zip(edges, names):
        expr = expr.when(c < edge, F.lit(name))
    return expr.otherwise(F.lit(names[-1]))


def tier_sql(col: str, edges) -> str:
    names = labels(edges)
    parts = [f"WHEN {col} IS NULL THEN 'Undefined'"]
    parts += [f"WHEN {col} < {e} THEN '{n}'" for e, n in zip(edges, names)]
    return "CASE " + " ".join(parts) + f" ELSE '{names[-1]}' END"
