"""Permutation importance of any scored model.

A column is shuffled over a distributed table without a global order: rows are
dealt to cells by a hash of their key, and inside each cell the rows are ranked by one
hash and the column's values by another; value and row of equal rank meet.  A cell
is a random sample of some ``CELL_ROWS`` rows, so the shuffle is as good as one over the
table, and no task sorts more than a cell.  All columns go through one pass: a row
comes once per column, with that column's value replaced.  The AUC of each column's
scores comes from a histogram of ``bins`` scores (ties within a bin count one half).
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.functions.stats import with_stats
from leaserisk.operators.evaluate import grouped_auc

CELL_ROWS = 5_000
BASE = -1


def _hash(key: str, *salt) -> Column:
    return F.xxhash64(F.col(key), *[s if isinstance(s, Column) else F.lit(s) for s in salt])


def shuffled(rows: DataFrame, key: str, features: list[str], cells: int, seed: int, label: str = "label") -> DataFrame:
    """(column int, label, features array<double>): every row once as it is (column BASE) and once per feature with a value
    of another row of its cell in that feature's place."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    dealt = rows.select(F.col(key).alias("_key"), F.col(label).alias(label), values.alias("features"),
                        F.pmod(_hash(key, seed, "cell"), F.lit(cells)).alias("_cell"))
    placed = dealt.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_cell").orderBy(_hash("_key", seed, "row"), "_key")))
    single = dealt.select("_cell", "_key", F.posexplode("features").alias("column", "_value"))
    drawn = single.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_cell", "column").orderBy(_hash("_key", seed, F.col("column")), "_key"))).drop("_key")
    swapped = placed.join(drawn, ["_cell", "_rank"]).select("column", label, F.transform(
        "features", lambda x, i: F.when(i == F.col("column"), F.col("_value")).otherwise(x)).alias("features"))
    return swapped.unionByName(dealt.select(F.lit(BASE).alias("column"), label, "features"))


def permutation_importance(rows: DataFrame, key: str, features: list[str], score: Callable[[DataFrame], DataFrame],
                           seed: int = 42, bins: int = 10_000, label: str = "label", cells: int | None = None) -> DataFrame:
    """(feature, auc, permuted_auc, drop) for every feature.

    ``score`` adds a column ``score`` (0 to 1) to rows with ``features`` (array<double>).  Equal seeds give equal tables.
    Rows with a null label or key take no part; a table with one class has null AUCs.
    """
    known = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    cells = cells or max(1, ceil(known.count() / CELL_ROWS))
    scored = score(shuffled(known, key, features, cells, seed, label))
    binned = scored.withColumn("_bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    auc = grouped_auc(binned, "column", "_bin", label)
    base = auc.filter(F.col("column") == BASE).select(F.col("auc").alias("base"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("column") + 1)
    each = with_stats(auc.filter(F.col("column") != BASE), base)
    return each.select(names.alias("feature"), F.col("base").alias("auc"), F.col("auc").alias("permuted_auc"),
                       (F.col("base") - F.col("auc")).alias("drop"))
