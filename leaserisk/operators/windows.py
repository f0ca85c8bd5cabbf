"""Skew-safe ordered windows per key (lag / lead / running sums).

A window partitioned by a key sends all rows of that key to one task; with a
hot key (a third of all rows) that task holds a third of the data.  Here the
rows of a key are first cut into ordered buckets (e.g. the month of the order
column):

1. inside each (key, bucket) the usual window gives within-bucket lag, lead
   and prefix sums;
2. each (key, bucket) is summarised to one row (first / last values, totals)
   and a second window runs per key over those summaries only (one row per
   bucket, bounded by the number of buckets, not by the rows);
3. the two are joined on (key, bucket): the first row of a bucket takes the
   previous bucket's last value, the last row the next bucket's first value,
   and prefix sums add the totals of the earlier buckets.

The bucket must be monotone in the ordering (bucket of an earlier row <= the
bucket of a later row).  Results equal the plain per-key window.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one shuffle task where a query sets the number of tasks.
ROWS_PER_TASK = 1_000_000


def ordered_neighbors(df: DataFrame, key: str, bucket: Column, order: list[str],
                      prev_cols=(), next_cols=(), prior_sums: dict | None = None,
                      prior_count: str | None = None) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` (value on the previous / next row of the
    key in ``order``), ``<name>`` = sum of a column over all earlier rows of the
    key (``prior_sums``: name -> column) and ``prior_count`` = number of earlier
    rows."""
    prior_sums = dict(prior_sums or {})
    ocols = [F.col(c) for c in order]
    d = df.withColumn("_b", bucket)
    w = Window.partitionBy(key, "_b").orderBy(*ocols)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    within = {"_rn": F.row_number().over(w),
              "_rn_desc": F.row_number().over(Window.partitionBy(key, "_b").orderBy(*[c.desc() for c in ocols]))}
    for c in prev_cols:
        within[f"_wl_{c}"] = F.lag(c).over(w)
    for c in next_cols:
        within[f"_wn_{c}"] = F.lead(c).over(w)
    for name, col in prior_sums.items():
        within[f"_ws_{name}"] = F.sum(col).over(before)
    d = d.withColumns(within)

    order_struct = F.struct(*ocols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.max_by(F.col(c), order_struct).alias(f"_last_{c}") for c in prev_cols]
    aggs += [F.min_by(F.col(c), order_struct).alias(f"_first_{c}") for c in next_cols]
    aggs += [F.sum(col).alias(f"_tot_{name}") for name, col in prior_sums.items()]
    summary = df.withColumn("_b", bucket).groupBy(key, "_b").agg(*aggs)
    wb = Window.partitionBy(key).orderBy("_b")
    wb_before = wb.rowsBetween(Window.unboundedPreceding, -1)
    across = {f"_pb_{c}": F.lag(f"_last_{c}").over(wb) for c in prev_cols}
    across.update({f"_nb_{c}": F.lead(f"_first_{c}").over(wb) for c in next_cols})
    across.update({f"_off_{name}": F.sum(f"_tot_{name}").over(wb_before) for name in prior_sums})
    across["_off_n"] = F.sum("_n").over(wb_before)
    summary = summary.withColumns(across).select(key, "_b", *across.keys())

    j = d.join(summary, [key, "_b"])
    out = {}
    for c in prev_cols:
        out[f"prev_{c}"] = F.when(F.col("_rn") == 1, F.col(f"_pb_{c}")).otherwise(F.col(f"_wl_{c}"))
    for c in next_cols:
        out[f"next_{c}"] = F.when(F.col("_rn_desc") == 1, F.col(f"_nb_{c}")).otherwise(F.col(f"_wn_{c}"))
    for name in prior_sums:
        s_in, s_off = F.col(f"_ws_{name}"), F.col(f"_off_{name}")
        out[name] = F.when(s_in.isNull() & s_off.isNull(), F.lit(None)).otherwise(
            F.coalesce(s_off, F.lit(0)) + F.coalesce(s_in, F.lit(0)))
    if prior_count:
        out[prior_count] = F.coalesce(F.col("_off_n"), F.lit(0)) + F.col("_rn") - 1
    drop = [c for c in j.columns if c.startswith("_") and c not in df.columns]
    return j.withColumns(out).drop(*drop)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``parts`` tasks, before any sort or aggregate of a whole scan task; None: as it is."""
    return df.repartition(parts, *keys) if parts else df


def tasks_for(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """Shuffle tasks that ``df``'s rows ask for; None where the session's own number is as many."""
    parts = ceil(df.count() / rows_per_task)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def asof_lookup(facts: DataFrame, lookup: DataFrame, key: str, fact_time: str, lookup_time: str,
                value_cols: list[str], bucket, parts: int | None = None) -> DataFrame:
    """For every fact row, the values of the latest lookup row of the same key
    with lookup_time <= fact_time (null when there is none).

    Facts and lookup rows are merged into one stream per (key, bucket); inside
    a bucket a running ``last(..., ignorenulls)`` carries the latest lookup
    row forward, and a per-key window over per-bucket summaries carries it
    across buckets.  No fact is paired with more than its own answer, so a
    hot key costs a sort of its rows per bucket, not facts x lookups.
    ``bucket`` maps a time column to a monotone bucket value.  A bucket's summary is the
    last row of its stream: an aggregate of the values would sort every scan task whole.
    ``parts``: tasks of each shuffle (see ``tasks_for``).
    """
    vals = F.struct(*[F.col(c) for c in value_cols])
    f = facts.withColumns({"_t": F.col(fact_time), "_k": F.lit(1)})
    lk = lookup.select(F.col(key), F.col(lookup_time).alias("_t"), vals.alias("_v"), F.lit(0).alias("_k"))
    u = dealt(f.unionByName(lk, allowMissingColumns=True).withColumn("_b", bucket(F.col("_t"))), parts, key, "_b")
    own = Window.partitionBy(key, "_b").orderBy("_t", "_k")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = F.when(F.col("_t").isNotNull(), F.col("_v"))  # a lookup row without a time is not carried on
    u = u.withColumns({"_in": F.last("_v", ignorenulls=True).over(upto), "_last": F.last(timed, ignorenulls=True).over(upto),
                       "_end": F.lead("_k").over(own).isNull()})
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summ = dealt(u.filter("_end").select(key, "_b", F.col("_last").alias("_lastv")), parts, key)
    summ = summ.withColumn("_carry", F.last("_lastv", ignorenulls=True).over(wb)).select(key, "_b", "_carry")
    out = (u.filter(F.col("_k") == 1).join(summ, [key, "_b"])
           .withColumn("_r", F.coalesce(F.col("_in"), F.col("_carry"))))
    return out.select(*[F.col(f"`{c}`") for c in facts.columns],
                      *[F.col("_r").getField(c).alias(c) for c in value_cols])
