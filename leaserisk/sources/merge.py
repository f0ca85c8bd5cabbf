"""Keyed upsert into a stored table (R2) and incremental document sync.

The table lies in hash buckets of its key.  A batch rewrites only the buckets
that its keys fall into (dynamic partition overwrite); all others keep their files.
Of the rows of a key the greatest (version, all other columns) stays, a total order,
so batches may come twice, late, or in any order and give the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaserisk.sources.io import path_exists

BUCKETS = 64


def newest(rows: DataFrame, key: str | list[str], version: str | None) -> DataFrame:
    """One row per key: the greatest by version (null first), then by all other columns in order.

    Version and other columns are all that the key leaves, so their maximum is the row, and each row is sorted and
    shuffled once, by plain key columns."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*[version] if version in others else [], *[c for c in others if c != version])
    picked = rows.groupBy(*keys).agg(F.max(order).alias("_r")) if others else rows.select(*keys).distinct()
    return picked.select(*keys, *[F.col("_r").getField(c).alias(c) for c in others])


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def merge(path: str, updates: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> list[int]:
    """Merge ``updates`` into the table at ``path`` (made if absent); returns the buckets written.

    The rows read are those of the touched buckets only, at most ``buckets`` numbers reach the driver.
    """
    spark = updates.sparkSession
    keyed = updates.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in keyed.select("_bucket").distinct().collect())
    if not touched:
        return []
    rows = keyed
    if path_exists(spark, path):
        rows = rows.unionByName(spark.read.schema(keyed.schema).parquet(path).filter(F.col("_bucket").isin(touched)))
    kept = newest(rows, key, version)
    (kept.repartition(len(touched), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket").parquet(path))
    return touched


def high_water_mark(spark: SparkSession, path: str):
    """The greatest version merged by ``sync`` so far; None before the first."""
    if not path_exists(spark, f"{path}_mark"):
        return None
    return spark.read.parquet(f"{path}_mark").agg(F.max("mark")).first()[0]


def sync(path: str, docs: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> list[int]:
    """Merge the documents changed since the last sync.

    Read from the source are documents at or after the stored mark (those at the mark again, as others may have come with the same
    version since).  The mark is written after the merge, so a sync that broke off is repeated whole.
    """
    spark = docs.sparkSession
    mark = high_water_mark(spark, path)
    changed = docs if mark is None else docs.filter(F.col(version) >= F.lit(mark))
    touched = merge(path, changed, key, version, buckets)
    if touched:
        changed.agg(F.max(version).alias("mark")).coalesce(1).write.mode("append").parquet(f"{path}_mark")
    return touched
