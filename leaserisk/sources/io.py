"""Readers, writers and the RAW -> STAGING -> ANALYTICS layers.

All paths are plain URIs (local, HDFS or an object store, S10); scratch
tables are written under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaserisk.config import AS_OF


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the path's own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI of a path; one without a scheme belongs to the cluster's default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


# -- S1 / S2 / S3 / S4 ----------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header."""
    df.write.mode(mode).option("header", True).csv(path)


def read_source(spark: SparkSession, fmt: str, path: str | None = None, schema=None,
                options: dict | None = None, where: str | None = None) -> DataFrame:
    """Any DataSource by format name (parquet, json, csv, orc, jdbc...);
    ``where`` is a SQL predicate applied lazily (pushed into the scan when the
    source supports it)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    df = r.load(path) if path is not None else r.load()
    return df.filter(where) if where else df


# -- S5: RAW ingestion -------------------------------------------------------------------
def ingest_raw(df: DataFrame, types: dict, source_system: str, ingested_at=None) -> DataFrame:
    """Cast to declared types with ``try_cast`` (bad values become null and are
    caught by validation), add ``ingested_at`` and ``source_system``."""
    cols = []
    for f in df.columns:
        c = F.col(f)
        if f in types:
            c = c.try_cast(types[f])
        cols.append(c.alias(f))
    ts = F.lit(str(ingested_at or AS_OF)).cast("timestamp")
    return df.select(*cols, ts.alias("ingested_at"), F.lit(source_system).alias("source_system"))


# -- S6: STAGING ---------------------------------------------------------------------------
def stage(df: DataFrame, key, version: str, rules, trim_lower=()) -> DataFrame:
    """Latest row per key (greatest version, then greatest row), text columns trimmed and lower-cased, each row with the
    names of the rules it breaks (``broken``) and its ``status``, valid or quarantine."""
    from leaserisk.sources.layers import tagged
    from leaserisk.sources.merge import newest
    keys = [key] if isinstance(key, str) else list(key)
    latest = newest(df, keys, version).select(*df.columns)
    return tagged(latest.withColumns({c: F.lower(F.trim(F.col(c))) for c in trim_lower}), rules)


# -- S9 / D11: partitioned fact append ----------------------------------------------------------
def append_fact(df: DataFrame, path: str, date_key: str, cluster_col: str | None = None,
                rows_per_file: int = 5_000_000) -> None:
    """Append to a fact table partitioned by a month key.  Each month is
    spread (by a hash of the row) over as many tasks as it has
    ``rows_per_file``, so a large month is never a single task and a small one
    a single file; rows are clustered by (date key, cluster column) inside each
    file for min/max pruning."""
    rows = df.withColumn("month_key", (F.col(date_key) / 100).cast("int"))
    files = rows.groupBy("month_key").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("long").alias("_files"))
    out = (rows.join(files, "month_key")
           .withColumn("_file", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_files")))
           .repartition("month_key", "_file"))
    if cluster_col:
        out = out.sortWithinPartitions(date_key, cluster_col)
    (out.select(*df.columns, "month_key").write.mode("append").option("maxRecordsPerFile", rows_per_file)
     .partitionBy("month_key").parquet(path))


# -- S11: document -> warehouse incremental sync --------------------------------------------------
def sync_documents(docs: DataFrame, updated_col: str, since, array_col: str, key: str) -> DataFrame:
    """Changed documents only (``updated > since``), nested structs flattened
    and the array exploded (``explode_outer`` keeps documents with none)."""
    since = F.lit(str(since)).cast(docs.schema[updated_col].dataType)
    return flatten_documents(docs.filter(F.col(updated_col) > since), array_col)


def flatten_documents(docs: DataFrame, array_col: str) -> DataFrame:
    """Struct fields as columns ``struct_field``, one row per item of the array; documents without items keep one row."""
    flat = []
    for f in docs.schema.fields:
        if isinstance(f.dataType, T.StructType):
            flat += [F.col(f"{f.name}.{s.name}").alias(f"{f.name}_{s.name}") for s in f.dataType.fields]
        elif f.name != array_col:
            flat.append(F.col(f.name))
    return docs.select(*flat, F.explode_outer(array_col).alias("item")).select("*", "item.*").drop("item")


# -- S13: market feed -------------------------------------------------------------------------------
def market_feed(observations: DataFrame, zip_col: str, date_col: str, value_col: str,
                accuracy: int = 10_000) -> DataFrame:
    """Per zip and month: count, mean and (lower) median of the observed value.
    One bounded quantile sketch per group (exact for small groups)."""
    return (observations.groupBy(F.col(zip_col).alias("zip_code"),
                                 F.trunc(date_col, "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("observations"),
                 F.round(F.avg(value_col), 4).alias("avg_value"),
                 F.percentile_approx(value_col, 0.5, accuracy).alias("median_value")))
