"""Source / sink queries (S1-S13, D11): each writes derived data under the
shared checkpoint folder and reads it back through the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaserisk.functions import scalars as X
from leaserisk.operators import predictions as PR
from leaserisk.operators import semantic as SM
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.warehouse import _TRAIN_SQL, training_view
from leaserisk.session import scratch_path
from leaserisk.sources import io as IO
from leaserisk.sources.driver import domain


def s01(spark, sf):
    rows = training_view(spark, sf).filter("training_set").select("lease_id", "prediction_date", "churned")
    path = scratch_path(spark, "s01_training_csv")
    IO.write_csv(rows, path)
    return IO.read_csv(spark, path, "lease_id long, prediction_date date, churned int")


register("s01_csv_roundtrip", q(_TRAIN_SQL + """
SELECT lease_id, CAST(prediction_date AS VARCHAR) AS prediction_date, churned FROM tv WHERE training_set
"""))(s01)

register("s02_source_reader", q("""
SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 100
"""))(lambda spark, sf: IO.read_source(spark, "parquet", f"{sf}/events.parquet",
                                       where="event_type = 'purchase' AND value >= 100")
      .select("event_id", "user_id", "value"))


def s03(spark, sf):
    dom = domain(spark, sf)
    latest = PR.latest_of(dom)
    docs = SM.lease_documents(dom.leases().select("lease_id", "tenant_id", "property_id", "end_date"),
                              dom.tenants().select("tenant_id", "full_name", "email"),
                              dom.properties().select("property_id", "address", "zip_code"), latest)
    path = scratch_path(spark, "s03_lease_docs")
    docs.write.mode("overwrite").json(path)
    back = IO.read_source(spark, "json", path, schema=docs.schema)
    return back.select("lease_id", F.col("tenant.full_name").alias("tenant_full_name"),
                       F.col("property.address").alias("property_address"),
                       F.col("churnPrediction.riskLevel").alias("risk_level"), "end_date")


register("s03_json_documents", q("""
SELECT l.lease_id, t.full_name AS tenant_full_name, p.address AS property_address, l.risk_level,
       CAST(l.end_date AS VARCHAR) AS end_date
FROM d_lease_pred l LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id
LEFT JOIN d_property p ON p.property_id = l.property_id
"""))(s03)

_RAW_TYPES = {"c_custkey": "bigint", "c_acctbal": "decimal(12,2)", "c_nationkey": "int"}


def _text_rows(spark, sf, table):
    c = domain(spark, sf).raw(table)
    return c.select(*[F.col(x).cast("string").alias(x) for x in c.columns])


def s05(spark, sf):
    return IO.ingest_raw(_text_rows(spark, sf, "customer"), _RAW_TYPES, "property-system")


register("s05_raw_ingest", q("""
SELECT c_custkey, c_name, CAST(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(12, 2)) AS DOUBLE) AS c_acctbal,
       c_nationkey, c_mktsegment, '1999-01-01 00:00:00.000000' AS ingested_at, 'property-system' AS source_system
FROM customer
"""))(s05)

# Six entities as text: (table, id column, typed columns); each has one column whose text isn't of its type.
_ENTITIES = [
    ("customer", {"c_custkey": "bigint", "c_nationkey": "int", "c_mktsegment": "int"}),
    ("part", {"p_partkey": "bigint", "p_size": "int", "p_brand": "int"}),
    ("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "int"}),
    ("lineitem", {"l_orderkey": "bigint", "l_linenumber": "int", "l_returnflag": "int"}),
    ("events", {"event_id": "bigint", "user_id": "bigint", "event_type": "int"}),
    ("supplier", {"s_suppkey": "bigint", "s_nationkey": "int", "s_name": "int"}),
]


def s05_entities(spark, sf):
    """Per entity and typed column: rows ingested and values that no cast could take."""
    out = None
    for table, types in _ENTITIES:
        raw = IO.ingest_raw(_text_rows(spark, sf, table), types, "property-system")
        n = raw.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in types])
        pairs = ", ".join(f"'{c}', `{c}`" for c in types)
        n = n.select(F.lit(table).alias("entity"), "rows", F.expr(f"stack({len(types)}, {pairs}) AS (column_name, nulls)"))
        out = n if out is None else out.unionByName(n)
    return out


register("s05_raw_ingest_entities", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS entity, count(*) AS rows, '{c}' AS column_name, "
    f"count(*) - count(TRY_CAST(CAST({c} AS VARCHAR) AS {k})) AS nulls FROM {t}" for t, cs in _ENTITIES for c, k in cs.items()))(
    s05_entities)


def s04_entities(spark, sf):
    """The five entity tables written as CSV with header and read back."""
    dom = domain(spark, sf)
    tables = {"tenants": (dom.tenants(), "tenant_id"), "properties": (dom.properties(), "property_id"),
              "leases": (dom.leases(), "lease_id"), "payments": (dom.payments(), "lease_id"),
              "maintenance": (dom.maintenance(), "request_id")}
    out = None
    for name, (df, key) in tables.items():
        path = scratch_path(spark, f"s04_{name}")
        IO.write_csv(df, path)
        back = IO.read_csv(spark, path, df.schema)
        n = back.agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("rows"), F.sum(key).alias("key_sum"))
        out = n if out is None else out.unionByName(n)
    return out


register("s04_entity_csv", q("""
SELECT 'tenants' AS entity, count(*) AS rows, CAST(sum(tenant_id) AS BIGINT) AS key_sum FROM d_tenant
UNION ALL SELECT 'properties', count(*), CAST(sum(property_id) AS BIGINT) FROM d_property
UNION ALL SELECT 'leases', count(*), CAST(sum(lease_id) AS BIGINT) FROM d_lease
UNION ALL SELECT 'payments', count(*), CAST(sum(lease_id) AS BIGINT) FROM d_payment
UNION ALL SELECT 'maintenance', count(*), CAST(sum(request_id) AS BIGINT) FROM d_maint
"""))(s04_entities)

# -- S6 / S12 --------------------------------------------------------------------------
_LI_KEY = ["l_orderkey", "l_linenumber"]
_LI_RULES = [("discount_cap", "l_discount <= 0.08"), ("positive_price", "l_extendedprice > 0")]


def _staged(spark, sf):
    li = domain(spark, sf).raw("lineitem")
    raw = IO.ingest_raw(li, {}, "payment-system")
    return IO.stage(raw, _LI_KEY, "l_shipdate", _LI_RULES, trim_lower=["l_returnflag"])


def _stage_sql():
    cols = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate"]
    others = [c for c in cols if c != "l_shipdate"]
    order = ", ".join(["l_shipdate DESC"] + [f"{c} DESC" for c in others])
    return f"""
, st AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                lower(trim(l_returnflag)) AS l_returnflag, l_linestatus, l_shipdate
         FROM lineitem
         QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1),
tagged AS (SELECT *, CASE WHEN coalesce(l_discount <= 0.08, false) AND coalesce(l_extendedprice > 0, false)
                          THEN 'valid' ELSE 'quarantine' END AS status FROM st)
"""


def s06(spark, sf):
    return _staged(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


register("s06_staging", q(_stage_sql() + "SELECT status, count(*) AS rows FROM tagged GROUP BY 1"))(s06)


def s12(spark, sf):
    valid = _staged(spark, sf).filter("status = 'valid'")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (valid.groupBy(F.col("l_orderkey").alias("lease_id"), F.trunc(F.to_date("l_shipdate"), "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("payments"), (F.sum(cents) / 100.0).alias("total_amount"),
                 F.count_if(F.col("l_returnflag") == "r").alias("returned")))


register("s12_layered_pipeline", q(_stage_sql() + """
SELECT l_orderkey AS lease_id, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month,
       count(*) AS payments, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_amount,
       count(*) FILTER (WHERE l_returnflag = 'r') AS returned
FROM tagged WHERE status = 'valid' GROUP BY 1, 2
"""))(s12)


# -- S9 / D11 ----------------------------------------------------------------------------
def s09(spark, sf):
    h = PR.prediction_history(domain(spark, sf)).select(
        "lease_id", X.date_key(F.col("prediction_date")).alias("prediction_date_key"), "risk_score", "risk_level")
    path = scratch_path(spark, "s09_fact")
    IO.append_fact(h, path, "prediction_date_key", "risk_level")
    return spark.read.parquet(path).select("lease_id", "prediction_date_key", "risk_score", "risk_level", "month_key")


register("s09_append_fact", q("""
SELECT lease_id, CAST(strftime(prediction_date, '%Y%m%d') AS INTEGER) AS prediction_date_key, risk_score, risk_level,
       CAST(strftime(prediction_date, '%Y%m') AS INTEGER) AS month_key
FROM d_hist
"""))(s09)


# -- S10 ---------------------------------------------------------------------------------------
def s10(spark, sf):
    """The leases written to and read from the full URI (scheme and authority) of a folder in the shared one, whatever
    file system that is, appended in two halves as a stage is filled."""
    place = IO.qualified(spark, scratch_path(spark, "s10_stage"))
    rows = domain(spark, sf).leases().select("lease_id", "tenant_id", "property_id", "status", "monthly_rent")
    odd = F.col("lease_id") % 2 == 1
    for half in (rows.filter(~odd), rows.filter(odd)):
        half.write.mode("append").parquet(place)
    return IO.read_source(spark, "parquet", place, rows.schema)


register("s10_object_store_paths", q("""
SELECT lease_id, tenant_id, property_id, status, monthly_rent FROM d_lease
"""))(s10)


def d11(spark, sf):
    h = PR.prediction_history(domain(spark, sf)).select(
        "lease_id", X.date_key(F.col("prediction_date")).alias("prediction_date_key"), "risk_level", "risk_score")
    path = scratch_path(spark, "d11_layout")
    IO.append_fact(h, path, "prediction_date_key", "risk_level")
    return (spark.read.parquet(path).withColumn("_file", F.input_file_name()).groupBy("month_key")
            .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("_file").alias("files"),
                 F.min("prediction_date_key").alias("first_key"), F.max("prediction_date_key").alias("last_key")))


register("d11_fact_layout", q("""
, f AS (SELECT CAST(strftime(prediction_date, '%Y%m%d') AS INTEGER) AS k FROM d_hist)
SELECT CAST(k // 100 AS INTEGER) AS month_key, count(*) AS rows, CAST(ceil(count(*) / 5000000) AS BIGINT) AS files,
       min(k) AS first_key, max(k) AS last_key
FROM f GROUP BY 1
"""))(d11)


# -- S11 / S13 ---------------------------------------------------------------------------------
def s11(spark, sf):
    dom = domain(spark, sf)
    hist = F.when(F.col("renewal_status") == "renewed",
                  F.array(F.struct(F.col("end_date").alias("effectiveDate"),
                                   F.col("monthly_rent").alias("previousRent")))) \
        .otherwise(F.array().cast("array<struct<effectiveDate:date,previousRent:double>>"))
    docs = (dom.leases().select("lease_id", "tenant_id", F.col("start_date").alias("updated_at"),
                                hist.alias("rent_history"))
            .join(dom.tenants().select("tenant_id", F.struct("full_name", "email").alias("tenant")), "tenant_id",
                  "left"))
    return IO.sync_documents(docs, "updated_at", "1998-06-01", "rent_history", "lease_id").select(
        "lease_id", "tenant_full_name", "updated_at", "effectiveDate", "previousRent")


register("s11_document_sync", q("""
SELECT l.lease_id, t.full_name AS tenant_full_name, CAST(l.start_date AS VARCHAR) AS updated_at,
       CAST(CASE WHEN l.renewal_status = 'renewed' THEN l.end_date END AS VARCHAR) AS "effectiveDate",
       CASE WHEN l.renewal_status = 'renewed' THEN l.monthly_rent END AS "previousRent"
FROM d_lease l LEFT JOIN d_tenant t ON t.tenant_id = l.tenant_id
WHERE l.start_date > DATE '1998-06-01'
"""))(s11)


def s13(spark, sf):
    dom = domain(spark, sf)
    obs = dom.leases().select("property_id", "start_date", "rent_cents").join(
        dom.properties().select("property_id", "zip_code"), "property_id")
    f = IO.market_feed(obs, "zip_code", "start_date", "rent_cents")  # integer cents: exact mean
    return f.select("zip_code", "month", "observations", (F.col("avg_value") / 100).alias("avg_value"),
                    (F.col("median_value") / 100).alias("median_value"))


register("s13_market_feed", q("""
SELECT p.zip_code, CAST(CAST(date_trunc('month', l.start_date) AS DATE) AS VARCHAR) AS month,
       count(*) AS observations, round(avg(l.rent_cents), 4) / 100 AS avg_value,
       quantile_disc(l.rent_cents, 0.5) / 100 AS median_value
FROM d_lease l JOIN d_property p ON p.property_id = l.property_id GROUP BY 1, 2
"""))(s13)


def s02_training(spark, sf):
    """The training table written as a warehouse table, read back with the
    ``training_set`` predicate pushed into the scan."""
    tv = training_view(spark, sf).select("lease_id", "prediction_date", "churned", "training_set")
    path = scratch_path(spark, "s02_training_table")
    tv.write.mode("overwrite").parquet(path)
    return IO.read_source(spark, "parquet", path, where="training_set").select("lease_id", "prediction_date",
                                                                                "churned")


register("s02_training_set_read", q(_TRAIN_SQL + """
SELECT lease_id, CAST(prediction_date AS VARCHAR) AS prediction_date, churned FROM tv WHERE training_set
"""))(s02_training)
