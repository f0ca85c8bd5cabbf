"""Layered ingestion of the six entities (S6, S12) and the document upsert.

Two batches are landed: one with every row, one that sends every second row again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from leaserisk.operators import warehouse as WH
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.session import scratch_path
from leaserisk.sources import io as IO
from leaserisk.sources import merge as MG
from leaserisk.sources.driver import cents, domain
from leaserisk.sources.layers import Entity, Layers

# entity -> (key columns, rules, text columns to normalise, rows in SQL, number to choose the second batch by)
_SPECS = {
    "tenants": (("tenant_id",), (("email_has_at", "email LIKE '%@%'"), ("income_at_least_50000", "annual_income >= 50000"),
                                 ("household_at_most_4", "household_size <= 4")), ("primary_payment_method",), "d_tenant", "tenant_id"),
    "properties": (("property_id",), (("condition_at_least_2", "condition_rating >= 2"), ("built_after_1955", "year_built > 1955")),
                   ("property_type",), "d_property", "property_id"),
    "leases": (("lease_id",), (("has_property", "property_id IS NOT NULL"), ("ends_after_start", "end_date > start_date"),
                               ("rent_at_most_2500", "monthly_rent <= 2500")), ("status",), "d_lease", "lease_id"),
    "payments": (("payment_id",), (("late_at_most_10_days", "days_late <= 10"), ("amount_positive", "amount > 0")), ("status",),
                 "s_payment", "payment_id"),
    "maintenance": (("request_id",), (("cost_known", "cost IS NOT NULL"), ("cost_under_150", "cost < 150")), ("priority",),
                    "d_maint", "request_id"),
    "market": (("zip_code", "data_date"), (("vacancy_at_most_9", "vacancy_pct <= 9"), ("rent_positive", "market_rent_median > 0")), (),
               "d_market", "vacancy_pct"),
}


def _payments(dom):
    li = dom.raw("lineitem")
    paid = F.floor((cents(F.col("l_extendedprice")) * (100 - F.round(F.col("l_discount") * 100).cast("long")) + 50) / 100).cast("long")
    late = F.when(F.col("l_returnflag") == "R", 1 + F.col("l_suppkey") % 15).otherwise(0).cast("int")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("payment_id"), F.col("l_orderkey").alias("lease_id"),
                     F.to_date("l_shipdate").alias("payment_date"), (paid / 100.0).alias("amount"), late.alias("days_late"),
                     F.when(late > 5, 50.0).otherwise(0.0).alias("late_fee"), F.lit("paid").alias("status"))


def _layers(spark, sf):
    """All six entities landed and staged in both batches, the second batch twice."""
    def build():
        dom = domain(spark, sf)
        rows = {"tenants": dom.tenants(), "properties": dom.properties(), "leases": dom.leases(), "payments": _payments(dom),
                "maintenance": dom.maintenance(), "market": dom.market_data()}
        layers = Layers(spark, scratch_path(spark, "layers"))
        entities = {name: Entity(name, key, rows[name].schema, rules, lower) for name, (key, rules, lower, _, _) in _SPECS.items()}

        def fill(name):
            half = _SPECS[name][-1]
            for batch, part in (("1998-12-01", rows[name]), ("1999-01-01", rows[name].filter(F.col(half) % 2 == 0)),
                                ("1999-01-01", rows[name])):
                layers.land(entities[name], batch, part, "property-system")
                layers.stage(entities[name], batch)

        # Entities do not wait for one another: each one's jobs are few and mostly small.
        with ThreadPoolExecutor(len(entities)) as pool:
            list(pool.map(fill, entities))
        return layers, entities
    return domain(spark, sf)._memo("layers", build)


_PAY_SQL = """
, s_payment AS (
  SELECT l_orderkey * 10 + l_linenumber AS payment_id, l_orderkey AS lease_id, CAST(l_shipdate AS DATE) AS payment_date,
         CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) + 50) // 100
              AS DOUBLE) / 100 AS amount,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 + l_suppkey % 15 ELSE 0 END AS INTEGER) AS days_late
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY payment_date DESC, amount DESC, days_late DESC) = 1)
"""


def _good(name):
    return " AND ".join(f"coalesce({p}, false)" for _, p in _SPECS[name][1])


def s06_entities(spark, sf):
    """Per entity: rows staged in both batches, valid ones, and quarantined ones by broken rule."""
    layers, entities = _layers(spark, sf)
    out = None
    for name, e in entities.items():
        both = layers.staged(e).withColumn("ok", F.lit(1)).unionByName(layers.staged(e, "quarantine").withColumn("ok", F.lit(0)))
        tag = F.when(F.col("ok") == 1, F.array(F.lit("valid"))).otherwise(F.array_append("broken", F.lit("quarantine")))
        n = both.select(F.explode(tag).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("entity"), "rule", "rows")
        out = n if out is None else out.unionByName(n)
    return out


def _s06_sql():
    parts = []
    for name, (_, rules, _, table, half) in _SPECS.items():
        twice = f"(SELECT * FROM {table} UNION ALL SELECT * FROM {table} WHERE {half} % 2 = 0)"
        for rule, p in (*((r, f"NOT coalesce({p}, false)") for r, p in rules), ("valid", _good(name)), ("quarantine", f"NOT ({_good(name)})")):
            parts.append(f"SELECT '{name}' AS entity, '{rule}' AS rule, count(*) AS rows FROM {twice} WHERE {p} HAVING count(*) > 0")
    return q(_PAY_SQL + "\nUNION ALL\n".join(parts))


register("s06_staging_entities", _s06_sql())(s06_entities)


def s12_analytics(spark, sf):
    """Tenant dimension (D3), property dimension (D4) and payment behaviour (D6) from the staged layers' valid rows."""
    layers, e = _layers(spark, sf)
    current = {name: layers.current(e[name]) for name in ("tenants", "properties", "leases", "payments")}
    tables = [("tenant_dim", WH.tenant_dim(current["tenants"]), "tenant_id", "age"),
              ("property_dim", WH.property_dim(current["properties"]), "property_id", "property_age"),
              ("payment_behavior", WH.payment_behavior(current["payments"], current["leases"]), "tenant_id", "total_payments")]
    out = None
    for name, df, key, total in tables:
        n = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(key).alias("key_sum"),
                   F.sum(total).cast("long").alias("total"))
        out = n if out is None else out.unionByName(n)
    return out


register("s12_analytics_tables", q(_PAY_SQL + f"""
, vl AS (SELECT * FROM d_lease WHERE {_good('leases')}),
pb AS (SELECT lease_id, date_trunc('month', payment_date) AS month, count(*) AS n FROM s_payment WHERE {_good('payments')} GROUP BY 1, 2)
SELECT 'tenant_dim' AS table_name, count(*) AS rows, CAST(sum(tenant_id) AS BIGINT) AS key_sum,
       CAST(sum(1999 - year(date_of_birth) - CASE WHEN 101 < month(date_of_birth) * 100 + day(date_of_birth) THEN 1 ELSE 0 END)
            AS BIGINT) AS total FROM d_tenant WHERE {_good('tenants')}
UNION ALL SELECT 'property_dim', count(*), CAST(sum(property_id) AS BIGINT), CAST(sum(1999 - year_built) AS BIGINT)
FROM d_property WHERE {_good('properties')}
UNION ALL SELECT 'payment_behavior', count(*), CAST(sum(vl.tenant_id) AS BIGINT), CAST(sum(pb.n) AS BIGINT)
FROM pb LEFT JOIN vl ON vl.lease_id = pb.lease_id
"""))(s12_analytics)


def s11_upsert(spark, sf):
    """S11 with R2: lease documents as JSON, a first sync of the older ones and a second one of all; then the merged
    table flattened."""
    dom = domain(spark, sf)
    entry = F.struct(F.col("end_date").alias("effectiveDate"), F.col("monthly_rent").alias("previousRent"))
    none = F.array().cast("array<struct<effectiveDate:date,previousRent:double>>")
    docs = (dom.leases().select("lease_id", "tenant_id", F.col("start_date").alias("updated_at"), F.struct("monthly_rent", "status").alias("terms"),
                                F.when(F.col("renewal_status") == "renewed", F.array(entry)).otherwise(none).alias("rent_history")))
    table, source = scratch_path(spark, "s11_leases"), scratch_path(spark, "s11_documents")
    for part, rows in (("a", docs.filter("updated_at < DATE '1998-06-01'")), ("b", docs)):
        rows.write.json(f"{source}/{part}")
        MG.sync(table, IO.read_source(spark, "json", f"{source}/{part}", schema=docs.schema), "lease_id", "updated_at")
    return IO.flatten_documents(MG.read_merged(spark, table), "rent_history").select(
        "lease_id", "tenant_id", "updated_at", "terms_monthly_rent", "terms_status", "effectiveDate", "previousRent")


register("s11_document_upsert", q("""
SELECT lease_id, tenant_id, CAST(start_date AS VARCHAR) AS updated_at, monthly_rent AS terms_monthly_rent, status AS terms_status,
       CAST(CASE WHEN renewal_status = 'renewed' THEN end_date END AS VARCHAR) AS "effectiveDate",
       CASE WHEN renewal_status = 'renewed' THEN monthly_rent END AS "previousRent"
FROM d_lease
"""))(s11_upsert)
