"""Preparation and evaluation queries with oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leaserisk.config import SCORE_TIERS
from leaserisk.functions import tiers as TI
from leaserisk.operators import evaluate as EV
from leaserisk.functions.stats import with_stats
from leaserisk.operators import features as FE
from leaserisk.operators import filters as P
from leaserisk.operators import predictions as PR
from leaserisk.operators import prep as PP
from leaserisk.operators.ml import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from leaserisk.plans.features import GROUP_SQL, _AGG_CTES, _rounded
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.warehouse import _TRAIN_SQL, training_view
from leaserisk.sources.driver import domain


def _matrix(spark, sf):
    return _rounded(FE.feature_matrix(FE.feature_input(domain(spark, sf))))


def _train(spark, sf):
    return training_view(spark, sf).filter("training_set")


_FM_SQL = _AGG_CTES + ", fm AS (SELECT lease_id, tenant_id, property_id, " + ",\n  ".join(
    c for g in GROUP_SQL.values() for c in g) + " FROM d_fin)"

# -- M2: medians (mean of the middle two), modes; every column of the matrix ----------
def _median_sql(cols, prefix):
    """(lower middle + upper middle) / 2, without interpolation's rounding."""
    return ", ".join(f"(quantile_disc(CAST({c} AS DOUBLE), 0.5) - quantile_disc(-CAST({c} AS DOUBLE), 0.5)) / 2 AS {prefix}{c}"
                     for c in cols)


def _mode_sql(c, table="fm"):
    return (f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)")


def _zero(c):
    """-0.0 as 0.0."""
    return F.col(c) + F.lit(0.0)


register("m02_impute_stats", q(_FM_SQL + f"""
, st AS (SELECT {_median_sql(NUMERIC_FEATURES, 'median_')} FROM fm)
SELECT {", ".join(f"median_{c}" for c in NUMERIC_FEATURES)},
       {", ".join(f"{_mode_sql(c)} AS mode_{c}" for c in CATEGORICAL_FEATURES)}
FROM st
"""))(lambda spark, sf: PP.impute_plan(_matrix(spark, sf), NUMERIC_FEATURES, CATEGORICAL_FEATURES)[1].select(
    *[f"median_{c}" for c in NUMERIC_FEATURES], *[f"mode_{c}" for c in CATEGORICAL_FEATURES]))

register("m02_imputed_features", q(_FM_SQL + f"""
, st AS (SELECT {_median_sql(NUMERIC_FEATURES, 'md_')} FROM fm)
SELECT lease_id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), md_{c}) AS {c}" for c in NUMERIC_FEATURES)},
       {", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in CATEGORICAL_FEATURES)}
FROM fm, st
"""))(lambda spark, sf: PP.impute_plan(_matrix(spark, sf), NUMERIC_FEATURES, CATEGORICAL_FEATURES)[0].select(
    "lease_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES], *CATEGORICAL_FEATURES))

# -- M3 / M4: every numeric column ---------------------------------------------------
register("m03_standard_scale", q(_FM_SQL + f"""
, st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC_FEATURES)} FROM fm)
SELECT lease_id,
       {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 ELSE s_{c} END, 6) + CAST(0 AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES)}
FROM fm, st
"""))(lambda spark, sf: PP.scale_plan(_matrix(spark, sf), NUMERIC_FEATURES)
      .select("lease_id", *[F.round(c, 6).alias(c) for c in NUMERIC_FEATURES])
      .select("lease_id", *[_zero(c).alias(c) for c in NUMERIC_FEATURES]))

register("m04_scale_columns", q(_FM_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) > 2 AS scale FROM fm" for c in NUMERIC_FEATURES)))(
    lambda spark, sf: PP.scale_columns_plan(_matrix(spark, sf), NUMERIC_FEATURES))

# -- M5 / M6: stratified split, statistics of the train rows applied to the test rows -----
_LABELLED_SQL = _FM_SQL + _TRAIN_SQL + """
, lab AS (SELECT lease_id, CAST(max(churned) AS DOUBLE) AS label FROM tv WHERE training_set GROUP BY 1),
lf AS (SELECT fm.*, lab.label, (fm.lease_id * 48271 + 42) % 100003 AS cell FROM fm JOIN lab ON lab.lease_id = fm.lease_id),
cn AS (SELECT label, cell, count(*) AS n FROM lf GROUP BY 1, 2),
ct AS (SELECT label, cell, sum(n) OVER (PARTITION BY label ORDER BY cell) * 100
              <= sum(n) OVER (PARTITION BY label) * 20 AS test FROM cn),
sp AS (SELECT lf.*, ct.test FROM lf JOIN ct ON ct.label = lf.label AND ct.cell = lf.cell),
train AS (SELECT * FROM sp WHERE NOT test)
"""
_IDX = [c + "_idx" for c in CATEGORICAL_FEATURES]
_INPUTS = NUMERIC_FEATURES + _IDX

CLASS_WEIGHT_SQL = q(_LABELLED_SQL + """
, r AS (SELECT sum(label) / nullif(count(*), 0) AS rate FROM train)
SELECT round(rate, 6) AS positive_rate, round((1 - rate) / nullif(rate, 0), 6) AS class_weight FROM r
""")

SPLIT_SQL = q(_LABELLED_SQL + "SELECT lease_id, label, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM sp")

PIPELINE_SQL = q(_LABELLED_SQL + f"""
, st AS (SELECT {_median_sql(NUMERIC_FEATURES, 'md_')} FROM train),
im AS (SELECT lease_id, test, {", ".join(f"coalesce(CAST({c} AS DOUBLE), md_{c}) AS {c}" for c in NUMERIC_FEATURES)},
              {", ".join(f"coalesce({c}, {_mode_sql(c, 'train')}) AS {c}" for c in CATEGORICAL_FEATURES)} FROM sp, st),
""" + ",\n".join(f"v_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i "
                 f"FROM (SELECT DISTINCT {c} FROM im WHERE NOT test AND {c} IS NOT NULL))" for c in CATEGORICAL_FEATURES) + f""",
en AS (SELECT im.lease_id, im.test, {", ".join(f"im.{c}" for c in NUMERIC_FEATURES)},
              {", ".join(f"CAST(coalesce(v_{c}.i, -1) AS DOUBLE) AS {c}_idx" for c in CATEGORICAL_FEATURES)}
       FROM im {" ".join(f"LEFT JOIN v_{c} ON v_{c}.v = im.{c}" for c in CATEGORICAL_FEATURES)}),
sc AS (SELECT {", ".join(f"count(DISTINCT {c}) > 2 AS k_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _INPUTS)}
       FROM en WHERE NOT test)
SELECT lease_id, {", ".join(
    f"round(CASE WHEN k_{c} THEN ({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 ELSE s_{c} END ELSE {c} END, 6) + CAST(0 AS DOUBLE) AS {c}"
    for c in _INPUTS)}
FROM en, sc WHERE test
""")

# -- P1 / E4 ------------------------------------------------------------------------------
def p01(spark, sf):
    """The feature frame without ids and target, and the target, each summed up."""
    lab = _train(spark, sf).groupBy("lease_id").agg(F.max("churned").cast("double").alias("label"))
    x, y = P.split_target(_matrix(spark, sf).join(lab, "lease_id"), "label")
    sums = x.agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in NUMERIC_FEATURES])
    return with_stats(sums, y.agg(F.sum("label").alias("positives")))


register("p01_split_target", q(_FM_SQL + _TRAIN_SQL + f"""
, lab AS (SELECT lease_id, CAST(max(churned) AS DOUBLE) AS label FROM tv WHERE training_set GROUP BY 1),
x AS (SELECT fm.*, lab.label FROM fm JOIN lab ON lab.lease_id = fm.lease_id)
SELECT count(*) AS rows, sum(label) AS positives,
       {", ".join(f"round(sum(CAST({c} AS DOUBLE)), 2) AS {c}" for c in NUMERIC_FEATURES)} FROM x
"""))(p01)


def e04(spark, sf):
    """Every feature with its category and its number of values in the matrix."""
    catalog = FE.feature_catalog()
    n = _matrix(spark, sf).agg(*[F.count(f).alias(f) for f, _ in catalog])
    return n.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(g).alias("category"),
                                                F.col(f).alias("n_values")) for f, g in catalog])))


register("e4_feature_catalog", q(_FM_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, '{g}' AS category, count({f}) AS n_values FROM fm" for f, g in FE.feature_catalog())))(e04)

# -- A24 -----------------------------------------------------------------------------------
_KEYS = ("lease_id", "tenant_id", "property_id")


def a24(spark, sf):
    """Training rows, their churn, and the columns of the feature matrix beside its keys."""
    features = len(set(_matrix(spark, sf).columns) - set(_KEYS))
    return _train(spark, sf).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("churned").cast("long").alias("churned"),
        F.round(F.sum("churned") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("churn_rate"),
        F.lit(features).alias("feature_count"))


register("a24_dataset_stats", q(_FM_SQL + _TRAIN_SQL + f"""
, names AS (SELECT unnest(json_keys(to_json(fm))) AS name FROM fm)
SELECT count(*) AS samples, CAST(sum(churned) AS BIGINT) AS churned,
       round(CAST(sum(churned) AS DOUBLE) / nullif(count(*), 0), 6) AS churn_rate,
       CAST((SELECT count(DISTINCT name) FROM names WHERE name NOT IN {_KEYS}) AS INTEGER) AS feature_count
FROM tv WHERE training_set
"""))(a24)

# -- M1 ------------------------------------------------------------------------------------
_ENC = ["property_type", "payment_method", "neighborhood_type_raw"]


def m01(spark, sf):
    dom = domain(spark, sf)
    fm = _matrix(spark, sf).join(dom.properties().select("property_id", "property_type"), "property_id", "left")
    fit = fm.join(_train(spark, sf).select("lease_id").distinct(), "lease_id", "left_semi")
    out = PP.label_encode_plan(fit, fm, _ENC)
    return out.select("lease_id", *[c + "_idx" for c in _ENC])


register("m01_label_encode", q(_FM_SQL + _TRAIN_SQL + """
, fmp AS (SELECT fm.*, p.property_type FROM fm LEFT JOIN d_property p ON p.property_id = fm.property_id),
fit AS (SELECT * FROM fmp WHERE lease_id IN (SELECT lease_id FROM tv WHERE training_set)),
v1 AS (SELECT property_type AS v, dense_rank() OVER (ORDER BY property_type) - 1 AS i
       FROM (SELECT DISTINCT property_type FROM fit WHERE property_type IS NOT NULL)),
v2 AS (SELECT payment_method AS v, dense_rank() OVER (ORDER BY payment_method) - 1 AS i
       FROM (SELECT DISTINCT payment_method FROM fit WHERE payment_method IS NOT NULL))
SELECT f.lease_id, CAST(coalesce(v1.i, -1) AS INTEGER) AS property_type_idx,
       CAST(coalesce(v2.i, -1) AS INTEGER) AS payment_method_idx, -1 AS neighborhood_type_raw_idx
FROM fmp f LEFT JOIN v1 ON v1.v = f.property_type LEFT JOIN v2 ON v2.v = f.payment_method
"""))(m01)

# -- M15 / M16 / M17 ------------------------------------------------------------------------
_TRAINED = _TRAIN_SQL + ", tr AS (SELECT * FROM tv WHERE training_set)\n"

register("m15_evaluate", q(_TRAINED + """
, c AS (SELECT count(*) FILTER (WHERE churned = 1 AND predicted_churn) AS tp,
               count(*) FILTER (WHERE churned <> 1 AND predicted_churn) AS fp,
               count(*) FILTER (WHERE churned <> 1 AND NOT predicted_churn) AS tn,
               count(*) FILTER (WHERE churned = 1 AND NOT predicted_churn) AS fn FROM tr),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p,
             CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS rc FROM c)
SELECT tp, fp, tn, fn,
       round(CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END, 6)
         AS accuracy,
       round(p, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1,
       round(CASE WHEN tn + fp = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS specificity
FROM r
"""), headline=True)(lambda spark, sf: EV.confusion(_train(spark, sf)))

_SC_SQL = """
, sc AS (SELECT risk_score AS score, count(*) FILTER (WHERE churned = 1) AS pos,
                count(*) FILTER (WHERE churned = 0) AS neg FROM tr GROUP BY 1)
"""
register("m16_auc", q(_TRAINED + _SC_SQL + """
, w AS (SELECT sc.*, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS nb FROM sc)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
       round(CASE WHEN sum(pos) * sum(neg) = 0 THEN 0
                  ELSE sum(pos * nb + CAST(0.5 AS DOUBLE) * pos * neg) / (sum(pos) * sum(neg)) END, 6) AS auc
FROM w
"""))(lambda spark, sf: EV.auc(_train(spark, sf)))

register("m17_roc_points", q(_TRAINED + _SC_SQL + """
SELECT score AS threshold, pos, neg,
       round(CASE WHEN sum(pos) OVER () = 0 THEN 0 ELSE
             CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / sum(pos) OVER () END, 6) AS tpr,
       round(CASE WHEN sum(neg) OVER () = 0 THEN 0 ELSE
             CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / sum(neg) OVER () END, 6) AS fpr
FROM sc
"""))(lambda spark, sf: EV.roc_points(_train(spark, sf)))

# -- M23 / M24 --------------------------------------------------------------------------------
register("m23_accuracy_drift", q(_TRAINED + """
SELECT CAST(CAST(date_trunc('month', outcome_date) AS DATE) AS VARCHAR) AS month, count(*) AS n,
       round(CAST(count(*) FILTER (WHERE (churned = 1) = predicted_churn) AS DOUBLE) / count(*), 6) AS accuracy
FROM tr GROUP BY 1
"""))(lambda spark, sf: EV.accuracy_drift(_train(spark, sf)))


register("m23_metrics_by_month", q(_TRAINED + """
, om AS (SELECT CAST(date_trunc('month', outcome_date) AS DATE) AS month, risk_score, churned, predicted_churn FROM tr),
c AS (SELECT month, count(*) FILTER (WHERE churned = 1 AND predicted_churn) AS tp,
             count(*) FILTER (WHERE churned <> 1 AND predicted_churn) AS fp,
             count(*) FILTER (WHERE churned <> 1 AND NOT predicted_churn) AS tn,
             count(*) FILTER (WHERE churned = 1 AND NOT predicted_churn) AS fn FROM om GROUP BY 1),
g AS (SELECT month, risk_score, count(*) FILTER (WHERE churned = 1) AS pos, count(*) FILTER (WHERE churned = 0) AS neg
      FROM om GROUP BY 1, 2),
w AS (SELECT g.*, coalesce(sum(neg) OVER (PARTITION BY month ORDER BY risk_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS below FROM g),
a AS (SELECT month, CASE WHEN sum(pos) * sum(neg) > 0
                         THEN round(sum(pos * below + CAST(0.5 AS DOUBLE) * pos * neg) / (sum(pos) * sum(neg)), 6) END AS auc FROM w GROUP BY 1),
r AS (SELECT c.*, a.auc, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p,
             CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS rc FROM c JOIN a ON a.month = c.month)
SELECT CAST(month AS VARCHAR) AS month, tp, fp, tn, fn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 6) AS accuracy,
       round(p, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1, auc
FROM r
"""))(lambda spark, sf: EV.monthly_metrics(_train(spark, sf)))


def m23_psi(spark, sf):
    h = PR.prediction_history(domain(spark, sf))
    b = TI.tier(F.col("risk_score"), SCORE_TIERS)
    return EV.psi(h.filter(F.col("prediction_date") == F.lit(dt.date(1998, 11, 1))),
                  h.filter(F.col("prediction_date") == F.lit(dt.date(1999, 1, 1))), b)


register("m23_score_psi", q(f"""
, e AS (SELECT {TI.tier_sql('risk_score', SCORE_TIERS)} AS b, count(*) AS ne FROM d_hist
        WHERE prediction_date = DATE '1998-11-01' GROUP BY 1),
a AS (SELECT {TI.tier_sql('risk_score', SCORE_TIERS)} AS b, count(*) AS na FROM d_hist
      WHERE prediction_date = DATE '1999-01-01' GROUP BY 1),
j AS (SELECT coalesce(e.b, a.b) AS b, coalesce(ne, 0) AS ne, coalesce(na, 0) AS na FROM e FULL JOIN a ON e.b = a.b),
t AS (SELECT sum(ne) AS te, sum(na) AS ta FROM j),
p AS (SELECT greatest(CAST(ne AS DOUBLE) / te, CAST(0.0001 AS DOUBLE)) AS pe,
             greatest(CAST(na AS DOUBLE) / ta, CAST(0.0001 AS DOUBLE)) AS pa FROM j, t)
SELECT round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM p
"""))(m23_psi)

register("m24_ab_split", q(_TRAINED + """
SELECT CASE WHEN (lease_id * 7919) % 100 < 50 THEN 'A' ELSE 'B' END AS variant, count(*) AS n,
       round(avg(risk_score), 4) AS avg_risk_score,
       round(CAST(count(*) FILTER (WHERE (churned = 1) = predicted_churn) AS DOUBLE) / count(*), 6) AS accuracy
FROM tr GROUP BY 1
"""))(lambda spark, sf: EV.ab_metrics(_train(spark, sf)))


register("m17_calibration", q(_TRAINED + f"""
SELECT {TI.tier_sql('risk_score', SCORE_TIERS)} AS bucket, count(*) AS n,
       round(avg(churn_probability), 6) AS mean_predicted, round(avg(CAST(churned AS DOUBLE)), 6) AS observed_rate
FROM tr GROUP BY 1
"""))(lambda spark, sf: EV.calibration(_train(spark, sf), TI.tier(F.col("risk_score"), SCORE_TIERS)))
