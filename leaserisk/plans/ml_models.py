"""Spark ML queries.

Model outputs cannot be reproduced by SQL, so these are checked rows-only
(no oracle), except M22 whose scorer is the rule score.  They train the
library defaults, the reference's 200 (boosting) / 500 (forest) trees; the
queries of an application share each fit.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from leaserisk.config import AS_OF, RENEWAL_WINDOW_DAYS
from leaserisk.operators import features as FE
from leaserisk.operators import filters as P
from leaserisk.operators import ml as ML
from leaserisk.operators import registry as REG
from leaserisk.operators import scoring as S
from leaserisk.operators.permutation import permutation_importance
from leaserisk.operators.search import ROWS_PER_PARTITION, partitions, run_search, with_folds
from leaserisk.plans.features import _rounded
from leaserisk.plans.modeling import CLASS_WEIGHT_SQL, PIPELINE_SQL, SPLIT_SQL
from leaserisk.plans.oracle_prefix import q
from leaserisk.plans.registry import register
from leaserisk.plans.warehouse import training_view
from leaserisk.session import checkpoint_dir, scratch_path
from leaserisk.sources.driver import domain, table_files

_CACHE: dict = {}
#: The registered queries' training time stamp; the clock is not read.
TRAINED_AT = dt.datetime(AS_OF.year, AS_OF.month, AS_OF.day)
VERSION = "gbt-1.0"


def _cached(spark, sf, name, make):
    """Prepared rows and fits of this application, as long as the folder's files are the same."""
    owner, state = (spark.sparkContext.applicationId, sf), table_files(spark, sf)
    kept = _CACHE.get(owner)
    if kept is None or kept[0] != state:
        for frame in (kept[1].get("rows", (None,))[1:] if kept else ()):
            frame.unpersist()
        _CACHE[owner] = kept = (state, {})
    if name not in kept[1]:
        kept[1][name] = make()
    return kept[1][name]


def labelled(spark, sf):
    """Feature matrix rows of the leases with an outcome, label = churned."""
    dom = domain(spark, sf)
    lab = (training_view(spark, sf).filter("training_set")
           .groupBy("lease_id").agg(F.max("churned").cast("double").alias("label")))
    leases = dom.leases().join(lab.select("lease_id"), "lease_id", "left_semi")
    fm = _rounded(FE.feature_matrix(FE.feature_input(dom, leases=leases)))
    return ML.split(fm.join(lab, "lease_id"))


def _stored(df, name):
    """Rows written once and read back (cuts the lineage, survives lost executors; a pass reads its columns alone)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(df):
    """Rows that many fits read again: stored, few partitions for few rows (a tree level is a job, and its tasks cost
    more than their rows) and as many as their number and the cores ask for, not as few as their files; kept in memory
    or on disk."""
    back = _stored(df, "prepared")
    n = partitions(back.count(), df.sparkSession.sparkContext.defaultParallelism, ROWS_PER_PARTITION)
    back = back.repartition(n) if n > 1 else back.coalesce(n)  # a split of a file may hold no row group
    return back.persist(StorageLevel.MEMORY_AND_DISK)


def _prepared(spark, sf):
    def make():
        checkpoint_dir(spark)
        data = _stored(labelled(spark, sf), "labelled")
        fp, train, test = ML.prepare(data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test"))
        return fp, _held(ML.class_weight_col(train)), _held(test)
    return _cached(spark, sf, "rows", make)


def _model(spark, sf, name):
    est = {"gbt": ML.gbt, "logistic": ML.logistic, "random_forest": ML.random_forest}[name]
    return _cached(spark, sf, name, lambda: ML.fit(est(), _prepared(spark, sf)[1]))


register("m06_split", SPLIT_SQL)(lambda spark, sf: labelled(spark, sf).select("lease_id", "label", "split"))

register("a26_class_weight", CLASS_WEIGHT_SQL)(
    lambda spark, sf: ML.class_weight(labelled(spark, sf).filter("split = 'train'")).select(
        F.round("positive_rate", 6).alias("positive_rate"), F.round("class_weight", 6).alias("class_weight")))


def m05(spark, sf):
    fp, train, test = _prepared(spark, sf)
    return test.select("lease_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ML.MODEL_INPUTS]).select(
        "lease_id", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ML.MODEL_INPUTS])


register("m05_feature_pipeline", PIPELINE_SQL)(m05)


def _pred_query(name):
    def run(spark, sf):
        model, _ = _model(spark, sf, name)
        _, _, test = _prepared(spark, sf)
        return ML.predict(model, test).select("lease_id", "label", "churn_probability", "risk_score",
                                              "risk_level", "predicted_churn", "confidence")
    return run


register("m07_gbt_predictions")(_pred_query("gbt"))
register("m08_logistic_predictions")(_pred_query("logistic"))
register("m09_random_forest_predictions")(_pred_query("random_forest"))


def m10(spark, sf):
    _, _, test = _prepared(spark, sf)
    rows = ML.compare_fitted(test, {n: _model(spark, sf, n) for n in ("gbt", "logistic", "random_forest")})
    cols = ["model", "auc", "accuracy", "precision", "recall", "f1", "train_seconds"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows],
                                 "model string, auc double, accuracy double, precision double, recall double, "
                                 "f1 double, train_seconds double")


register("m10_model_comparison")(m10)


def _search(spark, sf, points):
    """Results go to one ledger in the shared folder; a query that broke off goes on where it was.  A fit that is one task
    keeps one core busy, so as many run as there are cores."""
    _, train, _ = _prepared(spark, sf)
    at_once = min(64, max(5, spark.sparkContext.defaultParallelism))
    return run_search(with_folds(train), points, ML.gbt, f"{checkpoint_dir(spark)}/search", ML.MODEL_INPUTS, folds=5,
                      parallelism=at_once)


def m11(spark, sf):
    return _search(spark, sf, [{}]).select("folds", "cv_auc_mean", "cv_auc_std")


register("m11_cross_validation")(m11)


def m12(spark, sf):
    point = F.from_json("point", "max_depth int, step_size double, max_iter int, subsampling_rate double, feature_subset string")
    return _search(spark, sf, ML.grid_points()).select(point.alias("p"), "cv_auc_mean", "cv_auc_std").select(
        "p.*", "cv_auc_mean", "cv_auc_std")


register("m12_grid_search")(m12)


def _window(dom):
    """Leases of the renewal window, from the orders that can end in it."""
    return dom.leases_ending(AS_OF, AS_OF + dt.timedelta(days=RENEWAL_WINDOW_DAYS)).filter(P.renewal_window())


def m13(spark, sf):
    """Score every lease in the renewal window with the boosted model."""
    model, _ = _model(spark, sf, "gbt")
    fp, _, _ = _prepared(spark, sf)
    rows = FE.feature_input(domain(spark, sf), leases=_window(domain(spark, sf)))
    x = fp.transform(FE.feature_matrix(rows))
    return ML.predict(model, x).select("lease_id", "churn_probability", "risk_score", "risk_level",
                                       "predicted_churn", "confidence")


register("m13_predict_renewal_window")(m13)


def m18(spark, sf):
    model, _ = _model(spark, sf, "gbt")
    return ML.importances(model, spark)


register("m18_feature_importance")(m18)
register("k01_top_importances")(lambda spark, sf: ML.top_importances(m18(spark, sf), 10))


def m19(spark, sf):
    model, _ = _model(spark, sf, "gbt")
    _, _, test = _prepared(spark, sf)
    imp = list(zip(ML.MODEL_INPUTS, model.stages[-1].featureImportances.toArray().tolist()))
    ex = ML.explain(ML.predict(model, test), imp, 5)
    return ex.select("lease_id", "churn_probability", "risk_level",
                     F.array_join(F.transform("explanation", lambda s: s["feature"]), ",").alias("top_features"),
                     F.transform("explanation", lambda s: s["value"]).alias("top_values"),
                     F.size("explanation").alias("n_features"))


register("m19_explanations")(m19)


def w05(spark, sf):
    model, _ = _model(spark, sf, "gbt")
    _, _, test = _prepared(spark, sf)
    w = dict(zip(ML.MODEL_INPUTS, model.stages[-1].featureImportances.toArray().tolist()))
    return ML.top_features_per_row(test, w, 3).select("lease_id", F.array_join("top_features", ",")
                                                      .alias("top_features"))


register("w05_top_features_per_row")(w05)


def m20(spark, sf):
    model, _ = _model(spark, sf, "logistic")
    fp, train, test = _prepared(spark, sf)
    means = train.agg(*[F.avg(c).alias(c) for c in ML.MODEL_INPUTS]).first().asDict()
    att = ML.linear_attribution(model, means, test, 5)
    return att.select("lease_id", F.array_join(F.transform("attribution", lambda s: s["feature"]), ",")
                      .alias("top_attributions"))


register("m20_linear_attribution")(m20)


def m20_permutation(spark, sf):
    """M20 for the boosted trees: what the test rows' AUC loses when one column is shuffled."""
    model, _ = _model(spark, sf, "gbt")
    _, _, test = _prepared(spark, sf)

    def score(rows):
        scored = model.stages[-1].transform(rows.withColumn("features", array_to_vector("features")))
        return scored.withColumn("score", vector_to_array("probability")[1])

    return permutation_importance(test, "lease_id", ML.MODEL_INPUTS, score)


register("m20_permutation_importance")(m20_permutation)


def registered(spark, sf):
    """The boosted model saved in a registry of its own under the shared folder: (folder, the test rows)."""
    model, _ = _model(spark, sf, "gbt")
    fp, train, test = _prepared(spark, sf)

    def make():
        root, m = scratch_path(spark, "registry"), ML.metrics(ML.predict(model, test))
        REG.save_version(root, VERSION, model, fp, ML.importances(model, spark), trained_at=TRAINED_AT,
                         training_samples=train.count(), auc=m["auc"], accuracy=m["accuracy"], features=ML.MODEL_INPUTS,
                         config={"max_iter": 200, "max_depth": 6, "step_size": 0.1})
        return root
    return _cached(spark, sf, "registry", make), test


def m21(spark, sf):
    return REG.versions(spark, registered(spark, sf)[0])


register("m21_model_metadata")(m21)


def s07(spark, sf):
    """The boosted model saved as a version; the latest version is looked up, loaded and scores the test rows."""
    root, test = registered(spark, sf)
    version, model, _, _ = REG.load_version(spark, root)
    return ML.predict(model, test).select("lease_id", F.lit(version).alias("model_version"), "churn_probability", "risk_level")


register("s07_model_save_load")(s07)


def m22(spark, sf):
    """Score the renewal-window work list: context of those leases only, then rule score."""
    dom = domain(spark, sf)
    ctx = FE.lease_context(dom, leases=_window(dom))
    return S.with_rule_risk(ctx).select("lease_id", "risk_score", "risk_level", "predicted_churn")


register("m22_batch_scoring", q("""
SELECT lease_id, risk_score, risk_level, predicted_churn FROM d_scored
WHERE lease_id IN (SELECT lease_id FROM d_lease WHERE status = 'active' AND end_date > DATE '1999-01-01'
                   AND end_date <= DATE '1999-01-01' + 90)
"""))(m22)
