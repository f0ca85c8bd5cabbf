"""Spark ML models.

The boosted model is ``GBTClassifier`` with the reference's settings (depth
6, step 0.1, subsample 0.8, column sample 0.8, class weight); the baselines
are ``LogisticRegression`` and ``RandomForestClassifier``.  Training data
are distributed DataFrames; only fitted parameters and metrics reach the
driver.  Tree counts are parameters (the reference's 200 / 500 are the
defaults, which the registered queries use).
"""

from __future__ import annotations

import time
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaserisk.functions.stats import with_stats
from leaserisk.operators import prep as PP
from leaserisk.operators import scoring as S
from leaserisk.operators.boosting import BoostedTrees

NUMERIC_FEATURES = [
    "avg_days_late", "max_days_late", "late_payment_rate", "payment_consistency", "days_since_last_payment",
    "has_autopay", "portal_logins_per_month", "maintenance_requests_per_year", "high_priority_requests",
    "avg_response_time_hours", "missed_communication_count", "complaint_count", "escalation_count",
    "previous_renewals", "tenure_months", "square_feet", "bedrooms", "bathrooms", "property_age",
    "location_score", "school_rating", "has_garage", "has_yard", "has_ac", "property_condition",
    "years_since_renovation", "monthly_rent", "rent_per_sqft", "rent_to_income_ratio", "rent_increase_pct",
    "total_rent_increases", "security_deposit_months", "total_late_fees", "market_rent_median",
    "rent_vs_market", "neighborhood_vacancy_rate", "market_rent_growth_1yr", "market_rent_growth_3yr",
    "new_listings_count", "avg_days_on_market", "median_household_income", "population_growth_rate",
    "competitor_properties_1mi", "days_to_expiration", "lease_term_months", "lease_end_month",
    "is_summer_expiration"]
CATEGORICAL_FEATURES = ["neighborhood_type", "payment_method"]
MODEL_INPUTS = NUMERIC_FEATURES + [c + "_idx" for c in CATEGORICAL_FEATURES]


SPLIT_CELLS = 100_003


def split_cell(key: str, seed: int = 42):
    """M6's arithmetic hash of the key, in [0, SPLIT_CELLS)."""
    return F.pmod(F.col(key) * 48271 + seed, F.lit(SPLIT_CELLS))


def split(df: DataFrame, key: str = "lease_id", seed: int = 42, test_pct: int = 20, label: str = "label") -> DataFrame:
    """M6: stratified split, the same rows on every run: within each label the
    rows of the lowest cells of an arithmetic hash of the key, as many whole cells
    as stay within ``test_pct`` per cent of the label's rows, are the test rows.

    Rows are counted by (label, cell) and only those counts, a fixed number
    per label, are ranked."""
    d = df.withColumn("_cell", split_cell(key, seed))
    n = d.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_cell"))
    total = F.sum("_n").over(Window.partitionBy(label))
    cells = n.select(label, "_cell", (upto * 100 <= total * test_pct).alias("_test"))
    return (d.join(cells, [label, "_cell"])
            .withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_cell", "_test")
            .select(*df.columns, "split"))


def class_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """One row (positive_rate, class_weight) of the train split; null weight without a positive."""
    rate = train.agg((F.sum(label) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("positive_rate"))
    r = F.col("positive_rate")
    return rate.select("positive_rate", ((1 - r) / F.nullif(r, F.lit(0.0))).alias("class_weight"))


def class_weight_col(df: DataFrame, label: str = "label") -> DataFrame:
    """A26 as a weight column: positives weighted (1 - r) / r (rate as a scalar subquery)."""
    w = class_weight(df, label).select(F.col("class_weight").alias("_w"))
    return with_stats(df, w).withColumn("weight", F.when(F.col(label) == 1, F.col("_w")).otherwise(1.0)).drop("_w")


def prepare(train: DataFrame, rows: DataFrame | None = None):
    """M5: fit impute/encode/scale on the training rows; apply to both."""
    fp = PP.fit_pipeline(train, NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    out = fp.transform(train)
    return fp, out, (fp.transform(rows) if rows is not None else None)


def assembler(inputs=MODEL_INPUTS):
    return VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="keep")


def gbt(max_iter: int = 200, weighted: bool = True, seed: int = 42, validation_col: str | None = None,
        validation_tol: float = 0.01, max_depth: int = 6, step_size: float = 0.1, subsampling_rate: float = 0.8,
        feature_subset: str = "0.8") -> GBTClassifier:
    """M7: the boosted model with the reference's hyper-parameters.

    ``validation_col`` (Q10): a boolean column marking validation rows turns
    on early stopping (the reference accepted the setting but never used it)."""
    m = BoostedTrees(labelCol="label", featuresCol="features", maxDepth=max_depth, stepSize=step_size,
                      maxIter=max_iter, subsamplingRate=subsampling_rate, featureSubsetStrategy=feature_subset, seed=seed)
    if validation_col:
        m = m.setValidationIndicatorCol(validation_col)
        m._set(validationTol=validation_tol)
    return m.setWeightCol("weight") if weighted else m


def logistic(weighted: bool = True) -> LogisticRegression:
    """M8."""
    m = LogisticRegression(labelCol="label", featuresCol="features", maxIter=100)
    return m.setWeightCol("weight") if weighted else m


def random_forest(num_trees: int = 500, seed: int = 42) -> RandomForestClassifier:
    """M9."""
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees, seed=seed)


def fit(estimator, train: DataFrame) -> tuple[PipelineModel, float]:
    t0 = time.time()
    model = Pipeline(stages=[assembler(), estimator]).fit(train)
    return model, time.time() - t0


def has_prefixes(estimator) -> bool:
    """Whether a fit with more trees begins with the trees of one with fewer: each boosted tree has the seed plus its
    number as its seed and follows the trees before it alone, unless validation rows choose how many are kept."""
    return isinstance(estimator, GBTClassifier) and not estimator.isDefined(estimator.validationIndicatorCol)


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The model that the same booster fits on the same rows with ``maxIter`` n, from one with more trees."""
    own = model.stages[-1]
    sc = SparkSession.active().sparkContext
    ml, gateway = sc._jvm.org.apache.spark.ml, sc._gateway
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(own._java_obj.trees()[:n], own.treeWeights)):
        trees[i], weights[i] = tree, weight
    cut = own._copyValues(GBTClassificationModel(ml.classification.GBTClassificationModel(own.uid, trees, weights)))
    return PipelineModel([*model.stages[:-1], cut])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Probability of churn and the derived score / level / flag / confidence."""
    p = vector_to_array(F.col("probability"))[1]
    return (model.transform(rows)
            .withColumn("churn_probability", p)
            .withColumns({"risk_score": S.score_from_probability(F.col("churn_probability")),
                          "predicted_churn": F.col("churn_probability") >= 0.5,
                          "confidence": F.abs(F.col("churn_probability") - 0.5) * 2})
            .withColumn("risk_level", S.risk_level(F.col("risk_score"))))


def metrics(pred: DataFrame) -> dict:
    """AUC (Spark evaluator) + confusion metrics in one aggregation."""
    from leaserisk.operators import evaluate as EV
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC").evaluate(pred)
    c = EV.confusion(pred.withColumn("churned", F.col("label").cast("int")), "churned",
                     "predicted_churn").first().asDict()
    c["auc"] = auc
    return c


def compare(train: DataFrame, test: DataFrame, estimators: dict) -> list[dict]:
    """Fit every estimator; metrics sorted best AUC first."""
    return compare_fitted(test, {name: fit(est, train) for name, est in estimators.items()})


def compare_fitted(test: DataFrame, fitted: dict) -> list[dict]:
    """M10 over results of ``fit``."""
    out = []
    for name, (model, secs) in fitted.items():
        m = metrics(predict(model, test))
        m.update(model=name, train_seconds=round(secs, 3))
        out.append(m)
    return sorted(out, key=lambda r: -r["auc"])


#: The five settings of the tuning grid, 243 points.
GRID = {"max_depth": [4, 6, 8], "step_size": [0.01, 0.1, 0.2], "max_iter": [100, 200, 300],
        "subsampling_rate": [0.7, 0.8, 0.9], "feature_subset": ["0.7", "0.8", "0.9"]}


def grid_points(grid: dict = GRID) -> list[dict]:
    """Every combination of the grid's values, as arguments of ``gbt``."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def importances(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance) table from the fitted trees."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(MODEL_INPUTS, [float(x) for x in imp])), "feature string, importance double")


def top_importances(imp: DataFrame, n: int = 10) -> DataFrame:
    """K1: TakeOrderedAndProject over the importance table."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def explain(scored: DataFrame, imp_rows: list[tuple[str, float]], n: int = 5) -> DataFrame:
    """For every row the top-n global features with the row's
    values (array<struct>), computed as columns (no per-row Python)."""
    top = sorted(imp_rows, key=lambda r: -r[1])[:n]
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("importance"),
                             F.col(f).cast("double").alias("value")) for f, w in top])
    return scored.withColumn("explanation", arr)


def top_features_per_row(df: DataFrame, weights: dict, n: int = 3) -> DataFrame:
    """Per row, the n features with the largest |weight * value| (sort an
    array of structs; no window)."""
    arr = F.array(*[F.struct(F.abs(F.lit(float(w)) * F.col(f).cast("double")).alias("score"),
                             F.lit(f).alias("feature")) for f, w in weights.items()])
    top = F.slice(F.sort_array(arr, asc=False), 1, n)
    return df.withColumn("top_features", F.transform(top, lambda s: s["feature"]))


def linear_attribution(model: PipelineModel, train_means: dict, rows: DataFrame, n: int = 5) -> DataFrame:
    """M20 (linear model): exact contribution coef * (x - mean) per feature."""
    coefs = model.stages[-1].coefficients.toArray().tolist()
    parts = [F.struct((F.lit(float(c)) * (F.coalesce(F.col(f).cast("double"), F.lit(train_means.get(f) or 0.0))
                                          - F.lit(train_means.get(f) or 0.0))).alias("contribution"),
                      F.lit(f).alias("feature"))
             for f, c in zip(MODEL_INPUTS, coefs)]
    arr = F.array(*parts)
    top = F.slice(F.sort_array(F.transform(arr, lambda s: F.struct(F.abs(s["contribution"]).alias("a"),
                                                                   s["feature"].alias("feature"),
                                                                   s["contribution"].alias("contribution"))),
                               asc=False), 1, n)
    return rows.withColumn("attribution", top)
