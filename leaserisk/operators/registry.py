"""Model registry (M21, S7, S8): versions of saved models and what is known of them.

A version is saved in a folder of its own (pipeline model, preparation state,
importances); its registry row is written last, so a version whose save broke off is
never listed.  Saving a version again replaces it.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaserisk.operators.prep import FeaturePipelineModel
from leaserisk.sources.io import path_exists

ROW = ("model_type string, training_samples long, auc double, accuracy double, feature_count int, trained_at timestamp, "
       "config string, model_version string")


def save_version(root: str, version: str, model: PipelineModel, prep: FeaturePipelineModel, importances: DataFrame, *,
                 trained_at: dt.datetime, training_samples: int, auc: float, accuracy: float, features: list[str],
                 config: dict | None = None) -> None:
    """Save model, preparation and importances (CSV) under ``root``, then list the version in the registry."""
    spark, path = importances.sparkSession, f"{root}/models/{version}"
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(prep.to_json(),)], "feature_pipeline string").write.mode("overwrite").json(f"{path}/prep")
    importances.write.mode("overwrite").option("header", True).csv(f"{path}/importance")
    row = (type(model.stages[-1]).__name__, training_samples, float(auc), float(accuracy), len(features), trained_at,
           json.dumps(config or {}, sort_keys=True))
    spark.createDataFrame([row], ROW.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/registry/model_version={version}")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per listed version; an empty table where nothing has been saved."""
    if not path_exists(spark, f"{root}/registry"):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).option("basePath", f"{root}/registry").parquet(f"{root}/registry")


def load_version(spark: SparkSession, root: str, version: str | None = None) -> tuple[str, PipelineModel, FeaturePipelineModel, DataFrame]:
    """(version, model, preparation, importances) of a version, or of the one trained last (ties: the greatest name)."""
    listed = versions(spark, root)
    row = (listed.filter(F.col("model_version") == version) if version else listed).orderBy(
        F.col("trained_at").desc(), F.col("model_version").desc()).select("model_version").first()
    if row is None:
        raise KeyError(f"no version {version or 'at all'} in {root}")
    path = f"{root}/models/{row[0]}"
    prep = FeaturePipelineModel.from_json(spark.read.schema("feature_pipeline string").json(f"{path}/prep").first()[0])
    importances = spark.read.schema("feature string, importance double").option("header", True).csv(f"{path}/importance")
    return row[0], PipelineModel.load(f"{path}/model"), prep, importances
