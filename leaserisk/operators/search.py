"""Cross-validation and grid search that resume.

A search is rows with folds, and points (settings of an estimator).  Each
(point, fold) is one fit on the other folds and one AUC on the fold; its result
is written as a ledger row as soon as it ends, in a folder of its own, so a fit
that ran twice replaces itself and fits may run at once.  A rerun reads the
ledger first and fits only what is absent.  Ledger rows carry a checksum of the rows
searched, so other data never take results of these.  Boosted points that differ in
``max_iter`` alone are results of one fit: the smaller model is the larger one's first trees.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from math import ceil

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaserisk.operators import ml as ML
from leaserisk.operators.boosting import BoostedTrees
from leaserisk.sources.io import path_exists

LEDGER = "point string, auc double, test_rows long, seconds double, search string, point_id string, fold int"
# A small table's rows of a partition, and the rows of a task up to which each core gets one task.
ROWS_PER_PARTITION, ROWS_IN_WAVE = 50_000, 400_000


def partitions(rows: int, cores: int, small: int = ROWS_PER_PARTITION, wave: int = ROWS_IN_WAVE) -> int:
    """Partitions of training rows.  Each tree level is a job whose tasks all fill and send the level's histograms: a
    table up to ``wave`` rows gets partitions by ``small``, a larger one no more than whole waves of cores need."""
    n = max(1, ceil(rows / small))
    return n if rows <= wave else min(n, cores * ceil(rows / (cores * wave)))


def with_folds(df: DataFrame, folds: int = 5, key: str = "lease_id", label: str = "label", seed: int = 42) -> DataFrame:
    """``df`` with a column ``fold`` (0 to folds - 1), stratified: within each label, whole cells of M6's hash of the key
    in order, each fold as near to an equal share of the label's rows as whole cells allow."""
    d = df.withColumn("_cell", ML.split_cell(key, seed))
    n = d.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_cell"))
    total = F.sum("_n").over(Window.partitionBy(label))
    cells = n.withColumns({"_upto": upto, "_total": total}).select(
        label, "_cell", F.expr(f"(2 * _upto - _n) * {folds} div (2 * _total)").cast("int").alias("fold"))
    return d.join(cells, [label, "_cell"]).select(*df.columns, "fold")


def checksum(df: DataFrame) -> str:
    """Number and order-free hash sums of the rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    n, a, b = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_000_007)))).first()
    return hashlib.sha256(f"{n},{a},{b}".encode()).hexdigest()[:16]


def _point(point: dict) -> tuple[str, str]:
    text = json.dumps(point, sort_keys=True)
    return text, hashlib.sha256(text.encode()).hexdigest()[:16]


def _series(tasks: list[tuple[dict, int]]) -> list[tuple[list[dict], int]]:
    """(points, fold): a fold's points that differ in ``max_iter`` alone, the smallest first."""
    series: dict = {}
    for point, fold in tasks:
        series.setdefault((_point({k: v for k, v in point.items() if k != "max_iter"}), "max_iter" in point, fold), []).append(point)
    return [(sorted(points, key=lambda p: p.get("max_iter", 0)), fold) for (_, _, fold), points in series.items()]


def ledger_rows(spark: SparkSession, ledger: str, search: str) -> DataFrame:
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("search") == search)


def run_search(rows: DataFrame, points: list[dict], estimator: Callable[..., Estimator], ledger: str,
               features: list[str], folds: int = 5, parallelism: int = 5, label: str = "label") -> DataFrame:
    """(point, folds, cv_auc_mean, cv_auc_std): one row per point over its folds.

    ``rows`` hold the features, the label, ``weight`` and ``fold``.  Fits that the ledger has are not repeated; a
    row's ``seconds`` count from the start of the fit it came from.  Small tables are read in few partitions, as each tree level is a job and its tasks cost more than their rows.
    """
    spark = rows.sparkSession
    used = rows.select(*features, label, "weight", "fold")
    search = checksum(used)
    done = {(r["point_id"], r["fold"]) for r in ledger_rows(spark, ledger, search).select("point_id", "fold").collect()}
    absent = [(p, f) for p in points for f in range(folds) if (_point(p)[1], f) not in done]
    if absent:
        held = used.repartition(partitions(used.count(), spark.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)

        def one(task: tuple[list[dict], int]) -> None:
            points, fold = task
            train, test = held.filter(F.col("fold") != fold), held.filter(F.col("fold") == fold)
            while points:
                began, est = time.time(), estimator(**points[-1])
                if isinstance(est, BoostedTrees):
                    est.alone = False
                together = points if ML.has_prefixes(est) else points[-1:]
                points = points[:-len(together)]
                model = Pipeline(stages=[ML.assembler(features), est]).fit(train)
                for point in together:
                    (text, name), part = _point(point), model if point is together[-1] else ML.first_trees(model, point["max_iter"])
                    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0).evaluate(part.transform(test))
                    row = [(text, float(auc), test.count(), time.time() - began)]
                    spark.createDataFrame(row, "point string, auc double, test_rows long, seconds double").coalesce(1).write.mode(
                        "overwrite").parquet(f"{ledger}/search={search}/point_id={name}/fold={fold}")

        try:
            with ThreadPoolExecutor(parallelism) as pool:
                list(pool.map(one, _series(absent)))
        finally:
            held.unpersist()
    wanted = spark.createDataFrame([_point(p) for p in points], "point string, point_id string").distinct()
    found = ledger_rows(spark, ledger, search).filter(F.col("fold") < folds).drop("point")
    return (wanted.join(found, "point_id").groupBy("point")
            .agg(F.count(F.lit(1)).cast("int").alias("folds"), F.avg("auc").alias("cv_auc_mean"), F.stddev_pop("auc").alias("cv_auc_std")))
