"""The booster of operators/boosting.py is held to Spark's own, draw by draw, in one task and in several."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from leaserisk.operators import boosting as B
from leaserisk.operators import ml as ML

SETTINGS = dict(labelCol="label", weightCol="weight", maxIter=6, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.7", seed=42, stepSize=0.1)


def _rows(spark, n, parts):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n), rng.random(n) - 0.3, rng.integers(0, 5, n).astype(float), rng.exponential(size=n), np.zeros(n)
    label = (x[0] + x[1] + 0.3 * x[2] + rng.normal(size=n) * 0.7 > 1.2).astype(float)
    data = [(*map(float, v), 1.7 if v[-1] else 1.0) for v in zip(*x, label)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, label double, weight double")
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df).repartition(parts, "a").persist()


def _splits(model):
    return [re.findall(r"If \((.*?)\)", t.toDebugString) for t in model.trees]


def test_random_numbers_are_those_of_spark(spark):
    jvm = spark.sparkContext._jvm
    for seed in (42, -7, 2 ** 40 + 3):
        one, java = jvm.org.apache.spark.util.random.XORShiftRandom(seed), jvm.java.util.Random(seed)
        assert [one.nextDouble() for _ in range(700)] == list(B.xorshift_doubles(seed, 700))
        assert jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt() == B._first_int(seed)
        own = B._JavaRandom(seed)
        assert [java.nextLong() % 2 ** 64 for _ in range(5)] == [own.long() for _ in range(5)]


@pytest.mark.parametrize("n, parts, joint, share", [(600, 1, 10 ** 9, {}), (900, 2, 100, {}), (12_000, 2, 100, {}),
                                                    (700, 1, 10 ** 9, {"subsamplingRate": 1.0, "featureSubsetStrategy": "all"})])
def test_fit_is_one_job_and_its_trees_are_those_of_spark(spark, monkeypatch, n, parts, joint, share):
    monkeypatch.setattr(B, "JOINT_ROWS", joint)
    monkeypatch.setattr(B, "ROWS_ALONE", 500)
    rows, settings = _rows(spark, n, parts), {**SETTINGS, **share}
    try:
        want, own = GBTClassifier(**settings).fit(rows), B.BoostedTrees(**settings)
        made = []
        keep = own._model
        own._model = lambda s, nodes, width: made.append(nodes.rdd.getNumPartitions()) or keep(s, nodes, width)
        got = own._fit(rows)
        assert made == [parts] and got.getNumTrees == 6 and got.treeWeights == want.treeWeights
        assert _splits(got)[0] == _splits(want)[0] and sum(map(len, _splits(got))) > 40
        p = [[r.p[1] for r in m.transform(rows).select(F.col("probability").alias("p")).collect()] for m in (got, want)]
        assert np.mean(np.abs(np.array(p[0]) - np.array(p[1]))) < 0.005  # equal but for ties
        assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.02)
        assert got.getMaxIter() == 6 and got.getWeightCol() == "weight"
    finally:
        rows.unpersist()


def test_several_tasks_find_what_one_task_finds(spark, monkeypatch):
    rows = _rows(spark, 1_500, 2)
    try:
        monkeypatch.setattr(B, "ROWS_ALONE", 500)
        several = B.BoostedTrees(**SETTINGS).fit(rows)
        monkeypatch.setattr(B, "ROWS_ALONE", 10_000)
        one = B.BoostedTrees(**SETTINGS).fit(rows)
        assert _splits(several)[:2] == _splits(one)[:2]
        assert several.featureImportances.toArray() == pytest.approx(one.featureImportances.toArray(), abs=0.02)
    finally:
        rows.unpersist()


def test_exchange_adds_up_and_leaves_nothing(tmp_path):
    from threading import Thread

    got = {}

    def task(i):
        sums = B.Exchange(str(tmp_path / "x"), i, 3)
        got[i] = [sums(np.full((2, 2), 10.0 ** i * k)).tolist() for k in range(1, 5)]
        sums.close()

    threads = [Thread(target=task, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join(30) for t in threads]
    assert got[0] == got[1] == got[2] == [[[111.0 * k] * 2] * 2 for k in range(1, 5)]
    assert not list(tmp_path.iterdir())


def test_what_is_not_covered_is_left_to_spark(spark):
    rows = _rows(spark, 300, 1)
    try:
        for other in (dict(minInstancesPerNode=5), dict(featureSubsetStrategy="sqrt"), dict(validationIndicatorCol="v")):
            own = B.BoostedTrees(**{**SETTINGS, "maxIter": 2, **other})
            data = rows.withColumn("v", F.col("c") > 3)
            assert own._own_fit(data) is None and own.fit(data).getNumTrees <= 2
        zero = rows.withColumn("weight", F.when(F.col("c") > 3, 0.0).otherwise(1.0))
        assert B.BoostedTrees(**SETTINGS)._own_fit(zero) is None
        for bad in (rows.withColumn("label", F.lit(2.0)), rows.withColumn("weight", F.lit(-1.0))):
            with pytest.raises(Exception):
                B.BoostedTrees(**SETTINGS).fit(bad)
        assert isinstance(ML.gbt(3), B.BoostedTrees) and ML.has_prefixes(ML.gbt(3))
    finally:
        rows.unpersist()


def test_search_runs_a_fit_a_core_and_each_is_one_task(spark, monkeypatch, tmp_path):
    from leaserisk.operators.search import run_search
    from leaserisk.plans import ml_models as MM

    asked = {}
    monkeypatch.setattr(MM, "_prepared", lambda spark, sf: (None, None, None))
    monkeypatch.setattr(MM, "with_folds", lambda rows: rows)
    monkeypatch.setattr(MM, "run_search", lambda *args, **kw: asked.update(kw))
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    MM._search(spark, "", [{}])
    assert asked == {"folds": 5, "parallelism": 12}
    monkeypatch.undo()
    monkeypatch.setattr(B, "ROWS_ALONE", 100)
    rows, tasks, keep = _rows(spark, 800, 2).drop("features").withColumn("fold", (F.col("c") % 2).cast("int")), [], B.BoostedTrees._tasks
    monkeypatch.setattr(B.BoostedTrees, "_tasks", lambda self, points, n: tasks.append(keep(self, points, n)) or tasks[-1])
    found = run_search(rows, [{"max_iter": 2}], ML.gbt, str(tmp_path / "l"), list("abcde"), folds=2).collect()
    assert tasks == [1, 1] and found[0].folds == 2 and found[0].cv_auc_mean > 0.5
