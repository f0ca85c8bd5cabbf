"""Model invariants (the reference's model tests) on a 1000-row fixture with
its label rule; absent feature columns take their defaults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaserisk.operators import features as FE
from leaserisk.operators import ml as ML


@pytest.fixture(scope="module")
def fixture_frame(spark):
    rng = np.random.default_rng(42)
    n = 1000
    cols = {
        "avg_days_late": rng.uniform(0, 15, n), "payment_count": rng.integers(6, 36, n),
        "tenure_months": rng.integers(1, 60, n), "monthly_rent": rng.uniform(1500, 3500, n),
        "property_age": rng.integers(5, 50, n), "condition_rating": rng.integers(1, 6, n),
        "complaint_count": rng.integers(0, 5, n)}
    label = ((cols["avg_days_late"] > 5) & (cols["complaint_count"] > 1)) | (cols["condition_rating"] < 3)
    rows = [(i, float(cols["avg_days_late"][i]), int(cols["payment_count"][i]), int(cols["tenure_months"][i]),
             float(cols["monthly_rent"][i]), 1999 - int(cols["property_age"][i]), int(cols["condition_rating"][i]),
             int(cols["complaint_count"][i]), float(label[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "lease_id long, avg_days_late double, payment_count long, tenure_months int, "
                                     "monthly_rent double, year_built int, condition_rating int, "
                                     "complaint_count int, label double")
    fm = FE.feature_matrix(df, keys=("lease_id", "label"))
    return ML.split(fm)


@pytest.fixture(scope="module")
def trained(spark, fixture_frame):
    train = fixture_frame.filter("split = 'train'")
    test = fixture_frame.filter("split = 'test'")
    fp, tr, te = ML.prepare(train, test)
    tr = ML.class_weight_col(tr)
    model, secs = ML.fit(ML.gbt(15), tr)
    return fp, model, tr, te


def test_training_and_metric_ranges(trained):
    fp, model, tr, te = trained
    m = ML.metrics(ML.predict(model, te))
    for k in ("auc", "accuracy", "precision", "recall", "f1", "specificity"):
        assert 0.0 <= m[k] <= 1.0
    assert m["auc"] > 0.8  # the label is a rule over the inputs


def test_prediction_ranges(trained):
    fp, model, tr, te = trained
    p = ML.predict(model, te)
    bad = p.filter(~F.col("churn_probability").between(0, 1) | ~F.col("risk_score").between(0, 100)
                   | ~F.col("risk_level").isin("LOW", "MEDIUM", "HIGH") | ~F.col("prediction").isin(0.0, 1.0))
    assert bad.count() == 0
    from pyspark.ml.functions import vector_to_array
    s = p.select(F.aggregate(vector_to_array(F.col("probability")), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_importance_and_explanation(spark, trained):
    fp, model, tr, te = trained
    imp = ML.importances(model, spark)
    assert imp.count() == len(ML.MODEL_INPUTS)
    top = ML.top_importances(imp, 10).collect()
    assert len(top) == 10 and all(a.importance >= b.importance for a, b in zip(top, top[1:]))
    rows = [(r.feature, r.importance) for r in imp.collect()]
    ex = ML.explain(ML.predict(model, te), rows, 5)
    assert ex.select(F.size("explanation").alias("n")).distinct().first().n == 5


def test_save_load_roundtrip(spark, trained, tmp_path):
    from pyspark.ml import PipelineModel
    fp, model, tr, te = trained
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a = {r.lease_id: r.churn_probability for r in ML.predict(model, te).collect()}
    b = {r.lease_id: r.churn_probability for r in ML.predict(loaded, te).collect()}
    assert a == b
    again = type(fp).from_json(fp.to_json())
    assert again.impute == fp.impute and again.encode == fp.encode


def test_one_row_scores_like_the_batch(trained):
    """Q8: frozen statistics -> scoring a row alone equals scoring it in a batch."""
    fp, model, tr, te = trained
    raw_one = te.limit(1)
    lid = raw_one.first().lease_id
    batch = {r.lease_id: r.churn_probability for r in ML.predict(model, te).collect()}
    one = ML.predict(model, te.filter(F.col("lease_id") == lid)).first()
    assert one.churn_probability == batch[lid]


def test_registry_lists_and_loads_versions(spark, trained, tmp_path):
    import datetime as dt

    from leaserisk.operators import registry as REG

    fp, model, tr, te = trained
    root = str(tmp_path)
    assert REG.versions(spark, root).collect() == []
    with pytest.raises(KeyError):
        REG.load_version(spark, root)
    small, _ = ML.fit(ML.gbt(2), tr)
    for version, day, m in (("v1", 1, small), ("v2", 5, model), ("v3", 3, small), ("v1", 2, small)):
        REG.save_version(root, version, m, fp, ML.importances(m, spark), trained_at=dt.datetime(1999, 1, day), training_samples=800,
                         auc=0.9, accuracy=0.8, features=ML.MODEL_INPUTS, config={"max_iter": 2})
    rows = {r.model_version: r for r in REG.versions(spark, root).collect()}
    assert sorted(rows) == ["v1", "v2", "v3"] and rows["v1"].trained_at == dt.datetime(1999, 1, 2)
    assert rows["v2"].model_type == "GBTClassificationModel" and rows["v2"].feature_count == len(ML.MODEL_INPUTS)
    name, latest, prep, imp = REG.load_version(spark, root)
    assert name == "v2" and latest.stages[-1].getNumTrees == 15 and imp.count() == len(ML.MODEL_INPUTS) and prep.impute == fp.impute
    assert REG.load_version(spark, root, "v3")[1].stages[-1].getNumTrees == 2
    with pytest.raises(KeyError):
        REG.load_version(spark, root, "v9")


def test_search_equals_a_plain_cross_validator_and_resumes(trained, tmp_path, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from leaserisk.operators import search as SE

    fp, model, tr, te = trained
    rows = SE.with_folds(tr, 3)
    share = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()
    assert sorted(r.fold for r in share) == [0, 1, 2]
    assert max(r.n for r in share) - min(r.n for r in share) <= 4 and max(r.pos for r in share) - min(r.pos for r in share) <= 2
    make = lambda reg: LogisticRegression(labelCol="label", featuresCol="features", maxIter=5, regParam=reg)
    points, ledger, fits = [{"reg": 0.01}, {"reg": 0.5}], str(tmp_path / "ledger"), []

    def stops(reg):
        if len(fits) == 4:
            raise KeyboardInterrupt
        fits.append(reg)
        return make(reg)

    with pytest.raises(KeyboardInterrupt):
        SE.run_search(rows, points, stops, ledger, ML.MODEL_INPUTS, folds=3, parallelism=1)
    again = []
    got = {r.point: r for r in SE.run_search(rows, points, lambda reg: (again.append(reg), make(reg))[1], ledger, ML.MODEL_INPUTS,
                                             folds=3, parallelism=3).collect()}
    assert len(fits) == 4 and len(again) == 2
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=5)
    plain = CrossValidator(estimator=Pipeline(stages=[ML.assembler(), lr]), numFolds=3, foldCol="fold",
                           estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.5]).build(),
                           evaluator=BinaryClassificationEvaluator(labelCol="label", numBins=0)).fit(rows)
    want = dict(zip(('{"reg": 0.01}', '{"reg": 0.5}'), zip(plain.avgMetrics, plain.stdMetrics)))
    for point, (mean, std) in want.items():
        assert got[point].folds == 3 and got[point].cv_auc_mean == pytest.approx(mean) and got[point].cv_auc_std == pytest.approx(std)
    other = []  # other rows take no results of these
    SE.run_search(rows.filter("lease_id > 5"), points[:1], lambda reg: (other.append(reg), make(reg))[1], ledger, ML.MODEL_INPUTS, folds=3)
    assert len(other) == 3


def test_permutation_importance_equals_brute_force(spark):
    import random

    from leaserisk.operators.permutation import permutation_importance

    rnd = random.Random(4)
    data = [(i, rnd.random(), float(rnd.randint(0, 3)), 1.0) for i in range(400)]
    data = [(i, a, b, c, float(a + 0.1 * b + rnd.gauss(0, 0.2) > 0.7)) for i, a, b, c in data]
    rows = spark.createDataFrame(data + [(None, 1.0, 1.0, 1.0, 1.0), (900, 1.0, 1.0, 1.0, None)], "k long, a double, b double, c double, label double")
    score = lambda df: df.withColumn("score", (F.col("features")[0] + 0.1 * F.col("features")[1] + 0 * F.col("features")[2]) / 2)
    run = lambda seed: {r.feature: r for r in permutation_importance(rows, "k", ["a", "b", "c"], score, seed=seed, cells=7).collect()}
    got = run(3)
    assert got == run(3) and got != run(4)
    hashes = {r.k: r for r in rows.filter("k < 900").select(
        "k", F.pmod(F.xxhash64("k", F.lit(3), F.lit("cell")), F.lit(7)).alias("cell"), F.xxhash64("k", F.lit(3), F.lit("row")).alias("row"),
        *[F.xxhash64("k", F.lit(3), F.lit(i)).alias(f"v{i}") for i in range(3)]).collect()}

    def auc(pairs):
        pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    binned = lambda a, b: int(min((a + 0.1 * b + 0 * 1) / 2 * 10000, 9999))
    base = auc([(binned(a, b), y) for _, a, b, _, y in data])
    for i, name in enumerate("abc"):
        permuted = []
        for cell in range(7):
            own = [d for d in data if hashes[d[0]].cell == cell]
            values = [d[i + 1] for d in sorted(own, key=lambda d: hashes[d[0]][f"v{i}"])]
            for d, v in zip(sorted(own, key=lambda d: hashes[d[0]].row), values):
                x = list(d[1:4])
                x[i] = v
                permuted.append((binned(x[0], x[1]), d[4]))
        assert got[name].auc == pytest.approx(base) and got[name].permuted_auc == pytest.approx(auc(permuted))
    assert got["c"].drop == 0 and got["a"].drop > got["b"].drop > 0
    none = permutation_importance(rows.filter("label = 1"), "k", ["a"], lambda df: df.withColumn("score", F.lit(0.5)))
    assert none.first().drop is None


def test_early_stopping_with_validation_column(trained):
    fp, model, tr, te = trained
    v = tr.withColumn("is_val", F.pmod(F.col("lease_id"), F.lit(5)) == 0)
    m, _ = ML.fit(ML.gbt(40, validation_col="is_val", validation_tol=0.5), v)
    assert m.stages[-1].getNumTrees <= 40


def test_registered_models_train_the_library_defaults(spark, monkeypatch):
    from leaserisk.plans import ml_models as MM

    fits, searches = [], []

    def run_search(rows, points, estimator, ledger, features, folds, parallelism):
        searches.append((estimator(**points[-1]), folds, len({str(p) for p in points})))
        return spark.createDataFrame([("{}", folds, 0.5, 0.0)], "point string, folds int, cv_auc_mean double, cv_auc_std double")

    monkeypatch.setattr(MM, "_CACHE", {})
    monkeypatch.setattr(MM, "table_files", lambda spark, sf: ())
    monkeypatch.setattr(MM, "_prepared", lambda spark, sf: (None, None, None))
    monkeypatch.setattr(MM, "with_folds", lambda rows: rows)
    monkeypatch.setattr(ML, "fit", lambda est, train: fits.append(est) or (est, 1.0))
    monkeypatch.setattr(ML, "predict", lambda model, rows: None)
    monkeypatch.setattr(ML, "metrics", lambda p: dict(auc=0.5, accuracy=0.5, precision=0.5, recall=0.5, f1=0.5))
    monkeypatch.setattr(MM, "run_search", run_search)
    assert MM._model(spark, "", "gbt")[0].getMaxIter() == 200
    assert MM._model(spark, "", "random_forest")[0].getNumTrees() == 500
    assert MM.m10(spark, "").count() == 3 and len(fits) == 3  # two of them are the fits above
    MM.m11(spark, ""), MM.m12(spark, "")
    assert [(e.getMaxIter(), e.getMaxDepth(), folds, n) for e, folds, n in searches] == [(200, 6, 5, 1), (300, 8, 5, 243)]


def test_new_files_make_new_models(spark, monkeypatch):
    from leaserisk.plans import ml_models as MM

    state, gone = [1], []
    monkeypatch.setattr(MM, "_CACHE", {})
    monkeypatch.setattr(MM, "table_files", lambda spark, sf: state[0])

    class Frame:
        def unpersist(self):
            gone.append(self)

    rows = lambda: MM._cached(spark, "x", "rows", lambda: (None, Frame(), Frame()))
    first = rows()
    assert rows() is first and not gone
    state[0] = 2
    assert rows() is not first and gone == list(first[1:])


def test_logistic_probability_and_attribution_equal_the_formula(trained):
    fp, _, tr, te = trained
    model, _ = ML.fit(ML.logistic(), tr)
    last = model.stages[-1]
    coef, rows = last.coefficients.toArray(), ML.predict(model, te)
    means = tr.agg(*[F.avg(c).alias(c) for c in ML.MODEL_INPUTS]).first().asDict()
    got = ML.linear_attribution(model, means, rows, 5).select("churn_probability", "attribution", *ML.MODEL_INPUTS).collect()
    assert got
    for r in got:
        x = np.array([float(r[c]) for c in ML.MODEL_INPUTS])
        assert r.churn_probability == pytest.approx(1 / (1 + np.exp(-(x @ coef + last.intercept))), abs=1e-9)
        part = coef * (x - np.array([means[c] for c in ML.MODEL_INPUTS]))
        assert [abs(a.contribution) for a in r.attribution] == pytest.approx(sorted(abs(part), reverse=True)[:5], abs=1e-9)
        for a in r.attribution:
            assert a.contribution == pytest.approx(part[ML.MODEL_INPUTS.index(a.feature)], abs=1e-9)


def _pairs_auc(rows):
    low = lambda s: -np.inf if s is None else s
    pos, neg = [low(s) for s, y in rows if y == 1], [low(s) for s, y in rows if y == 0]
    won = sum((p > n) + .5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg)) if pos and neg else 0.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_auc_and_roc_of_any_scores_equal_all_pairs(spark, ranges):
    from leaserisk.operators import evaluate as EV

    rng = np.random.default_rng(3)
    # A third of the rows share one score; the others are all over the numbers, one in ten null.
    rows = [(0.25 if i % 3 == 0 else None if i % 10 == 1 else float(rng.normal()) * 10.0 ** int(rng.integers(-6, 6)), int(rng.random() < .3))
            for i in range(300)]
    df = spark.createDataFrame(rows, "risk_score double, churned int")
    r = EV.auc(df, ranges=ranges).first()
    assert (r.positives, r.negatives) == (sum(y for _, y in rows), sum(1 - y for _, y in rows))
    assert r.auc == pytest.approx(_pairs_auc(rows), abs=1e-6)
    low = lambda s: -np.inf if s is None else s
    points = EV.roc_points(df, ranges=ranges).collect()
    assert len(points) == len({s for s, _ in rows})
    for p in points:
        assert p.tpr == pytest.approx(np.mean([low(s) >= low(p.threshold) for s, y in rows if y]), abs=1e-6)
        assert p.fpr == pytest.approx(np.mean([low(s) >= low(p.threshold) for s, y in rows if not y]), abs=1e-6)


def test_auc_without_ranges_takes_whole_scores_alone(spark):
    from leaserisk.operators import evaluate as EV

    rows = [(int(s), int(s) % 3 == 0) for s in np.random.default_rng(4).integers(0, 101, 200)] + [(None, True), (None, False)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "risk_score int, churned int")
    assert EV.auc(df).first().auc == pytest.approx(_pairs_auc(rows), abs=1e-6) == EV.auc(df, ranges=5).first().auc
    assert sorted(map(tuple, EV.roc_points(df).collect()), key=str) == sorted(map(tuple, EV.roc_points(df, ranges=5).collect()), key=str)
    for wrong in (101, -1, 0.5):
        with pytest.raises(Exception, match="whole"):
            EV.auc(spark.createDataFrame([(float(wrong), 1), (1.0, 0)], "risk_score double, churned int")).collect()


def test_auc_counts_more_pairs_than_a_long_holds(spark):
    from leaserisk.operators import evaluate as EV

    many = spark.createDataFrame([(10, 0, 4 * 10 ** 9), (20, 4 * 10 ** 9, 0)], "score int, pos long, neg long")
    sc = EV.with_below(many)
    assert sc.filter("score = 20").first().neg_below == 4 * 10 ** 9
    one = spark.createDataFrame([(1, 0.5, 1), (1, 0.2, 0), (2, 0.5, 1)], "g int, s double, label int")
    assert {r.g: r.auc for r in EV.grouped_auc(one, "g", "s").collect()} == {1: 1.0, 2: None}


@pytest.fixture(scope="module")
def small_rows(spark, tmp_path_factory):
    """One stored file, so every fit reads the rows in the same order (subsampling goes by it)."""
    import random

    rnd, path = random.Random(3), str(tmp_path_factory.mktemp("rows") / "rows")
    data = [(rnd.random(), float(rnd.randint(0, 9)), rnd.gauss(0, 1)) for _ in range(400)]
    rows = [(*x, float(x[0] + 0.05 * x[1] + 0.5 * x[2] + rnd.gauss(0, 0.4) > 0.7), 1.0 + i % 3, i % 2) for i, x in enumerate(data)]
    spark.createDataFrame(rows, "x double, y double, z double, label double, weight double, fold int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_points_that_differ_in_trees_alone_are_one_fit(spark, small_rows, tmp_path):
    import json

    from leaserisk.operators import search as SE

    points = ML.grid_points({"max_depth": [2, 3], "step_size": [0.2], "max_iter": [6, 2, 4], "subsampling_rate": [0.7],
                             "feature_subset": ["0.7"]})
    fits = []

    def search(ledger, some):
        made = lambda **point: (fits.append(point["max_iter"]), ML.gbt(**point))[1]
        found = SE.run_search(small_rows, some, made, str(tmp_path / ledger), ["x", "y", "z"], folds=2).collect()
        assert len(found) == len(some) and {r.folds for r in found} == {2}
        kept = spark.read.parquet(str(tmp_path / ledger)).collect()
        assert {r.test_rows for r in kept} == {200}
        return {(p["max_depth"], p["max_iter"], r.fold): r.auc for r in kept for p in [json.loads(r.point)]}

    got = search("whole", points)
    assert len(got) == 12 and fits == [6] * 4
    search("begun", points[1:2])
    assert search("begun", points) == pytest.approx(got, abs=1e-12) and sorted(fits[4:]) == [2] * 2 + [6] * 4  # two had been done
    for i, point in enumerate(points):  # each as fits of its own
        own = search(f"own{i}", [point])
        assert own == pytest.approx({k: got[k] for k in own}, abs=1e-12) and fits[-2:] == [point["max_iter"]] * 2
    assert len(set(got.values())) > 6


def test_cut_model_is_the_smaller_fit(small_rows):
    from pyspark.ml import Pipeline

    fit = lambda n: Pipeline(stages=[ML.assembler(["x", "y", "z"]), ML.gbt(n)]).fit(small_rows)
    large, small = fit(12), fit(4)
    cut = ML.first_trees(large, 4)
    debug = lambda m: [t.toDebugString.partition("\n")[2] for t in m.stages[-1].trees]
    assert debug(cut) == debug(small) and cut.stages[-1].treeWeights == small.stages[-1].treeWeights
    out = lambda m: sorted(map(str, m.transform(small_rows).select("x", "rawPrediction", "probability", "prediction").collect()))
    assert out(cut) == out(small) and out(cut) != out(large)


def test_points_of_other_estimators_keep_their_own_fits(small_rows, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    from leaserisk.operators import search as SE

    fits = []
    made = lambda max_iter: (fits.append(max_iter), LogisticRegression(maxIter=max_iter))[1]
    assert SE.run_search(small_rows, [{"max_iter": n} for n in (3, 1)], made, str(tmp_path / "ledger"), ["x", "y", "z"], folds=2).count() == 2
    assert sorted(fits) == [1, 1, 3, 3]
    assert ML.has_prefixes(ML.gbt(3)) and not ML.has_prefixes(ML.gbt(3, validation_col="v"))
