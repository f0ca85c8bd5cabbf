import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaserisk.llm import whitening
from leaserisk.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, components=4):
    """[(vec_id, x)], n, sums, covariance (exact fractions rounded once), eigenvalues."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted(set(tuple(x) for _, x in kept))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) / n ** 3 for b in range(width)] for a in range(width)])
    return kept, n, s, v


def check(got, rows, components=4):
    kept, n, s, v = brute(rows)
    values = np.linalg.eigvalsh(v)[::-1][:components]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted(
        (i is None, i or 0, k + 1) for i, _ in kept for k in range(len(values)))
    deviation = {}
    for i, x in kept:
        deviation.setdefault(i, set()).add(sum((n * c - t) ** 2 for c, t in zip(x, s)))
    for r in got:
        assert r["n"] == n and r["deviation"] in deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-4, abs=1e-12)
        assert r["identity_error"] is None or r["identity_error"] <= 1e-4
    table = pd.DataFrame([r.asDict() for r in got]).dropna(subset=["vec_id", "whitened"])
    x = {i: np.array(x) for i, x in kept}
    for k, part in table.groupby("component"):
        # The component's axis by regression; its length and direction follow from the covariance.
        part = part.drop_duplicates("vec_id")
        centred = np.stack([x[i] for i in part["vec_id"]]) - np.array(s) / n
        axis = np.linalg.lstsq(centred, part["whitened"].to_numpy(), rcond=None)[0]
        axis = v @ axis / values[k - 1]  # the part in the eigenspace
        assert axis @ v @ axis == pytest.approx(1, rel=1e-6)
        assert np.allclose(centred @ axis, part["whitened"], atol=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.integers(1, 140), st.sampled_from([1, 300, 1 << 40, (1 << 63) - 1]), st.integers(0, 1 << 30))
def test_scatter_is_exact(width, rows, most, seed):
    rnd = random.Random(seed)
    x = np.array([[rnd.randint(-most - 1, most) for _ in range(width)] for _ in range(rows)], np.int64)
    sums, products = whitening.scatter(x)
    exact = x.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (products == exact.T @ exact).all()


def test_odd_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1 + k) for k in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] * 3), (302, [math.nan] * 6), (303, [math.inf] + [0.0] * 5), (None, [0.5] * 6),
             (304, rows[3][1]), (305, rows[3][1]), (306, []), (307, [1.0, 2.0])] + [(308, rows[7][1])] * 50
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit(1) for c in ("x", "n", "k", "component", "whitened")})
    check(whitening.whiten(docs).collect(), rows)


def test_few_dimensions_and_no_variance(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    rows = [(i, [float(i), float(-i)]) for i in range(20)]
    got = whitening.whiten(make(rows)).collect()
    check(got, rows)
    assert {r["component"] for r in got} == {1, 2} and {r["whitened"] for r in got if r["component"] == 2} == {None}
    got = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    for none in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(make(none)).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [1e14 * i, 1.0]) for i in range(3)] + [(9, [1e30, -1e30])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(got) == 8 and {r["deviation"] for r in got} == {None}


def test_query_over_the_whole_table(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op12_embedding_whitening"](spark, SF_SMALL).collect()
    check(got, rows)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-4
