import random
import zlib

import numpy as np

from leaserisk.llm import quality_gam as Q

from .rows import clashing, odd_texts, prose, table


def corpus(n=240):
    rnd = random.Random(8)
    texts, good = [], []
    for i in range(n):
        kind, t = i % 6, prose(rnd, rnd.randint(20, 120))
        if kind == 0:
            t = " | ".join(t.split())
        elif kind == 1:
            t = " ".join([t.split()[0]] * 100)
        texts.append(t)
        good.append(int(kind > 1))
    return texts, good


def test_held_out_accuracy_and_rows(spark):
    texts, good = corpus()
    odd = odd_texts()
    docs = clashing(table(spark, texts + odd + texts[:2], [*range(len(texts)), None, *range(1000, 1000 + len(odd) - 1), 0, 1]))
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)] + [(None, 1, 0), (5, None, 0), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == docs.count()
    right, held = 0, 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            if r["held_out"] and r["doc_id"] < len(good):
                held += 1
                right += r["predicted"] == good[r["doc_id"]]
    assert held > 30 and right >= 0.95 * held
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_held_out_labels_teach_nothing(spark):
    texts, good = corpus(120)
    flipped = [(i, 1 - g if zlib.crc32(str(i).encode()) % 4 == 2 else g, 0) for i, g in enumerate(good)]
    docs, schema = table(spark, texts), "doc_id long, quality int, toxic int"
    a = Q.train(docs, spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], schema))
    b = Q.train(docs, spark.createDataFrame(flipped, schema))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_no_labels_reject_nothing_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, ["a", None, "b b b"])
    assert Q.accepted(docs, Q.train(docs, none)).count() == 3
    empty = table(spark, [])
    assert Q.score(empty, Q.train(empty, none)).collect() == []
    one = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    assert 0 < Q.score(docs, Q.train(docs, one)).first()["score"] < 1


def test_pairs_learn_what_single_features_cannot():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x, y)
    assert (0, 1) in [(i, j) for i, j, *_ in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_score_is_a_sum_of_table_entries():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 4))
    model = Q.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    row = x[7]
    total = model.intercept + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, row))
    total += sum(t[np.searchsorted(a, row[i], "right"), np.searchsorted(b, row[j], "right")] for i, j, a, b, t in model.pairs)
    assert abs(model.score(x)[7] - 1 / (1 + np.exp(-total))) < 1e-12
