import zlib
from collections import Counter, defaultdict

import numpy as np

from leaserisk.llm import ring_shards as R
from leaserisk.llm import topk as K

from .rows import clashing, odd_texts, table


def test_rows_law_slots_sizes(spark):
    texts = odd_texts() + [f"text {i}" for i in range(300)] + ["same"] * 40
    ids = [None, None, *range(len(texts) - 42), *[7] * 40]
    got = R.shard_rows(clashing(table(spark, texts, ids)), 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots[s]) for s in range(16)]
    assert max(n) - min(n) <= 1


def test_few_rows_and_none(spark):
    assert R.shard_rows(table(spark, [])).collect() == []
    assert sorted(r["slot"] for r in R.shard_rows(table(spark, ["a", "b", None])).collect()) == [0, 0, 0]


def test_most_rows_stay_when_rows_are_added(spark):
    texts = [f"text {i}" for i in range(2000)]
    first = {r["doc_id"]: r["shard"] for r in R.shard_rows(table(spark, texts)).collect()}
    second = {r["doc_id"]: r["shard"] for r in R.shard_rows(table(spark, texts + ["more"] * 100)).collect()}
    assert sum(first[i] != second[i] for i in first) < 500


def test_runs_hold_every_rank_once_and_overflow_goes_clockwise():
    rnd = np.random.default_rng(1)
    for shards, arcs in ((3, 7), (16, 200), (5, 5)):
        counts = rnd.integers(0, 40, arcs).tolist()
        owners = [i % shards for i in range(arcs)]
        runs = R.bounded_runs(counts, owners, shards)
        held, slots = defaultdict(list), defaultdict(list)
        for r in runs:
            held[r["arc"]] += range(r["lo"], r["hi"])
            slots[r["shard"]] += range(r["base"], r["base"] + r["hi"] - r["lo"])
        assert all(sorted(held[a]) == list(range(n)) for a, n in enumerate(counts))
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    # One arc over its owner's bound: the rest goes to the next point's shard.
    assert {(r["arc"], r["shard"]) for r in R.bounded_runs([4, 0, 0, 0], [0, 1, 2, 3], 4)} == {(0, 0), (0, 1), (0, 2), (0, 3)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_topk(rows, k):
    good = {}
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            w = [int(np.floor(64 * float(np.float32(x)))) for x in e]
            good[i] = min(good.get(i, w), w)
    out = set()
    for q, w in good.items():
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def exact(spark, rows, k=20):
    from pyspark.sql import functions as F

    v = K.quantised(vectors(spark, rows).withColumns({c: F.lit(1) for c in ("weights", "q", "c", "rank")}))
    return {tuple(r) for r in K.exact_topk(v, v.filter("vec_id % 20 = 0"), k).collect()}


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_ROWS", 4)
    monkeypatch.setattr(K, "CANDIDATE_ROWS", 30)
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(0, .3, 8) * (rnd.random(8) < .6)).tolist(), 0) for i in range(150)]
    rows += [(i, rows[3][1], 0) for i in range(150, 200)]  # ties
    rows += [(200, None, 0), (201, [1.0, None], 0), (202, [float("nan")] * 8, 0), (203, [float("inf")] * 8, 0), (None, [1.0] * 8, 0),
             (204, [], 0), (205, [.5], 0), (220, [-.01] * 8, 0), (3, rows[4][1], 0), (40, rows[40][1], 0)]
    assert exact(spark, rows) == brute_topk(rows, 20)


def test_topk_of_few_and_none(spark):
    assert exact(spark, []) == set()
    assert exact(spark, [(20, [1.0], 0)]) == set()
    assert exact(spark, [(20, [1.0], 0), (1, [2.0], 0)]) == {(20, 1, 1, 64 * 128)}


def test_sparse_and_dense_terms_accumulate_alike():
    rnd = np.random.default_rng(5)
    c = rnd.integers(-5, 6, (50, 12)) * (rnd.random((50, 12)) < np.linspace(.05, 1, 12))
    q = rnd.integers(-5, 6, (7, 12))
    assert (K.block_scores(q, K.postings(c), 50) == q @ c.T).all()


def test_query_equals_its_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    from leaserisk.llm.queries import ORACLES, QUERIES

    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(0, .3, 8).tolist(), 0) for i in range(60)]
    # The same row again (candidate, query, over k times), another vector under an id (candidate, query), both.
    rows += [rows[7], rows[40], *[(9, rows[9][1], 0)] * 30, (11, rows[12][1], 0), (11, rnd.normal(0, .9, 8).tolist(), 0),
             (20, rnd.normal(0, .3, 8).tolist(), 0), (0, rows[1][1], 0), (0, rows[1][1], 0), (61, None, 0)]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["op10_exact_topk"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert got == sorted(db.execute(ORACLES["op10_exact_topk"]).fetchall())


def test_blocks_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    assert K.block_rows(0, 100) == K.block_rows(8, 100) == 100
    for width in (1000, 5000, 10 ** 9):
        rows = K.block_rows(width, 10 ** 6)
        assert rows == 1 or rows * width * 8 <= K.BLOCK_BYTES
    monkeypatch.setattr(K, "BLOCK_BYTES", 8 * 8 * 7)  # seven rows a block
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(0, .3, 8).tolist(), 0) for i in range(90)]
    assert exact(spark, rows) == brute_topk(rows, 20)


def test_components_and_sums_beyond_a_long(spark):
    big = 2.0 ** 40
    # 64 * 1e30 is beyond a long; (64 * 2**40)**2 too, but the pair's sum is zero and partial sums wrap there and back.
    rows = [(20, [big, big], 0), (1, [big, -big], 0), (2, [1e30, -1e30], 0), (3, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r["weights"] for r in K.weighted(vectors(spark, rows)).collect()}
    assert got[2] == [2 ** 63 - 1, -2 ** 63] and got[20] == [2 ** 46] * 2
    score = {v: s for _, _, v, s in exact(spark, rows)}
    wrapped = (2 ** 46 * (2 ** 63 - 1) - 2 ** 46 * 2 ** 63 + 2 ** 63) % 2 ** 64 - 2 ** 63
    assert score == {1: 0, 2: wrapped, 3: 2 ** 46 * 192}
