import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaserisk.llm import importance
from leaserisk.llm.queries import QUERIES
from tests.conftest import SF_SMALL

from .rows import clashing, odd_texts, prose, table

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_features(text):
    w = brute_words(text)
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            into.update(map(bucket, brute_features(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: floor(1000 * log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, x in docs:
        f = brute_features(x)
        w = sum(gain(bucket(g)) for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), w, w + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(brute_words(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    most = percent * len(able) // 100
    return ([(*r[:4], n if n <= most else None) for n, r in enumerate(able, 1)] + [(*r[:4], None) for r in rows if not r[4]])


def key(r):
    return tuple((x is None, x or 0) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=40)), min_size=1, max_size=8))
def test_joined_crc(pairs):
    a, b = zip(*pairs)
    crc = lambda x: np.array([zlib.crc32(v) for v in x], np.uint32)
    got = importance.joined_crc(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]
    long = b"x" * 3_000_001
    assert importance.joined_crc(crc([b"y"]), crc([long]), np.array([len(long)])).tolist() == [zlib.crc32(b"y" + long)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB z0/\x00@[é中\n", max_size=25), max_size=6))
def test_runs_of_any_text(texts):
    words, found = importance.run_buckets(pa.array(texts, pa.string()))
    assert words.tolist() == [len(brute_words(t)) for t in texts]
    for n, (text, bucket) in enumerate(found, 1):
        want = [(i, zlib.crc32(" ".join(w[j:j + n]).encode()) % 10000)
                for i, t in enumerate(texts) for w in (brute_words(t),) for j in range(len(w) - n + 1)]
        assert list(zip(text.tolist(), bucket.tolist())) == want


def test_odd_rows(spark):
    import random

    rnd = random.Random(3)
    texts = odd_texts() + [prose(rnd, 60) for _ in range(40)] + [prose(rnd, 30)] * 20
    ids = [None, *range(1, len(texts) - 20), *[5] * 20]
    target = [prose(rnd, 50) for _ in range(5)] + [None, ""]
    got = importance.resample(clashing(table(spark, texts, ids)), table(spark, target).withColumn("n", F.lit(1)), percent=50)
    same(got.collect(), brute_resample(list(zip(ids, texts)), target, 50))
    same(importance.resample(table(spark, texts, ids), table(spark, [])).collect(), brute_resample(list(zip(ids, texts)), []))
    assert importance.resample(table(spark, []), table(spark, target)).collect() == []


def test_one_id_with_most_rows_is_ranked_in_many_ranges(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("score"),
                                    (F.col("id") % 256).alias("salt"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = importance.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc(), F.col("salt").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(r["rank"] for r in got) == list(range(1, 4001))
    assert [r["salt"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(r["salt"] for r in got)


def test_query_over_the_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, SF_SMALL).collect()
    same(got, brute_resample(docs, target))
    assert sum(r["rank"] is not None for r in got) > 5
