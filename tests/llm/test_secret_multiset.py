import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leaserisk.llm import multiset_hash as M
from leaserisk.llm import secret_scan as S
from leaserisk.llm.queries import SCAN_VOCABULARY

from .rows import clashing, odd_texts, prose, table

PATH = public_tokenizers.path(SCAN_VOCABULARY)
RANDOM = "q7Zk2XpW9vB4nR8tLm3YcJ6d"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    told = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(told.encode()).hexdigest()


def secret_texts():
    rnd = random.Random(6)
    bits = ["password = hunter2secret", "Token:abc", 'api_key="abcdefgh"', "APIKEY=ab", "token=token=abcdef", "secret:  'x.y-z/+='", "é" * 3,
            "AKIA" + "A1" * 8, "AKIA" + "B2" * 7, "AKIAakia", "0123456789abcdef" * 2, "f" * 23, "f" * 24, "ſecret=longenough", "passwd : zzzzzz",
            "deadbeef" * 4, "\n", "  ", "paſſword=abcdefgh", "toKen=abcdefgh"]
    texts = ["".join(rnd.choice(bits + [prose(rnd, 3)]) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    return odd_texts() + texts + [prose(rnd, 400) + " password=lastsecret"]


def test_base_spans_equal_brute_force(spark):
    texts = secret_texts()
    got = S.scan(clashing(table(spark, texts)), PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert ((r["n_assign"], r["n_access"], r["n_hex"]), r["base_sha256"]) == brute(t), t
        base = ",".join(s for s in r["spans"].split(",") if s and not s.startswith("random"))
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
    assert S.scan(table(spark, []), PATH).collect() == []


def test_random_strings_are_found_and_digests_identifiers_and_prose_are_not():
    assert S.is_random(RANDOM.encode(), PATH) and S.is_random((RANDOM * 200).encode(), PATH)
    for clean in (hashlib.md5(b"x").hexdigest(), hashlib.sha1(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest().upper(),
                  "123e4567-e89b-12d3-a456-426614174000", "1234567890" * 3, "internationalisation", "version_2_of_the_document_store"):
        assert not S.is_random(clean.encode(), PATH), clean


def test_random_runs_of_letters_alone_and_of_16_characters_are_found(spark):
    rnd = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for signs, n, least in ((letters, 20, 190), (letters, 40, 190), (letters[:26], 20, 190), (letters, 16, 190),
                            (letters + "0123456789", 16, 190), (letters[26:], 32, 185)):
        assert sum(S.is_random("".join(rnd.choices(signs, k=n)).encode(), PATH) for _ in range(200)) >= least, (signs, n)
    words = ["counterrevolutionary", "Rechtsschutzversicherungsgesellschaften", "mempertanggungjawabkan", "RESPONSIBILITIES",
             "konstantinopolitanczykowianeczka", "AbstractSingletonProxyFactoryBean", "MAX_CONCURRENT_REQUESTS", "src/components/button-group",
             "windows-10-update", "covid19-vaccination", "x" * 24, "ha" * 10, "2024-01-01-12-30-00", "=" * 20]
    assert [w for w in words if S.is_random(w.encode(), PATH)] == []
    planted = ["qZkXpWvBnRtLmYcJdHsG", "kQ9zX2vW7pL4mT8r"]
    got = S.scan(table(spark, [f"key {p} end" for p in planted] + [" ".join(words)]), PATH).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {0: "random:4:24", 1: "random:4:20", 2: ""}


def test_redaction_covers_spans_and_leaves_the_rest(spark):
    texts = ["é before password=abcdefgh after", f"a {RANDOM} b", "clean text", None, "", "key " + "deadbeef" * 3 + "!", "token=" + "f" * 30]
    docs = clashing(table(spark, texts))
    out = S.redacted(docs, PATH)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["text"] for i in range(7)] == ["é before [SECRET] after", "a [SECRET] b", "clean text", None, "", "key [SECRET]!", "[SECRET]"]
    assert got[0]["n_chars"] == len(got[0]["text"]) and got[2]["n_chars"] == 10
    assert S.redacted(table(spark, []), PATH).collect() == []


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["f"] for r in df.select("i", M.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]


def test_order_free_equality_insertion_and_deletion(spark):
    rnd = random.Random(9)
    a, b, c = ("\n".join(prose(rnd, 15).replace("\n", " ") for _ in range(n)) for n in (5, 7, 3))
    fa, fb, fab, fba, fc, empty = prints(spark, [a, b, a + "\n" + b, b + "\n\n" + a, c, ""])
    assert fab == fba != fa and empty == [0] * (M.LONGS + 1) and len({tuple(x) for x in (fa, fb, fc)}) == 3
    row = spark.createDataFrame([(fa, fb, fab)], "a array<long>, b array<long>, ab array<long>").select(
        M.insert(F.col("a"), F.col("b")).alias("sum"), M.remove(F.col("ab"), F.col("b")).alias("rest"),
        M.likeness(F.col("a"), F.col("a")).alias("one"), M.likeness(F.col("a"), F.col("b")).alias("far"),
        M.likeness(F.col("a"), F.col("ab")).alias("part")).first()
    assert row["sum"] == fab and row["rest"] == fa and row["one"] == 1.0
    assert row["far"] < 0.3 < row["part"] < 1


def test_lanes_wrap_without_touching_their_neighbours(spark):
    full = [M._MASK] * M.LONGS + [5]
    row = spark.createDataFrame([(full, [M._ONE] * M.LONGS + [1])], "a array<long>, b array<long>").select(
        M.insert(F.col("a"), F.col("b")).alias("x"), M.remove(M.insert(F.col("a"), F.col("b")), F.col("b")).alias("y")).first()
    assert row["x"] == [0] * M.LONGS + [6] and row["y"] == full


def check_edits(spark, texts, ids):
    got = M.fingerprint_edits(clashing(table(spark, texts, ids))).collect()
    assert len(got) == len(texts)
    return got


def test_edits_follow_the_order_of_ids(spark):
    texts = odd_texts()
    rnd = random.Random(1)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    ids = [1000 * i for i in order]
    by_id = [t or "" for _, t in sorted(zip(ids, texts), key=lambda x: x[0])]
    want = {}
    for k, t in enumerate(by_id):
        n = len(t) // 4
        want[1000 * k] = (len(t), hashlib.sha256((t[:len(t) - n] + by_id[(k + 1) % len(by_id)][:n]).encode()).hexdigest())
    got = check_edits(spark, texts, ids)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    by_text = {}
    for r in got:
        by_text.setdefault(by_id[r["doc_id"] // 1000], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())


def test_null_ids_and_rows_that_repeat(spark):
    rnd = random.Random(3)
    texts = [prose(rnd, 30) for _ in range(20)]
    got = check_edits(spark, texts + texts[:5] + ["alone", None, None], [None] * 10 + list(range(10)) + [None] * 5 + [50, None, 3])
    assert len({(r["doc_id"], r["edited_sha256"]) for r in got}) == 23
    assert M.fingerprint_edits(table(spark, [])).collect() == []
    one = M.fingerprint_edits(table(spark, ["abcdefgh"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


@pytest.fixture
def ranges(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "49"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_ranges_hold_like_numbers_of_rows_whatever_the_ids(spark, ranges, monkeypatch):
    """One far id, and ids that are null or all alike for many rows."""
    seen = []
    monkeypatch.setattr(M, "stored", lambda df, _: (seen.append(df.checkpoint()), seen[-1])[1])
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") == 1, 10**15).when(F.col("id") % 3 == 1, 5)
                                      .otherwise(F.col("id")).alias("doc_id"), F.xxhash64("id").alias("a"), F.lit(1).cast("long").alias("b"))
    assert M.next_keys(rows).count() == 20_000
    sizes = [r["count"] for r in seen[0].groupBy("range").count().collect()]
    assert len(sizes) >= 40 and max(sizes) < 2_000


def test_two_million_pieces(spark):
    """Over 2**20 different pieces: as many lanes wrap as count more, and likeness is still that of the texts."""
    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(2_200_000)), lambda i: F.hex(i)))
    half = F.concat_ws("\n", F.transform(F.sequence(F.lit(1_100_000), F.lit(3_300_000)), lambda i: F.hex(i)))
    row = spark.range(1).select(M.fingerprint(text).alias("a"), M.fingerprint(half).alias("b")).select(
        F.element_at("a", -1).alias("n"), M.likeness(F.col("a"), F.col("b")).alias("like"), M.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert row["n"] == 2_200_001 and 0.3 < row["like"] < 0.7 and row["same"] == 1


def test_next_keys_over_many_ranges(spark, ranges):
    rnd = random.Random(2)
    keys = sorted({(rnd.choice([None, rnd.randrange(-10**12, 10**12)]), rnd.randrange(-2**62, 2**62), 1) for _ in range(400)},
                  key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    got = {(r["a"], r["next_a"]) for r in M.next_keys(spark.createDataFrame(rnd.sample(keys, len(keys)), "doc_id long, a long, b long")).collect()}
    assert got == {(k[1], n[1]) for k, n in zip(keys, keys[1:] + keys[:1])}
