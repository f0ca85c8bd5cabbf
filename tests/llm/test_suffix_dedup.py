import hashlib
import random

import numpy as np
import pytest

from leaserisk.llm import suffix_dedup as S

from .rows import clashing, odd_texts, prose, table


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def report(docs, length):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
            for r in S.dedup_report(docs, length).collect()]


def corpus():
    rnd = random.Random(11)
    passage, line = prose(rnd, 60), "the same line in every document, of some length, ends here."
    texts = odd_texts()
    for i in range(60):
        own = prose(rnd, rnd.randint(5, 80))
        if i % 3 == 0:
            own += passage + prose(rnd, 20)
        if i % 2 == 0:
            own = own[:50] + line + own[50:]
        texts.append(own)
    texts += [prose(rnd, 40) + "is " * 200, "is " * 300, "is " * 90 + prose(rnd, 10)]
    near = prose(rnd, 150).split(" ")
    for _ in range(20):
        own = list(near)
        for _ in range(3):
            own[rnd.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("most", [2000, 3])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_STRETCHES", most)  # 3: every common anchor is divided
    texts = corpus()
    got = sorted(report(table(spark, texts), 200))
    assert got == sorted((i, *w) for i, w in enumerate(brute(texts, 200)))


def test_null_ids_repeated_rows_extra_columns(spark):
    texts = odd_texts()
    texts += texts[5:8]
    ids = [None, None, *range(2, len(texts) - 3), 5, 5, 7]
    docs = clashing(table(spark, texts, ids))
    want = sorted((i is not None, i or 0, *w) for i, w in zip(ids, brute(texts, 200)))
    assert sorted((i is not None, i or 0, *r) for i, *r in report(docs, 200)) == want


def test_empty_table(spark):
    docs = table(spark, [])
    assert report(docs, 200) == []
    assert S.without_repeats(docs).collect() == []


def test_removed_texts_keep_columns_and_whole_characters(spark):
    rnd = random.Random(5)
    shared = "é" * 150  # 300 bytes, so a cut may fall inside a character
    texts = [prose(rnd, 30) + shared + prose(rnd, 30), shared[:-1] + "x" + prose(rnd, 20), None, "", prose(rnd, 50)]
    docs = clashing(table(spark, texts))
    out = {r["doc_id"]: r for r in S.without_repeats(docs).collect()}
    assert S.without_repeats(docs).columns == docs.columns
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == texts[4]
    assert len(out[0]["text"]) < len(texts[0]) and out[0]["n_chars"] == len(out[0]["text"])


def test_equal_strings_have_equal_anchors():
    rnd = np.random.default_rng(2)
    shared = rnd.integers(97, 101, 400).astype(np.uint8)
    a, b = (np.concatenate([rnd.integers(97, 101, n).astype(np.uint8), shared, rnd.integers(97, 101, 70).astype(np.uint8)]) for n in (33, 301))
    owners = []
    for data, shift in ((a, 33), (b, 301)):
        _, start, strings, before, anchor, _ = S.stretches(data, np.array([0, len(data)]))
        place = {}
        for s, n, p, h in zip(start, strings, before, anchor):
            for i in range(s, s + n):
                place[i - shift] = (s + p - i, h)
        owners.append(place)
    assert all(owners[0][i] == owners[1][i] for i in range(201))


def test_merge_sorts_the_union_and_finds_common_prefixes():
    """The merged order equals a sort of all suffixes by their first symbols."""
    rnd = np.random.default_rng(7)
    strings = [rnd.integers(97, 99, rnd.integers(8, 40)).astype(np.uint8) for _ in range(24)]
    shards = []
    for lo in range(0, 24, 8):
        own = strings[lo:lo + 8]
        shards.append((np.concatenate(own), np.concatenate(([0], np.cumsum([len(s) for s in own])))))
    width, depth = 2, 4
    parts = [S.block_symbols(d, at, width) for d, at in shards]
    alphabet, ranks = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
    ranks = np.split(ranks.astype(np.uint32), np.cumsum([len(s) for s, _ in parts])[:-1])
    built = [S.shard_transform(r, b, depth) for r, (_, b) in zip(ranks, parts)]
    interleave, common = S.merge_transforms([t for _, t in built], depth)

    def symbols(shard, position):
        after = np.empty(len(parts[shard][1]), np.int64)
        after[parts[shard][1]] = np.arange(len(after))
        out = []
        for _ in range(depth):
            out.append(int(ranks[shard][position]))
            position = after[position]
        return tuple(out)

    cursor, merged = [0] * len(shards), []
    for shard in interleave:
        merged.append(symbols(shard, built[shard][0][cursor[shard]]))
        cursor[shard] += 1
    assert merged == sorted(merged)
    for a, b, c in zip(merged, merged[1:], common[1:]):
        assert c == next((i for i in range(depth) if a[i] != b[i]), depth)
    found = S.repeated_strings(shards, 8, 2)
    where = {}
    for s, (data, at) in enumerate(shards):
        for i in range(len(at) - 1):
            for j in range(at[i], at[i + 1] - 7):
                where.setdefault(bytes(data[j:j + 8]), []).append((s, j + i))
    for s, flag in enumerate(found):
        assert set(np.flatnonzero(flag)) == {p for ps in where.values() if len(ps) > 1 for t, p in ps if t == s}


@pytest.mark.parametrize("fails", [False, True])
def test_tables_of_a_run_are_deleted(spark, monkeypatch, tmp_path, fails):
    from leaserisk.llm import text as T

    monkeypatch.setattr(T, "scratch_path", lambda _, name: f"{tmp_path}/{name}-{rnd.random()}")
    rnd = random.Random(3)
    if fails:
        monkeypatch.setattr(S, "compare", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            S.repeated(S._keyed(table(spark, corpus()), "doc_id", "text"))
    else:
        assert S.repeated(S._keyed(table(spark, corpus()), "doc_id", "text")).count()
    assert [p.name.split("-")[0] for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["repeats"] * (not fails)


def test_one_row_written_many_times_is_cut_once(spark):
    rnd = random.Random(9)
    text = prose(rnd, 100)
    texts = [text] * 50 + [text + prose(rnd, 60), prose(rnd, 50) + text]
    ids = [4] * 50 + [5, 6]
    want = sorted((i, *w) for i, w in zip(ids, brute(texts, 200)))
    assert sorted(report(table(spark, texts, ids).repartition(1), 200)) == want
