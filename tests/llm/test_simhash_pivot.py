import random
import re

import numpy as np
import xxhash

from leaserisk.llm import simhash_pivot as S
from leaserisk.llm.graph import connected_components

from .rows import clashing, odd_texts, prose, table


def brute_print(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def brute_components(prints, ids, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    out = []
    for i in range(len(prints)):
        own = [ids[j] for j in range(len(prints)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(own) if own else None)
    return out


def near_corpus():
    rnd = random.Random(4)
    texts = odd_texts()
    for _ in range(12):
        words = prose(rnd, 200).split(" ")
        for _ in range(6):
            own = list(words)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = "Other"
            texts.append(" ".join(own))
    return texts


def test_equals_brute_force(spark):
    texts = near_corpus()
    ids = [None, *range(1, len(texts) - 1), 5]
    got = S.near_duplicates(clashing(table(spark, texts, ids)), 4, 4).collect()
    prints = [brute_print(t) for t in texts]
    want = list(zip(ids, (f"{p:016x}" for p in prints), brute_components(prints, ids, 4)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=order) == sorted(want, key=order)


def test_one_of_each_group_stays(spark):
    texts = near_corpus()
    docs = clashing(table(spark, texts + texts[:1]))
    kept = S.one_per_group(docs, 4, 4)
    prints = [brute_print(t) for t in texts + texts[:1]]
    assert kept.columns == docs.columns
    assert {tuple(r)[5:] for r in kept.collect()} == {(7,) * (len(docs.columns) - 5)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(prints, range(len(prints)), 4)))
    same = table(spark, ["a b c d e"] * 3, [1, 1, 1])
    assert S.one_per_group(same, 4, 4).count() == 1


def test_empty_table(spark):
    assert S.near_duplicates(table(spark, [])).collect() == []
    assert S.one_per_group(table(spark, [])).collect() == []


def test_every_close_pair_shares_a_key():
    rnd = random.Random(1)
    for blocks in (5, 6, 8):
        masks = S.block_masks(4, blocks)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_links_under_keys_span_each_component():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in range(12)] + [base]))
    a, b = S.links_under_keys(fp, np.zeros(len(fp), np.uint64), 2)
    assert (np.bitwise_count(a ^ b) <= 24).all() and len(a) == len(fp) - 40


def test_pivots_never_discard_a_link():
    rnd = np.random.default_rng(8)
    a = rnd.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ np.uint64(0b10110001)
    assert (np.abs(S.pivot_table(a) - S.pivot_table(b)) <= 4).all()


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(500, 500), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 180)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_crowded_key_is_divided_without_losing_links(spark):
    rnd = random.Random(9)
    centre, prints = rnd.getrandbits(64), set()
    while len(prints) < 500:  # under most block keys together
        own = centre
        for b in rnd.sample(range(48), rnd.randint(0, 9)):
            own ^= 1 << b
        prints.add(own)
    prints |= {rnd.getrandbits(64) for _ in range(1000)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    keyed = S.keys_of(df, len(prints), 4)
    crowded = keyed.join(keyed.groupBy("choice", "block").count().filter("count > 40"), ["choice", "block"], "left_semi")
    groups = S.divided(crowded, 4, 40).groupBy("part").count().collect()
    assert crowded.count() > 500 and len(groups) > 50 and max(r["count"] for r in groups) < 200
    found = {r["node"]: r["root"] for r in S.link_components(df, len(prints), 4, most=40).collect()}
    plain = {r["node"]: r["root"] for r in S.link_components(df, len(prints), 4).collect()}
    want = brute_components(prints, signed, 4)
    assert found == plain and len(found) > 300
    same = lambda roots: {frozenset(p for p, r in zip(signed, roots) if r == x) for x in roots}
    assert same([found.get(p, p) for p in signed]) == same(want)
