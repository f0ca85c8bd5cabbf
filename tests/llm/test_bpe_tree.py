import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leaserisk.llm import bpe_tree
from leaserisk.llm.pretokens import PretokenCache
from leaserisk.llm.queries import TREE_VOCABULARY

from .rows import clashing, odd_texts, table
from .test_bpe_packing import SIGNS

PATH = public_tokenizers.path(TREE_VOCABULARY)
THEIRS = Tokenizer.from_file(PATH)
MINE = bpe_tree.tree_vocabulary(PATH)


def ids_of(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    ids, first = MINE.chunk_ids(PretokenCache(MINE.encode_words), np.frombuffer(b"".join(raw), np.uint8), at)
    return [ids[i:j].tolist() for i, j in zip(first, first[1:])]


def wanted(texts):
    return [THEIRS.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_unsplit_text_equals_the_tokenizer():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (1, 15, 16, 17, 31, 33, 64, 100, 1000, 5000)
             for letters in ("ab", "abc", "the", "etaoinshrdlu", "中文字符日本", "éàü", "z", "=-", "0123456789")]
    texts += [p * n for p in ("ab", "abc", "ha", "the", "Z", "an", "=", "中") for n in (7, 8, 9, 33, 1000, 4097)]
    assert ids_of(texts) == wanted(texts)


def test_random_signs_and_special_tokens_equal_the_tokenizer():
    rnd = random.Random(6)
    signs = [*SIGNS, "<|endoftext|>", "<|endoftext", "|>", "<"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|end", "oftext|>"]
    assert ids_of(texts) == wanted(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text_equals_the_tokenizer(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(texts) == wanted(texts)


@settings(max_examples=200, deadline=None)
@given(st.text("abtheinr", min_size=1, max_size=60), st.text("abtheinr", min_size=1, max_size=60))
def test_join_of_any_two_sides(a, b):
    (left, right), _ = zip(*(MINE.merge(MINE.byte_tokens[np.frombuffer(t.encode(), np.uint8)], np.array([len(t)])) for t in (a, b)))
    assert MINE.ids[MINE.join([(left, right)])[0]].tolist() == wanted([a + b])[0]


def test_most_joins_need_few_windows(monkeypatch):
    """A long word of random letters: joins re-encode a small part of it, not the sides."""
    rnd, seen = random.Random(7), []
    word = "".join(rnd.choice("etaoinshrdlucmfwyp") for _ in range(1 << 16)).encode()
    merge = MINE.merge
    monkeypatch.setattr(MINE, "merge", lambda tokens, size: (seen.append(len(tokens)), merge(tokens, size))[1])
    MINE.encode_words([word])
    assert seen[0] == len(word) and sum(seen[1:]) < 3 * len(word)


def test_a_long_run_of_one_letter_ends():
    assert ids_of(["z" * 300_000 + "y"]) == wanted(["z" * 300_000 + "y"])


def test_vocabularies_that_the_method_does_not_hold_for_are_refused(tmp_path):
    file = json.loads(open(PATH, encoding="utf-8").read())
    file["model"]["merges"] = [["a", "b"], ["ab", "c"], ["a", "bc"]]
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe_tree.TreeVocabulary(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        bpe_tree.TreeVocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_encode_decode_rows(spark):
    texts = odd_texts()
    got = bpe_tree.encode_decode(clashing(table(spark, texts, [None, *range(1, len(texts))])), PATH, with_ids=True).collect()
    assert len(got) == len(texts)
    for r, t in zip(sorted(got, key=lambda r: r["doc_id"] or 0), texts):
        want = THEIRS.encode(t or "", add_special_tokens=False).ids
        back = THEIRS.decode(want, skip_special_tokens=False)
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_tree.encode_decode(table(spark, []), PATH).collect() == []
    twice = bpe_tree.encode_decode(table(spark, ["a b"] * 3, [7] * 3), PATH).collect()
    assert len(twice) == 3 and len(set(twice)) == 1


def test_query_over_the_whole_table(spark):
    from leaserisk.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_tree_bpe"](spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = THEIRS.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]]["n_tokens"] == len(want)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
