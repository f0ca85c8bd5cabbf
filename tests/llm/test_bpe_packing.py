import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leaserisk.llm import bpe, packing
from leaserisk.llm.pretokens import PretokenCache, boundaries
from leaserisk.llm.queries import BPE_VOCABULARY, PACK_VOCABULARY

from .rows import clashing, odd_texts, table

PATH = public_tokenizers.path(BPE_VOCABULARY)
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
OWN = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SIGNS = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", "a", "É", "1", "²", "!", "|", " ", "　", "é",
         "中", "\U0001f600", "\x1c", "́", "'s", "'re", "don't", "'S", "\x85"]


def ids_of(texts, cache=None):
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(b) for b in raw]))).astype(np.int64)
    cache = cache or PretokenCache(bpe.vocabulary(PATH).encode_words)
    ids, first = cache.chunk_ids(np.frombuffer(b"".join(raw), np.uint8), at)
    return [ids[i:j].tolist() for i, j in zip(first[:-1], first[1:])]


def test_equals_tiktoken_on_random_signs():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 30))) for _ in range(8000)]
    texts += ["a" * 5000, "ab" * 300 + " x", "x" * 129, "x" * 128, "�" * 200]
    assert ids_of(texts) == [OWN.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_equals_tiktoken_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(texts) == [OWN.encode_ordinary(t) for t in texts]


def test_cache_starts_anew_when_full():
    rnd = random.Random(2)
    cache = PretokenCache(bpe.vocabulary(PATH).encode_words, most=50)
    for _ in range(20):
        texts = ["".join(rnd.choice("abcde ") for _ in range(100))]
        assert ids_of(texts, cache) == [OWN.encode_ordinary(texts[0])]


def test_boundaries_of_nothing():
    cuts, first = boundaries(np.zeros(0, np.uint8), np.zeros(4, np.int64))
    assert cuts.tolist() == [0] and first.tolist() == [0] * 4


def test_pair_table_finds_all_and_only_its_pairs():
    pairs = {(i, (7 * i) % 300): i for i in range(300)}
    found = bpe.PairTable(pairs)
    a, b = np.meshgrid(np.arange(300, dtype=np.int32), np.arange(300, dtype=np.int32))
    got = found.look_up(a, b)
    want = np.full_like(got, bpe.NONE)
    for (x, y), r in pairs.items():
        want[y, x] = r
    assert (got == want).all()


def test_encode_decode_rows(spark):
    texts = odd_texts()
    ids = [None, *range(1, len(texts))]
    got = bpe.encode_decode(clashing(table(spark, texts, ids)), PATH, with_ids=True).collect()
    assert len(got) == len(texts)
    for r, t in zip(sorted(got, key=lambda r: r["doc_id"] or 0), texts):
        want = OWN.encode_ordinary(t or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(table(spark, []), PATH).collect() == []


def brute_pieces(texts, length):
    tok = Tokenizer.from_file(public_tokenizers.path(PACK_VOCABULARY))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        lo, hi, piece = 0, len(ids) % length or length, 0
        while lo < len(ids):
            yield i, piece, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())
            lo, hi, piece = hi, hi + length, piece + 1


def valid_sequences(rows, length):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(held)


def test_packing_equals_the_tokenizer_and_fills_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 7)
    texts = odd_texts() + ["one two three"] * 40
    for length in (1024, 64):
        got = packing.pack(clashing(table(spark, texts)), public_tokenizers.path(PACK_VOCABULARY), length).collect()
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(brute_pieces(texts, length))
        n, total = valid_sequences(got, length), sum(r["length"] for r in got)
        assert n <= total // length + 2 + total // length // 10
    assert packing.pack(table(spark, []), public_tokenizers.path(PACK_VOCABULARY)).collect() == []


def test_rows_that_repeat_get_places_of_their_own(spark):
    got = packing.pack(table(spark, ["a b c"] * 30, [4] * 30), public_tokenizers.path(PACK_VOCABULARY), 16).collect()
    assert len(got) == 30 and valid_sequences(got, 16) == -(-sum(r["length"] for r in got) // 16)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50), max_size=25))
def test_plan_holds_every_piece_once(counts):
    groups = packing.plan(counts, 60)
    held = defaultdict(int)
    for n, holds in groups:
        assert n > 0 and sum(s * k for s, k in holds) <= 60
        assert sum(k for s, k in holds if 3 * s > 60) <= 2
        for s, k in holds:
            held[s] += n * k
    assert held == {s: n for s, n in counts.items() if n}
    least = max(-(-sum(s * n for s, n in counts.items()) // 60), sum(n for s, n in counts.items() if 2 * s > 60))
    assert sum(n for n, _ in groups) <= 1.5 * least + 1


def test_plan_matches_large_pieces_in_pairs():
    groups = packing.plan({600: 10, 424: 10, 341: 3}, 1024)
    assert sum(n for n, _ in groups) == 11


def test_cache_keeps_ids_over_16_bits():
    import numpy as np

    from leaserisk.llm.pretokens import PretokenCache

    ids = {b"small": 7, b" wide": 65_536 + 7, b" wider": 200_000}
    cache = PretokenCache(lambda words: (np.array([ids[w] for w in words]), np.arange(len(words)), np.ones(len(words), np.int64)))
    for text in (b"small", b"small wide wider", b"small"):
        got, _ = cache.chunk_ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert got.tolist() == [7, 65_543, 200_000][:text.count(b" ") + 1]


def test_every_code_point_is_split_as_the_libraries_split_it():
    """Each code point alone, between letters and before a contraction, in one text for each 4,096 of them."""
    single = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [form for c in single for form in (c, f"a{c}b", f"{c}'s")]
    ranks = bpe.vocabulary(PATH)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    path = public_tokenizers.path(PACK_VOCABULARY)
    other = Tokenizer.from_file(path)
    mine, second = PretokenCache(ranks.encode_words), PretokenCache(lambda words: packing._encode_words(path, words))
    for lo in range(0, len(texts), 1 << 16):
        part = texts[lo:lo + (1 << 16)]
        raw = [t.encode() for t in part]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        ids, first = mine.chunk_ids(data, at)
        want = [theirs.encode_ordinary(t) for t in part]
        assert ids.tolist() == [i for w in want for i in w] and np.diff(first).tolist() == list(map(len, want))
        ids, first = second.chunk_ids(data, at)
        want = [e.ids for e in other.encode_batch_fast(part, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and np.diff(first).tolist() == list(map(len, want))
