"""BPE encoding by tree concatenation, and its inverse, for byte-level vocabularies of the tokenizers library.

Text that the pre-tokenizer leaves unsplit is halved until its parts have at
most ``LEAF`` bytes.  All parts are encoded together; then neighbours are joined, level by
level, up the tree.  At a join only a window is encoded anew: the last tokens of
the left side with the first ones of the right.  The sides agree where the window's
encoding begins with the token that began it and ends with the one that ended it; until
then the window doubles on the side that does not agree, at most to that side's end.

Why this is exact.  A token sequence is the encoding of its bytes if every two
neighbours are the encoding of theirs.  Inside a side and inside the window that holds
already, and where a window agrees its outermost tokens are the ones whose
neighbours beyond the window they had before.  This needs a vocabulary in which each entry
comes from one merge and a merge uses only entries of earlier merges, as training makes
them; ``TreeVocabulary`` checks it and refuses others.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.bpe import NONE, PairTable
from leaserisk.llm.pretokens import PretokenCache
from leaserisk.llm.text import chunks, map_arrow, text_column

LEAF = 16
WINDOW = 2


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as GPT-2 fixed it:
    printable Latin-1 characters for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TreeVocabulary:
    """Vocabulary, merges and added tokens of a tokenizers file (byte-level BPE without normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"]
        plain = (model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
                 and not file["normalizer"] and not file["post_processor"] and not model.get("dropout")
                 and not model.get("ignore_merges") and not model.get("byte_fallback")
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]))
        if not plain:
            raise ValueError("a byte-level BPE without normaliser, prefix space, dropout or stripped added tokens is needed")
        names, vocab = _byte_names(), model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {c: -1 for c in names}
        for rank, (a, b) in enumerate(merges):
            if a + b in made or a not in made or b not in made:
                raise ValueError(f"merge {rank} is not of earlier entries to a new one")
            made[a + b] = rank
        # Ids by rank of their merge (bytes below 0): ranks name entries while they are merged.
        self.byte_tokens = np.zeros(256, np.int32)
        entries = sorted(names, key=names.get) + [a + b for a, b in merges]
        for place, entry in enumerate(entries[:256]):
            self.byte_tokens[names[entry]] = place
        place_of = {entry: i for i, entry in enumerate(entries)}
        self.pairs = PairTable({(place_of[a], place_of[b]): place_of[a + b] for a, b in merges})
        self.ids = np.array([vocab[e] for e in entries], np.int64)
        self.added = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        raw = [bytes(names[c] for c in e) for e in entries]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        by_id = dict(zip(self.ids.tolist(), raw)) | {i: t for t, i in self.added.items()}
        top = max(by_id) + 1
        self.id_sizes = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        self.id_starts = np.cumsum(self.id_sizes) - self.id_sizes
        self.id_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    # Entries are named by their places (bytes, then merges in order) up to ``encode_words``.

    def merge(self, tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of segments of byte tokens, one behind the other, and their sizes.

        Each round merges every segment's least pair wherever it stands, from the left; no pair
        that such a merge makes comes before it.
        """
        out, left = [None] * len(size), np.flatnonzero(size)
        for i in np.flatnonzero(size == 0):
            out[i] = tokens[:0]
        size = size[left]
        while len(left):
            start = np.cumsum(size) - size
            rank = np.full(len(tokens), NONE, np.int32)
            if len(tokens) > 1:
                rank[:-1] = self.pairs.look_up(tokens[:-1], tokens[1:])
            rank[start[1:] - 1] = NONE
            least = np.minimum.reduceat(rank, start)
            done = least == NONE
            if done.any():
                for i, a, n in zip(left[done].tolist(), start[done].tolist(), size[done].tolist()):
                    out[i] = tokens[a:a + n].copy()
                stay = np.repeat(~done, size)
                tokens, rank, left, least, size = tokens[stay], rank[stay], left[~done], least[~done], size[~done]
                if not len(left):
                    break
            hit = rank == np.repeat(least, size)
            # Neighbours that both begin the pair are a run of one token: every second one from the left merges.
            place = np.flatnonzero(hit)
            first = np.ones(len(place), bool)
            first[1:] = (place[1:] != place[:-1] + 1) | (rank[place[1:]] != rank[place[:-1]])
            run = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            tokens[place] = rank[place]
            keep = np.ones(len(tokens), bool)
            keep[place + 1] = False
            size = size - np.add.reduceat(~keep, np.cumsum(size) - size)
            tokens = tokens[keep]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else tokens[:0]), lengths

    def _bytes_of(self, tokens: np.ndarray) -> np.ndarray:
        n = self.sizes[tokens]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) - np.repeat(ends - n - self.starts[tokens], n)]

    def join(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The encoding of each left side's bytes with its right side's, from the encodings of both."""
        out: list = [None] * len(sides)
        open_ = [(i, WINDOW, WINDOW) for i in range(len(sides))]
        while open_:
            windows, size = [], []
            for i, k, m in open_:
                left, right = sides[i]
                windows += [left[max(0, len(left) - k):], right[:m]]
                size.append(int(self.sizes[windows[-2]].sum() + self.sizes[windows[-1]].sum()))
            found, n = self.merge(self.byte_tokens[self._bytes_of(np.concatenate(windows))], np.array(size))
            parts = np.split(found, np.cumsum(n)[:-1])
            again = []
            for (i, k, m), part in zip(open_, parts):
                left, right = sides[i]
                fits = k >= len(left) or part[0] == left[len(left) - k]
                ends = m >= len(right) or part[-1] == right[m - 1]
                if fits and ends:
                    out[i] = np.concatenate((left[:max(0, len(left) - k)], part, right[m:]))
                else:
                    again.append((i, k if fits else 2 * k, m if ends else 2 * m))
            open_ = again
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pre-tokens as one array, and each one's start and length in it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        leaves = np.maximum(1, -(-size // LEAF))
        leaves = 1 << np.ceil(np.log2(leaves)).astype(np.int64)  # halves of halves
        word = np.repeat(np.arange(len(words)), leaves)
        part = np.arange(len(word)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        cut = lambda p: p * size[word] // leaves[word]
        tokens, n = self.merge(self.byte_tokens[np.frombuffer(b"".join(words), np.uint8)], cut(part + 1) - cut(part))
        ends, leaf = np.cumsum(n), np.cumsum(leaves) - leaves
        tall = np.flatnonzero(leaves > 1)
        nodes = {w: [tokens[ends[j] - n[j]:ends[j]] for j in range(lo, lo + k)]
                 for w, lo, k in zip(tall.tolist(), leaf[tall].tolist(), leaves[tall].tolist())}
        while active := [w for w, x in nodes.items() if len(x) > 1]:
            joined = iter(self.join([pair for w in active for pair in zip(nodes[w][::2], nodes[w][1::2])]))
            for w in active:
                nodes[w] = [next(joined) for _ in range(len(nodes[w]) // 2)]
        short = np.flatnonzero(leaves == 1)
        flat = [tokens[np.repeat(leaves[word] == 1, n)], *(x[0] for x in nodes.values())]
        order = np.concatenate((short, tall))
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[short], lengths[tall] = n[leaf[short]], [len(x[0]) for x in nodes.values()]
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return self.ids[np.concatenate(flat)], starts, lengths

    def chunk_ids(self, cached: PretokenCache, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, and the texts' offsets among them; added tokens in a text are themselves."""
        raw = data.tobytes()
        marks = []
        if self.special is not None and any(t in raw for t in self.added):
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                marks += [(m.start(), m.end()) for m in self.special.finditer(raw, a, b)]
        if not marks:
            return cached.chunk_ids(data, at)
        cuts = np.unique(np.concatenate((at, np.array(marks, np.int64).ravel())))
        ids, first = cached.chunk_ids(data, cuts)
        at_mark = np.searchsorted(cuts, [a for a, _ in marks])
        parts = np.split(ids, first[1:-1])
        for place, (a, b) in zip(at_mark.tolist(), marks):
            parts[place] = np.array([self.added[raw[a:b]]], ids.dtype)
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return np.concatenate(parts), ends[np.searchsorted(cuts, at)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and each id's offset among them (n + 1 entries)."""
        n = self.id_sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.id_bytes[np.arange(total) - np.repeat(ends - n - self.id_starts[ids], n)], np.concatenate(([0], ends))


@lru_cache(maxsize=2)
def tree_vocabulary(path: str) -> TreeVocabulary:
    """The vocabulary at ``path``, read once in each Python worker."""
    return TreeVocabulary(path)


@lru_cache(maxsize=1)
def _cache(path: str) -> PretokenCache:
    """Ids of pre-tokens, kept between a worker's tasks; bounded by its size."""
    return PretokenCache(tree_vocabulary(path).encode_words)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row.

    ``ids_sha256`` is the digest of the decimal ids joined by commas, ``decoded_sha256`` of the text that the
    ids give back (special tokens kept; bytes that are no UTF-8, which only cut texts have, become U+FFFD).  Null and
    empty texts have no ids and the digests of nothing; rows that repeat have equal results; a null id
    stays null; an empty table gives an empty one.  Only id and text are read.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cached = tree_vocabulary(path), _cache(path)
        for rows, data, at in chunks(batches):
            ids, first = vocab.chunk_ids(cached, data, at)
            raw, offset = vocab.decode(ids)
            spans, back = list(zip(first[:-1].tolist(), first[1:].tolist())), offset[first].tolist()
            said = [str(i) for i in ids.tolist()]
            columns = [rows.column(0), pa.array(np.diff(first)),
                       pa.array([hashlib.sha256(",".join(said[i:j]).encode()).hexdigest() for i, j in spans]),
                       pa.array([hashlib.sha256(raw[i:j].tobytes().decode("utf-8", "replace").encode()).hexdigest()
                                 for i, j in zip(back, back[1:])])]
            if with_ids:
                columns.append(pa.array([ids[i:j] for i, j in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return map_arrow(plain, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                            + ", ids array<int>" * with_ids)
