"""Byte-level BPE over padded matrices of words, and its inverse.

Distinct pre-tokens are put into matrices by length, one row each, one byte
id a cell.  Each round finds every row's leftmost pair of least rank, merges
it and closes the gap; rows without a pair in the vocabulary are done.  Pair
ranks come from a hash table of all pairs of entries whose concatenation is
an entry.  Pre-tokens over ``LONGEST`` bytes would need as many rounds as they
have bytes over wide rows; they merge in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.pretokens import PretokenCache
from leaserisk.llm.text import chunks, map_arrow, text_column

LONGEST = 128
ROWS = 8192
NONE = np.int32(0x7FFFFFFF)
_BUCKETS = [1, 2, 3, 4, 6, 8, 10, 12, 16, 24, 32, 64, LONGEST]


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of their concatenation."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in pairs] or [0], np.uint64)[:len(pairs)]
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(pairs))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.ranks[slot[left]] == NONE]
            self.keys[slot[free]] = keys[free]  # of several, the last stays; the others go on
            won = free[self.keys[slot[free]] == keys[free]]
            self.ranks[slot[won]] = ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.ranks) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the vocabulary has no such entry or an id is padding."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != key).ravel() & (self.ranks[slot] != NONE).ravel())
        key, slot, flat = key.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.ranks) - 1)
            hit = self.keys[slot[open_]] == key[open_]
            flat[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (self.ranks[slot[open_]] != NONE)]
        return flat.reshape(out.shape)


class Vocabulary:
    """Ranks of a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for entry, rank in self.ranks.items():
            for cut in range(1, len(entry)):
                a, b = self.ranks.get(entry[:cut]), self.ranks.get(entry[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        by_id = sorted((rank, entry) for entry, rank in self.ranks.items())
        self.sizes = np.zeros(by_id[-1][0] + 1, np.int64)
        self.sizes[[r for r, _ in by_id]] = [len(e) for _, e in by_id]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(e for _, e in by_id), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words (pre-tokens) as one array, and each word's start and length in it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        parts, order, sizes, low = [], [], [], 0
        for width in _BUCKETS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for lo in range(0, len(rows), ROWS):
                part = rows[lo:lo + ROWS]
                done = self._merge_rows([words[i] for i in part.tolist()], size[part], width)
                kept = done >= 0
                parts.append(done[kept])
                order.append(part)
                sizes.append(kept.sum(1))
        for i in np.flatnonzero(size > LONGEST).tolist():
            parts.append(self._merge_long(words[i]))
            order.append([i])
            sizes.append([len(parts[-1])])
        n = np.concatenate(sizes)
        starts, lengths, order = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.concatenate(order)
        starts[order], lengths[order] = np.cumsum(n) - n, n
        return np.concatenate(parts), starts, lengths

    def _merge_rows(self, words: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        """The ids of each word in its row, and -1 behind them."""
        cells = np.full((len(words), width), -1, np.int32)
        filled = np.arange(width) < size[:, None]
        cells[filled] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        done = np.full_like(cells, -1)
        ranks = np.full((len(words), width), NONE, np.int32)  # the last column stays NONE
        ranks[:, :-1] = self._pair_ranks(cells[:, :-1], cells[:, 1:])
        row, cols = np.arange(len(words)), np.arange(width)
        while len(row):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(row)), at]
            more = least != NONE
            if not more.all():
                done[row[~more]] = cells[~more]
                cells, ranks, row, at, least = cells[more], ranks[more], row[more], at[more], least[more]
                if not len(row):
                    break
            i = np.arange(len(row))
            cells[i, at] = least
            # Close the gap: what stood right of the pair moves one place left.
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            shorter = np.take_along_axis(cells, take, 1)
            shorter[:, -1] = -1
            ranks = np.take_along_axis(ranks, take, 1)
            ranks[:, -1] = NONE
            cells = shorter
            right = np.minimum(at + 1, width - 1)
            ranks[i, at] = np.where(at + 1 < width, self._pair_ranks(cells[i, at], cells[i, right]), NONE)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._pair_ranks(cells[left, at[left] - 1], cells[left, at[left]])
        return done

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a < 0) | (b < 0), NONE, self.pairs.look_up(np.maximum(a, 0), np.maximum(b, 0)))

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prv, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        first = self._pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, 0, 0) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        gone = [False] * n

        def push(i: int, j: int) -> None:
            r = int(self._pair_ranks(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, version[i], version[j]))

        while heap:
            r, i, vi, vj = heapq.heappop(heap)
            j = nxt[i] if not gone[i] else n
            if j >= n or version[i] != vi or version[j] != vj:
                continue
            ids[i], gone[j] = r, True
            version[i] += 1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                push(i, nxt[i])
            if prv[i] >= 0:
                push(prv[i], i)
        return np.array([x for x, g in zip(ids, gone) if not g], np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and each id's offset among them (n + 1 entries)."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.bytes[np.arange(total) - np.repeat(ends - n - self.starts[ids], n)]
        return out, np.concatenate(([0], ends))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once in each Python worker."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row.

    Null and empty texts have no ids and the digests of nothing; rows that
    repeat have equal results; an empty table gives an empty one.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        cached = PretokenCache(vocab.encode_words)
        for rows, data, at in chunks(batches):
            ids, first = cached.chunk_ids(data, at)
            raw, little = vocab.decode(ids), ids.astype("<u4")
            spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
            back = raw[1][first].tolist()
            columns = [rows.column(0), pa.array(np.diff(first)),
                       pa.array([hashlib.sha256(little[i:j]).hexdigest() for i, j in spans]),
                       pa.array([hashlib.sha256(raw[0][i:j]).hexdigest() for i, j in zip(back, back[1:])])]
            if with_ids:
                columns.append(pa.array([ids[i:j] for i, j in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return map_arrow(plain, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                            + ", ids array<int>" * with_ids)
