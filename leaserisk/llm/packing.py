"""Best-fit packing of tokenised documents into sequences, by large-item matching.

A document over one sequence is cut into full pieces behind one shorter first
piece; only that one, or the whole of a shorter document, needs packing.  How well
pieces pack depends only on how many there are of each length, so the plan is
made from the counts by length (one row a length at most): pieces over a third
of a sequence share a sequence with at most one other such piece, so the
largest that is left is matched with the largest that fits beside it; smaller
pieces then go, longest first, into the smallest gap that holds them.  The plan is a
list of runs ("the next n pieces of length s go to these sequences at this
offset"), whose number depends on the sequence length only, and each piece finds its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.llm.pretokens import PretokenCache
from leaserisk.llm.text import chunks, map_arrow, row_key, text_column
from leaserisk.session import checkpoint_dir

ROWS_PER_SALT = 20_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(path: str) -> list[bytes]:
    return [t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values()]


def _encode_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = _tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    ids = [e.ids for e in found]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int64, int(size.sum())), np.cumsum(size) - size, size


@lru_cache(maxsize=1)
def _pretokens(path: str) -> PretokenCache:
    """Kept between the tasks of a Python worker, as most pre-tokens come again; bounded by its size."""
    return PretokenCache(lambda words: _encode_words(path, words))


def token_pieces(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document.

    The vocabulary splits texts into pre-tokens first, so every distinct one is
    encoded once by the tokenizer and reused.  A text that holds one of the
    vocabulary's special tokens is given to the tokenizer whole.
    """
    names = ["key", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = _pretokens(path)
        specials = _specials(path)
        for rows, data, at in chunks(batches):
            flat, first = cached.chunk_ids(data, at)
            flat, raw = flat.astype("<u4"), data.tobytes()
            odd = any(s in raw for s in specials)
            row, piece, start, size, crc, own = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                ids = flat[a:b]
                if odd and any(s in (text := raw[at[i]:at[i + 1]]) for s in specials):
                    ids = np.array(_tokenizer(path).encode(text.decode(), add_special_tokens=False).ids, "<u4")
                ids = np.append(ids, np.array([end_id], "<u4"))
                lo, hi = 0, len(ids) % length or length
                while lo < len(ids):
                    part = ids[lo:hi]
                    row.append(i)
                    piece.append(ceil(lo / length))
                    start.append(lo)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    own.append(part) if with_ids else None
                    lo, hi = hi, hi + length
            take = pa.array(row, pa.int64())
            columns = [rows.column(0).take(take), rows.column(1).take(take), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        text_column(text_col).alias("text"))
    return map_arrow(plain, run, "key struct<a: long, b: long>, doc_id long, piece int, start long, length long, "
                            "ids_crc32 long" + ", ids array<int>" * with_ids)


class Bins:
    """Sequences that are filled alike, as (number of them, what each holds)."""

    def __init__(self, length: int):
        self.length = length
        self.by_gap: dict[int, list[tuple[int, tuple]]] = {}

    def add(self, gap: int, count: int, holds: tuple) -> None:
        if count:
            self.by_gap.setdefault(gap, []).append((count, holds))

    def smallest(self, size: int) -> int | None:
        return min((g for g in self.by_gap if g >= size), default=None)

    def take(self, gap: int) -> tuple[int, tuple]:
        bins = self.by_gap[gap]
        out = bins.pop()
        if not bins:
            del self.by_gap[gap]
        return out


def plan(counts: dict[int, int], length: int = 1024) -> list[tuple[int, tuple]]:
    """(number of sequences, ((piece length, how many of it), ...)) groups that hold all pieces counted by length."""
    left = {s: n for s, n in counts.items() if n}
    bins = Bins(length)
    large = sorted((s for s in left if 3 * s > length), reverse=True)
    for s in large:
        while left.get(s):
            fits = [t for t in large if left.get(t) and s + t <= length and (t != s or left[s] > 1)]
            if not fits:
                bins.add(length - s, left.pop(s), ((s, 1),))
                break
            t = fits[0]  # the largest that fits
            n = left[s] // 2 if t == s else min(left[s], left[t])
            bins.add(length - s - t, n, ((s, 2),) if t == s else ((s, 1), (t, 1)))
            for x in (s, t):
                left[x] -= n
    for s in sorted((s for s in left if 3 * s <= length), reverse=True):
        while left[s]:
            gap = bins.smallest(s)
            count, holds = bins.take(gap) if gap is not None else (ceil(left[s] / (length // s)), ())
            gap = length if gap is None else gap
            each = min(gap // s, left[s])
            whole = min(count, left[s] // each)
            bins.add(gap, count - whole, holds)
            bins.add(gap - each * s, whole, (*holds, (s, each)))
            left[s] -= whole * each
    return [group for groups in bins.by_gap.values() for group in groups if group[1]]


def runs_of(groups: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, pieces of it in a sequence, offset), by length and rank."""
    runs, used, sequence = [], {}, 0
    for count, holds in groups:
        offset = 0
        for s, each in holds:
            lo = used.get(s, 0)
            runs.append((s, lo, count * each, sequence, each, offset))
            used[s] = lo + count * each
            offset += s * each
        sequence += count
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def place(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Ranks among the pieces of a length come in two steps, as one length may
    hold most rows: inside a salt by a window, before a salt by sums of counts.
    Pieces that repeat in all columns are pieces of their own.
    """
    n = pieces.count()
    salts = max(1, ceil(n / ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    runs = runs_of(plan(counts, length))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("key", "piece", "start", "ids_crc32")
    ranked = (salted.withColumn("in_salt", F.row_number().over(inside) - 1).join(by_salt, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.col("in_salt")).drop("salt", "before", "in_salt"))
    keep = [c for c in pieces.columns]
    steps = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            size, rank = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            r = runs[np.searchsorted(steps, (size << 44) + rank, "right") - 1]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in keep),
                 pa.array(r[:, 3] + nth // r[:, 4]), pa.array(r[:, 5] + nth % r[:, 4] * size)], [*keep, "sequence_id", "offset"])

    schema = ranked.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return map_arrow(ranked, run, schema)


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset they get.

    A null or empty text is its end id alone.  Documents that repeat are packed each.  An empty
    table gives an empty result.  Columns other than id and text aren't read.
    """
    checkpoint_dir(docs.sparkSession)
    return place(token_pieces(docs, path, length, end_id, id_col, text_col, with_ids).checkpoint(), length)
