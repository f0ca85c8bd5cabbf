"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Components are terms.  A block of candidates is an inverted index: for each
term the postings (row, weight) with a weight other than zero.  Each sparse
query row adds weight times postings into a dense array of scores, one term
after another; a partition selection keeps its best k of the block, and Spark
merges the blocks.

Every query block meets every candidate block once, as an equi-join of block
numbers; a block's dense matrix has bounded rows and bytes, so tasks stay the
same size as either table grows, whatever the vectors' length.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a block; fewer where their matrix of longs would be over BLOCK_BYTES.  A task holds a query block, a
#: candidate block with its postings (as large again) and 256 rows of scores: some 4 * BLOCK_BYTES in all.
QUERY_ROWS, CANDIDATE_ROWS, BLOCK_BYTES = 4096, 16384, 32 << 20


def weighted(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, weights array<long>, copies): floor(scale * x), x as double; every row counts.

    Rows whose id or vector is null, or whose vector holds a null, NaN or
    infinity, are left out.  Rows equal in id and weights are one row with
    their number; an id with different vectors keeps each.  An empty vector
    scores zero everywhere.  A finite component whose product is beyond the
    longs becomes the nearest long.
    """
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull())
            .filter(good)
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("weights"))
            .groupBy("vec_id", "weights").agg(F.count(F.lit(1)).alias("copies")))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``weighted`` for tables where a repeated id means the same vector written again: its smallest weights, once."""
    return (weighted(vectors, id_col, vec_col, scale).groupBy("vec_id")
            .agg(F.min("weights").alias("weights"), F.lit(1).cast("long").alias("copies")))


def matrix(weights: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists as rows of a dense matrix; shorter ones end in zeros."""
    column = weights.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    n = np.diff(at)
    out = np.zeros((len(n), width), np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    cols = np.arange(len(rows)) - np.repeat(at[:-1] - at[0], n)
    out[rows, cols] = flat
    return out


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term its rows and weights; a term that most rows have keeps them all, as a slice."""
    out = []
    for column in candidates.T:
        rows = np.flatnonzero(column)
        out.append((slice(None), column.copy()) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def block_scores(queries: np.ndarray, index: list, rows: int) -> np.ndarray:
    """Scores of every query row against the block's rows, accumulated term by term."""
    scores = np.zeros((len(queries), rows), np.int64)
    for acc, query in zip(scores, queries):
        for term in np.flatnonzero(query):
            at, weights = index[term]
            acc[at] += query[term] * weights
    return scores


def select_best(query_ids: np.ndarray, query_copies: np.ndarray, ids: np.ndarray, copies: np.ndarray, scores: np.ndarray, k: int):
    """(query, vec_id, score, copies) of the k best of each row but those of its own id, ties to smaller ids."""
    out_q, out_v, out_s, out_n = [], [], [], []
    for q, n, row in zip(query_ids, query_copies, scores):
        other = np.flatnonzero(ids != q)
        if not len(other):
            continue
        s = row[other]
        if len(s) > k:
            pick = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            other, s = other[pick], s[pick]
        best = np.lexsort((ids[other], -s))[:k]
        out_q.append(np.full(len(best), q))
        out_v.append(ids[other[best]])
        out_s.append(s[best])
        out_n.append(n * copies[other[best]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_q), join(out_v), join(out_s), join(out_n)


def block_rows(width: int, most: int) -> int:
    """Rows of a block of vectors with ``width`` components."""
    return max(1, min(most, BLOCK_BYTES // (8 * max(1, width))))


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query but the rows with its own id.

    Both inputs are results of ``weighted`` or ``quantised``.  A candidate
    that is there twice is named twice.  Rows that repeat a query id answer
    together: all their pairs with candidates are ranked under the one id, as
    a join on different ids ranks them.  Fewer than k others: all of them.  A component that one vector has and the other lacks counts as zero.
    Either side empty: an empty result.  Scores are longs modulo 2**64, so a score that a long holds is exact, also
    where partial sums are beyond it; larger ones wrap.
    """
    size = [F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("width")]
    of_queries, of_rows = queries.agg(*size).first(), candidates.agg(*size).first()
    widest = max(of_queries["width"] or 0, of_rows["width"] or 0)
    qb = max(1, ceil(of_queries["n"] / block_rows(widest, QUERY_ROWS)))
    cb = max(1, ceil(of_rows["n"] / block_rows(widest, CANDIDATE_ROWS)))
    # Over k copies of a row are never named, so their product stays small.
    row = ["vec_id", "weights", F.least("copies", F.lit(k).cast("long")).alias("copies")]
    left = queries.select(*row, F.pmod(F.xxhash64("vec_id", "weights"), F.lit(qb)).alias("q"), _each(cb).alias("c"))
    right = candidates.select(*row, _each(qb).alias("q"), F.pmod(F.xxhash64("vec_id", "weights"), F.lit(cb)).alias("c"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score", "copies")
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        width = max(1, *(pc.max(pc.list_value_length(t.column("weights"))).as_py() or 0 for t in (a, b)))
        index = postings(matrix(b.column("weights"), width))
        q_ids, c_ids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        q_n, c_n = a.column("copies").to_numpy(), b.column("copies").to_numpy()
        parts = []
        own = matrix(a.column("weights"), width)
        for lo in range(0, len(own), 256):
            scores = block_scores(own[lo:lo + 256], index, len(c_ids))
            parts.append(select_best(q_ids[lo:lo + 256], q_n[lo:lo + 256], c_ids, c_n, scores, k))
        return pa.table({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(
        run, "query_id long, vec_id long, score long, copies long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (best.withColumn("upto", upto).filter(F.col("upto") - F.col("copies") < k)
            .select("query_id", F.explode(F.sequence((F.col("upto") - F.col("copies") + 1).cast("int"),
                                                     F.least("upto", F.lit(k)).cast("int"))).alias("rank"), "vec_id", "score"))
