"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text.  Each is cut into bins;
the model is one lookup table for each feature and one for each of a few
pairs.  Boosting goes round the features again and again: each step fits a
shallow tree over one feature's bins (later: over one pair's) to the logistic
loss and adds it, damped, to that feature's table.  A score is a sum of table entries,
looked up for whole chunks at once.

The model is fitted on the driver from a bounded sample of labelled rows
(``SAMPLE_ROWS``, chosen by a hash of the id); every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.text import chunks, map_arrow, text_column

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE = 0.15
THRESHOLD = 0.7

# Byte classes.
_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "quote", "symbol", "high", "other"]
_SETS = {"digit": b"0123456789", "space": b" \t", "newline": b"\r\n\x0b\x0c", "stop": b".", "comma": b",;:", "bang": b"!?",
         "bar": b"|", "quote": b"'\"()-", "symbol": b"#$%&*@^~<>{}[]\\/_=+`"}
_CLASS_OF = np.full(256, _CLASSES.index("other"), np.uint8)
_CLASS_OF[65:91], _CLASS_OF[97:123], _CLASS_OF[128:] = 0, 1, _CLASSES.index("high")
for _name, _bytes in _SETS.items():
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)

FEATURES = (["bytes", "words", "word_length"] + _CLASSES +
            ["distinct_words", "repeated_next", "distinct_lines", "line_length", "upper_words", "top_word"])


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has zeros."""
    n, k = len(at) - 1, len(_CLASSES)
    size = np.diff(at)
    doc = np.repeat(np.arange(n, dtype=np.int64) * k, size)
    shares = np.bincount(doc + _CLASS_OF[data], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    raw, rest = data.tobytes(), np.zeros((n, 6))
    words_in = np.zeros(n)
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        text = raw[lo:hi]
        words = text.split()
        if not words:
            continue
        seen = dict.fromkeys(words, 0)
        for w in words:
            seen[w] += 1
        lines = text.split(b"\n")
        words_in[i] = m = len(words)
        rest[i] = (len(seen) / m, sum(map(bytes.__eq__, words, words[1:])) / m, len(set(lines)) / len(lines),
                   np.log1p(len(text) / len(lines)), sum(map(bytes.isupper, words)) / m, max(seen.values()) / m)
    return np.column_stack([np.log1p(size), np.log1p(words_in), size / np.maximum(words_in, 1), shares, rest])


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` holds (i, j, coarse edges of i, of j, table)."""

    intercept: float = 20.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for column, edges, table in zip(x.T, self.edges, self.tables):
            total += table[np.searchsorted(edges, column, "right")]
        for i, j, ei, ej, table in self.pairs:
            total += table[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best split of bins [0, cut) and [cut, end) by gradient and curvature sums."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
    cut = int(np.argmax(gain))
    return float(gain[cut]), cut + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values over the bins of a tree grown best-first."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        gain, cut, k = max((*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(spans))
        if gain <= 1e-6:
            break
        a, b = spans[k]
        spans[k:k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree of depth two over a grid: one cut of the rows, one of the columns in each part."""
    best = (-1.0, np.zeros_like(g))
    _, cut = _best_cut(g.sum(1), h.sum(1))
    out, gain = np.zeros_like(g), 0.0
    for rows in (slice(0, cut), slice(cut, len(g))):
        if rows.start == rows.stop:
            continue
        gr, hr = g[rows].sum(0), h[rows].sum(0)
        _, c = _best_cut(gr, hr)
        for cols in (slice(0, c), slice(c, g.shape[1])):
            if cols.start != cols.stop:
                gs, hs = gr[cols].sum(), hr[cols].sum()
                out[rows, cols] = _leaf(gs, hs)
                gain += gs * gs / (hs + 1)
    return max(best, (gain, out), key=lambda t: t[0])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the feature tables, then of the strongest pairs' tables.

    No rows: a model that scores every document close to 1, as nothing speaks against any.
    """
    if not len(y):
        return Model()
    p = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    total = np.full(len(y), np.log(p / (1 - p)))
    model = Model(float(total[0]))
    model.edges = [_edges(c, BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables):
            q = 1 / (1 + np.exp(-total))
            step = RATE * _shallow_tree(np.bincount(b, y - q, len(table)), np.bincount(b, q * (1 - q), len(table)))
            table += step
            total += step[b]
    coarse = [_edges(c, PAIR_BINS) for c in x.T]
    cb = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]

    def grid(i: int, j: int):
        q, shape = 1 / (1 + np.exp(-total)), (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = cb[i] * shape[1] + cb[j]
        sums = [np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (y - q, q * (1 - q))]
        return cell, sums

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_pair_tree(*grid(*ij)[1])[0])[:PAIRS]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in model.pairs:
            cell, sums = grid(i, j)
            step = RATE * _pair_tree(*sums)[1]
            table += step
            total += step.ravel()[cell]
    return model


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text has remainder 2 by 4.  A null id isn't held out."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out, the first by a hash of the id.

    Several labels of an id: their mean, rounded, counts.  Null ids and labels teach nothing.
    """
    taught = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
              .orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text_column(text_col).alias("text"))
    # The sample's size is a parameter, so it may be broadcast.
    sample = rows.join(F.broadcast(taught), "__id").select("__id", "__y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            x = features(data, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                                             ["id", "y", "x"])

    found = (map_arrow(sample, run, "id long, y int, x array<double>").groupBy("id", "x").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("id"), "id", "x").limit(sample_rows).select("y", "x").toArrow())
    y = found.column("y").to_numpy().astype(float)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    return fit(x, y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts are scored as empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            s = model.score(features(data, at))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                        text_column(text_col).alias("text"))
    return map_arrow(plain, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``THRESHOLD`` or more."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, "c0"):
            rows = rows.filter(pa.array(model.score(features(data, at)) >= THRESHOLD))
            yield pa.RecordBatch.from_arrays(rows.columns[1:], [f"c{i + 1}" for i in range(len(names))])

    # Renamed by place on the way, so columns of any name pass through.
    kept = docs.select(text_column(text_col).alias("c0"), *[F.col(f"`{c}`").alias(f"c{i + 1}") for i, c in enumerate(names)])
    schema = kept.drop("c0").schema
    return map_arrow(kept, run, schema).toDF(*names)
