"""Embedding whitening with exact covariances, by bit-sliced scatter.

Vectors become integers.  Rows are taken in blocks; in a block each dimension is shifted by its
least value, and each bit of the shifted numbers is packed across the rows into 64-bit words, a bit plane.
The sum over rows of a product of two dimensions is then a weighted sum of population counts of their planes'
ANDs, and undoing the shift gives the block's exact cross-products.  Tasks add their blocks up, Spark adds the tasks,
and what reaches the driver is one number for each pair of dimensions.  There the products are centred as
integers (n * sum(x y) - sum(x) sum(y)), so nothing cancels before ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.text import map_arrow, stored

ROWS = 8192
_WORD = 64
LONG_MAX = (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c), c as double; vectors that are null or hold null or non-finite entries go.

    Vectors shorter than the longest one end in zeros.  Entries beyond a long are its least or greatest value.
    """
    v = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    good = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.filter(F.col(f"`{vec_col}`").isNotNull()).filter(good)
    width = kept.agg(F.max(F.size(F.col(f"`{vec_col}`"))).alias("n")).first()["n"] or 0
    whole = F.transform(v, lambda c: F.floor(c * scale).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(whole)))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), padded.alias("x"))


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, bit): the bit planes of a (rows, dimensions) matrix of uint64 as (dimensions, bits, words), and each bit's weight."""
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    rows, width = shifted.shape
    columns = np.ascontiguousarray(shifted.T)
    out = np.zeros((width, bits, -(-rows // _WORD) * 8), np.uint8)
    for bit in range(bits):
        packed = np.packbits(((columns >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1)
        out[:, bit, :packed.shape[1]] = packed
    return out.view(np.uint64), np.arange(bits)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums, cross-products) of the rows of an int64 matrix, as Python integers."""
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, so right for any two longs
    words, bit = planes(shifted)
    width, bits = words.shape[:2]
    counts = np.bitwise_count(words).sum(axis=2, dtype=np.int64)
    power = np.array([1 << int(b) for b in bit], object)
    own = counts.astype(object) @ power
    # Sums of counts times weights fit a long where two planes' weights and the rows do.
    small = 2 * bits + int(len(x)).bit_length() < 63
    weight = np.outer(power, power)
    product = np.zeros((width, width), object)
    for i in range(width):
        right = words[i:]
        part = np.zeros((bits, width - i, bits), np.int64)
        for p in range(bits):
            if counts[i, p]:
                part[p] = np.bitwise_count(right & words[i, p]).sum(axis=2, dtype=np.int64)
        if small:
            row = np.einsum("pjq,pq->j", part, weight.astype(np.int64)).astype(object)
        else:
            row = (part.astype(object) * weight[:, None, :]).sum(axis=(0, 2))
        product[i, i:] = row
        product[i:, i] = row
    low, n = low.astype(object), len(x)
    return own + n * low, product + np.outer(low, own) + np.outer(own, low) + n * np.outer(low, low)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scatter_sums(fit: DataFrame) -> DataFrame:
    """(i, j, total decimal(38, 0)) over the rows of ``fit`` (x): the count at (-1, -1), the sum of
    dimension j at (-1, j), the cross-product of i and j at (i, j), i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            for lo in range(0, len(x) if x.size else 0, ROWS):
                own, pairs = scatter(x[lo:lo + ROWS])
                sums, products = sums + own, products + pairs
            n += len(x)
        if not n:
            return
        i, j, total = [-1], [-1], [n]
        if not np.isscalar(sums):
            a, b = np.triu_indices(len(sums))
            i, j = [*i, *[-1] * len(sums), *a.tolist()], [*j, *range(len(sums)), *b.tolist()]
            total += [*sums.tolist(), *products[a, b].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total, pa.decimal128(38, 0))],
                                         ["i", "j", "total"])

    return map_arrow(fit.select("x"), run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(
        F.sum("total").cast("decimal(38,0)").alias("total"))


class Whitener(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  #: variances of the components, falling
    axes: np.ndarray  #: a unit vector a column
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((x - mean) @ self.axes) / np.sqrt(np.where(self.values > 0, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2 of each row, exact; None beyond a long."""
        if not x.size:
            return [0] * len(x)
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if len(self.sums) * most * most <= LONG_MAX:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v <= LONG_MAX else None for v in exact]


def fit_whitener(sums: DataFrame, components: int) -> Whitener | None:
    """The strongest components of the centred integer products; None for no rows or no dimensions.

    Collects one row for each pair of dimensions.  Variances within rounding of zero count as zero.
    """
    got = {(r["i"], r["j"]): int(r["total"]) for r in sums.collect()}
    n, width = got.get((-1, -1), 0), sum(i == -1 and j >= 0 for i, j in got)
    if not n or not width:
        return None
    s = [got[-1, j] for j in range(width)]
    v = np.array([[(n * got[min(i, j), max(i, j)] - s[i] * s[j]) / (n * n) for j in range(width)] for i in range(width)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    total = np.trace(v)
    values = np.where(values > total * width * np.finfo(float).eps, values, 0.0)[:components]
    explained = values / total if total > 0 else np.full(len(values), np.nan)
    return Whitener(n, s, values, axes[:, :components], explained)


def _nullable(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column)).alias(column)


def projected(rows: DataFrame, fitted: Whitener) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of the rows of ``rows`` (vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            white = fitted.project(x) if len(x) else np.zeros((0, len(fitted.values)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fitted.deviations(x), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"])

    return map_arrow(rows.select("vec_id", "x"), run, "vec_id long, deviation long, whitened array<double>")


def identity_error(fit: DataFrame, fitted: Whitener) -> float | None:
    """The largest entry of the covariance of the whitened ``fit`` rows minus the identity, over components with variance."""
    with_variance = [k for k, e in enumerate(fitted.values) if e > 0]
    if not with_variance:
        return None
    white = projected(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), fitted).select(
        *[F.col("whitened")[k].alias(f"w{k}") for k in with_variance])
    pairs = [(a, b) for a in with_variance for b in with_variance if a <= b]
    found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept vector and component.

    The fit list is each distinct integer vector once.  Rows that repeat each get their rows;
    null ids stay null.  Fewer dimensions than ``components``: as many components as dimensions.  A component without
    variance (one distinct vector, equal dimensions) has null in ``whitened``, and ``explained`` is null where nothing
    varies.  ``deviation`` is null where it is beyond a long.  No vector left, or only empty ones: an empty result.
    """
    rows = integers(vectors, id_col, vec_col, scale)
    fit = stored(rows.select("x").distinct(), "fit")
    fitted = fit_whitener(scatter_sums(fit), components)
    if fitted is None:
        return rows.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit, fitted)
    explained = F.array(*[F.lit(float(e)) for e in fitted.explained])
    each = projected(rows, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"), explained.alias("shares"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", _nullable("whitened"),
        F.when(~F.isnan(F.col("shares")[F.col("k")]), F.col("shares")[F.col("k")]).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
