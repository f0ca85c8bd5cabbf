"""Helpers shared by the operators: bounded chunks of Arrow text, rolling
hashes, and reading and cutting documents.

Text columns reach the Python tasks as Arrow batches.  Each batch is worked
through in chunks of at most ``CHUNK_BYTES`` of UTF-8 (a longer document is
a chunk of its own), so a task's memory follows its longest document and not
its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaserisk.session import scratch_path

CHUNK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes: 10,000 long texts in one would fill an executor."""
    df.sparkSession.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one run in the shared folder.

    As a context they go when the run has stored what it returns, or has failed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.paths):
            self.drop(name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stored``; the run's earlier table of that name goes once the new one is written."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in names:
            if path := self.paths.pop(name, None):
                place = hadoop.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def text_column(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that name a document by its id and text; rows equal in both share it."""
    i, t = F.col(f"`{id_col}`"), text_column(text_col)
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(t, i.isNull(), F.lit(1), i).alias("b"))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one uint8 array, and their n + 1 offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most ``most`` text bytes, with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = arrow_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            lo = hi


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the polynomial hash of data[i:j], scaled by BASE**i."""
    h = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUES[data] * _powers(len(data))[0], out=h[1:])
    return h


def span_hash(h: np.ndarray, lo, hi) -> np.ndarray:
    """64-bit hashes of the spans [lo, hi): slices of one length, or index arrays."""
    with np.errstate(over="ignore"):
        return mix((h[hi] - h[lo]) * _powers(len(h))[1][lo])
