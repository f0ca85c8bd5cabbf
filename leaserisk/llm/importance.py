"""Importance resampling towards a target distribution over hashed n-grams.

A text's features are its runs of one to three words.  Arrow kernels make them: lower
case, a split at everything that is no word sign, the flattened lists, and a dictionary of
the chunk's words.  Shifted dictionary indices beside each other name the runs of two, and those
with the next index the runs of three; only distinct ones get a CRC, which is put together from
those of their words.  A CRC picks one of ``BUCKETS`` buckets.

One pass counts the buckets of the corpus (each task adds its own up first, so the shuffle holds
at most ``BUCKETS`` rows a task), one those of the target.  A bucket's gain is its scaled log ratio;
the gains are ``BUCKETS`` numbers whatever the input, and go to the tasks of the second pass, which takes
them by bucket and reduces them by document.  Gumbel noise from the id turns the greatest scores into a draw
without replacement.  Ranks come from ranges of scores: rows before a range, and the place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.llm.text import chunks, map_arrow, stored, text_column

BUCKETS = 10_000
LONGEST_RUN = 3
SALTS = 256
#: What is no word sign once A-Z are lower case: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@cache
def _shift_tables() -> np.ndarray:
    """For each k, four tables of 256: what a CRC becomes when 2**k zero bytes follow, by its bytes."""
    step = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)], np.uint32)  # one byte, bit by bit
    out = []
    for _ in range(40):
        values = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                values[place, (np.arange(256) >> bit) & 1 == 1] ^= step[8 * place + bit]
        out.append(values)
        step = _shifted(values, step)
    return np.stack(out)


def _shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24])


def joined_crc(crc: np.ndarray, next_crc: np.ndarray, next_length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from those of A and B and the length of B."""
    out, left, k = crc.astype(np.uint32), next_length.astype(np.int64), 0
    while left.any():
        on = np.flatnonzero(left & 1)
        out[on] = _shifted(_shift_tables()[k], out[on])
        left, k = left >> 1, k + 1
    return out ^ next_crc


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def run_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, for each length of run the (text, bucket) of every run, in order of texts)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    words, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    words, text = words.filter(real).dictionary_encode(), text.filter(real).to_numpy().astype(np.int64)
    index = words.indices.to_numpy().astype(np.int64)
    own = [w.encode() for w in words.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, own), np.uint32, len(own))
    tail = np.fromiter((zlib.crc32(b" " + w) for w in own), np.uint32, len(own))
    size = np.fromiter(map(len, own), np.int64, len(own)) + 1
    found, run, run_crc = [(text, crc[index] % np.uint32(buckets))], index, crc
    for longer in range(1, LONGEST_RUN):
        same = text[longer:] == text[:-longer]
        first, last = run[:len(same)][same], index[longer:][same]
        pairs, which = _distinct(first * max(1, len(own)) + last)
        a, b = np.divmod(pairs, max(1, len(own)))
        run_crc = joined_crc(run_crc[a], tail[b], size[b])
        found.append((text[:-longer][same], (run_crc % np.uint32(buckets))[which]))
        run = np.zeros(len(same), np.int64)
        run[same] = which
    return np.bincount(text, minlength=len(texts)), found


def _text_of(rows: pa.RecordBatch) -> pa.Array:
    return rows.column(rows.schema.get_field_index("text"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all runs of all texts of ``texts`` (text); buckets without runs have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows, _, _ in chunks(batches):
            for _, bucket in run_buckets(_text_of(rows), buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return map_arrow(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from both counts.

    Collects at most ``buckets`` rows of each side.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, counts in ((s, corpus), (t, target)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    total_s, total_t = s.sum(), t.sum()
    return np.array([floor(1000 * log((b + 1) * (total_s + buckets) / ((a + 1) * (total_t + buckets))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: a text's runs, and the sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches):
            words, found = run_buckets(_text_of(rows), len(gain))
            features, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for text, bucket in found:
                if len(text):
                    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                    weight[text[first]] += np.add.reduceat(gain[bucket], first)
                    features[text[first]] += np.diff(np.append(first, len(text)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return map_arrow(plain, run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = 42) -> Column:
    """floor(-1000 ln(-ln(u))), u in (0, 1) from the first 32 bits of the SHA-256 of ``seed:id``; a null id counts as no text."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ...) in ``order``; rows equal in it in any order.

    Rows are dealt to ranges of the order; a range's ranks begin behind the rows of the ranges
    before it.  The only window without a key runs over the ranges' counts.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = stored(dealt.groupBy("range").agg(F.count("*").alias("n")), "range_counts")
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (dealt.withColumn("place", place).join(before, "range")
            .withColumn("rank", (F.col("before") + F.col("place")).cast("long")).drop("range", "place", "before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) with the
    greatest score are drawn, ties to smaller ids (rows without an id after all others), and
    ranked; rank is null for all other rows.  Null texts are empty: no features, weight 0.  Rows that
    repeat are each counted, scored and drawn.  An empty target leaves the corpus' own rarity as gain; an empty table
    gives an empty result.  Other columns of ``docs`` are not read.
    """
    counted = [bucket_counts(t.select(text_column(c).alias("text"))) for t, c in ((docs, text_col), (target, target_text_col))]
    scored = stored(weights(docs, gains(*counted), id_col, text_col)
                    .withColumn("score", F.col("weight") + noise(seed=seed)), "scored")
    able = F.col("n_words") >= least_words
    most = scored.filter(able).count() * percent // 100
    # Equal rows are dealt by a number that follows the stored table's files, so one id may hold any share of them.
    salted = scored.filter(able).withColumn("salt", F.monotonically_increasing_id() % SALTS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("salt").asc()]
    drawn = ranked(salted, order).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*names).unionByName(rest.select(*names))
