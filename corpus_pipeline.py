"""Training-data pipeline: quality filter, near-duplicates, repeated passages, secrets, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns
is written as Parquet and read again as the next stage's ``docs``.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leaserisk.llm import packing, quality_gam, secret_scan, simhash_pivot, suffix_dedup
from leaserisk.llm.queries import PACK_VOCABULARY, SCAN_VOCABULARY
from leaserisk.llm.text import Tables, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_gam.accepted(docs, quality_gam.train(docs, read(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_pivot.one_per_group(docs, shingle=4, max_bits=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated 200-byte strings cover are removed from the texts."""
    return suffix_dedup.without_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redacted(docs, public_tokenizers.path(SCAN_VOCABULARY))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: the sequence and offset that it gets."""
    return packing.pack(docs, public_tokenizers.path(PACK_VOCABULARY)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: None: training, SimHash and tokenizing can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, tables = read(spark, sf_dir, "documents"), Tables(spark)
    for _, stage in STAGES[:-1]:
        docs = tables.store(stage(spark, docs, sf_dir), "kept")  # the stage's input goes; the last table stays for the reader
    return STAGES[-1][1](spark, docs, sf_dir)
