"""SimHash near-duplicates, verified behind a table of pivot distances.

Fingerprints: lower-cased ASCII, words between ASCII white space, shingles of
``shingle`` words, XXH64 with seed 42; bit i is set if over half of the
shingle hashes have it.  Fingerprints link at ``max_bits`` or fewer differing
bits.

Only distinct fingerprints are compared, so a group of copies is one row.  If
two fingerprints differ in at most k bits and their 64 bits are cut into b
blocks, some b - k blocks agree; each of the C(b, k) choices of blocks makes a
key, and fingerprints meet only under an equal key (b grows with their count, which
keeps the rows under a key few).  Under a key every fingerprint has its
Hamming distances to ``PIVOTS`` reference fingerprints, computed once.  A pair
whose distances to any pivot differ by more than k can't be within k bits
(triangle inequality) and goes; what is left is verified by its own distance.
Pivot distances alone order the fingerprints too weakly to find candidates
without all pairs, which is why the keys come first.  A task returns a
spanning forest of the links under its keys, never all pairs of a group.

A key with more than ``KEY_ROWS`` fingerprints is divided: into cells by the distance to the
first pivot, ``max_bits + 1`` wide, and crowded cells into units by hash.  A pair within ``max_bits`` lies
in one cell or in neighbouring ones, so only such units meet, two at a time, each two in a group of
their own.  No link is lost, and a task never holds more than two units.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.graph import connected_components
from leaserisk.llm.text import CHUNK_BYTES, chunks, map_arrow, row_key, text_column
from leaserisk.session import checkpoint_dir

PIVOTS = 24
ROWS_PER_TASK = 100_000
KEY_ROWS = 8_192  # fingerprints under a key that are compared in one task; more are divided


def document_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of one text; fewer words: the whole sequence; none: nothing."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    return [xxh64_intdigest(line[i:j], 42) for i, j in zip(starts, ends[shingle - 1:].tolist())]


def majority_bits(hashes: list[int], counts: list[int]) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    n = np.asarray(counts, np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
    over = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > n[full, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, fp) per row; null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, most=CHUNK_BYTES // 4):  # each word becomes a few Python objects
            raw, hashes, counts = data.tobytes(), [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                own = document_hashes(raw[i:j], shingle)
                hashes += own
                counts.append(len(own))
            fp = majority_bits(hashes, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(fp)], ["key", "doc_id", "fp"])

    plain = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        text_column(text_col).alias("text"))
    return map_arrow(plain, run, "key struct<a: long, b: long>, doc_id long, fp long")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - max_bits`` of ``blocks`` near-equal runs of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def blocks_for(rows: int, max_bits: int) -> int:
    """So many blocks that a key has about log2(rows) - 6 bits or more: some 64 rows under a key."""
    b = max_bits + 1
    while b < 64 and 64 * (b - max_bits) / b < log2(max(rows, 2)) - 6:
        b += 1
    return b


def pivot_table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances (uint8) of each fingerprint to the reference fingerprints."""
    refs = np.random.default_rng(64).integers(0, 1 << 64, pivots, dtype=np.uint64, endpoint=False)
    return np.stack([np.bitwise_count(fp ^ r) for r in refs]).astype(np.int16)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes below n that have an edge and aren't smallest."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != (up := label[label])).any():
            label = up
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links_under_keys(fp: np.ndarray, key: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints with an equal key."""
    order = np.lexsort((fp, key))
    fp, key = fp[order], key[order]
    table = pivot_table(fp)
    own, other, held = [], [], 0
    step = 0
    left = np.arange(len(fp))
    while True:
        step += 1
        left = left[left + step < len(fp)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        i = left
        for row in table:
            i = i[np.abs(row[i] - row[i + step]) <= max_bits]
            if len(i) < 64:
                break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits]
        own.append(i)
        other.append(i + step)
        held += len(i)
        if held > 4 * len(fp) + 1_000_000:  # a dense group: keep its forest, not its pairs
            a, b = forest(np.concatenate(own), np.concatenate(other), len(fp))
            own, other, held = [a], [b], len(a)
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = forest(np.concatenate(own), np.concatenate(other), len(fp))
    return fp[a], fp[b]


def keys_of(distinct: DataFrame, rows: int, max_bits: int) -> DataFrame:
    """(fp, choice, block): each fingerprint under each of its block keys."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(max_bits, blocks_for(rows, max_bits))]
    masked = F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in signed])
    return distinct.select("fp", F.posexplode(masked).alias("choice", "block"))


def divided(crowded: DataFrame, max_bits: int, most: int) -> DataFrame:
    """(fp, choice, part, block) with a group (choice -1, part) for each two units that may hold links.

    A row goes to a group for each unit of its own cell and the two beside it.  ``block`` is the
    group's hash; groups that share a hash are compared together, which loses nothing.
    """
    ref = int(np.random.default_rng(64).integers(0, 1 << 64, 1, dtype=np.uint64)[0])
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.lit(ref - (1 << 64) if ref >> 63 else ref)))
    rows = crowded.withColumn("cell", F.floor(apart / (max_bits + 1)).cast("int"))
    units = rows.groupBy("choice", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("units"))
    units = units.groupBy("choice", "block").agg(F.map_from_entries(F.collect_list(F.struct("cell", "units"))).alias("units"))
    rows = rows.join(units, ["choice", "block"])
    own = F.struct(F.col("cell"), F.pmod(F.xxhash64("fp"), F.element_at("units", F.col("cell"))).cast("int").alias("unit"))
    near = F.filter(F.map_entries("units"), lambda e: F.abs(e["key"] - F.col("cell")) <= 1)
    beside = F.flatten(F.transform(near, lambda e: F.transform(
        F.sequence(F.lit(0), e["value"] - 1), lambda u: F.struct(e["key"].alias("cell"), u.alias("unit")))))
    meets = rows.select("fp", "choice", "block", own.alias("own"), F.explode(beside).alias("other"))
    group = F.xxhash64("choice", "block", F.least("own", "other"), F.greatest("own", "other"))
    return meets.select("fp", F.lit(-1).alias("choice"), group.alias("part"), group.alias("block"))


def link_components(distinct: DataFrame, rows: int, max_bits: int, most: int = KEY_ROWS) -> DataFrame:
    """(node, root) for the fingerprints (column fp) that link to another."""
    tasks = max(1, ceil(rows / ROWS_PER_TASK))
    keyed = keys_of(distinct, rows, max_bits)
    crowds = keyed.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(
        "choice", "block").checkpoint()
    part = F.pmod(F.xxhash64("choice", "block"), F.lit(tasks)).alias("part")
    if crowds.isEmpty():
        spread = keyed.select("fp", "choice", part, "block")
    else:
        plain = keyed.join(crowds, ["choice", "block"], "left_anti").select("fp", "choice", part, "block")
        spread = plain.unionByName(divided(keyed.join(crowds, ["choice", "block"], "left_semi"), max_bits, most))

    def run(rows: pa.Table) -> pa.Table:
        fp, key = (rows.column(c).to_numpy().view(np.uint64) for c in ("fp", "block"))
        a, b = links_under_keys(fp, key, max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    edges = spread.groupBy("choice", "part").applyInArrow(run, "a long, b long")
    return connected_components(edges)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(key, doc_id, fingerprint, component_id, root) per row of ``docs``.

    component_id is the smallest id in the row's component; a null id never is
    unless all are null.  Rows that repeat stay, each with the same values.
    Empty or null texts have fingerprint zero and link like any other.  An
    empty table gives an empty result; columns of ``docs`` beside id and text
    aren't read, so their names don't matter.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    prints = fingerprints(docs, shingle, id_col, text_col).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    linked = link_components(distinct.select("fp"), distinct.count(), max_bits)
    rooted = (distinct.join(linked, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root")
    return prints.join(named, "fp").select(
        "key", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest id (null last), then the smallest text key."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m"))
    kept = kept.select(F.col("m.key.a").alias("a"), F.col("m.key.b").alias("b"))
    key, place = row_key(id_col, text_col), [f"c{i}" for i in range(len(docs.columns))]  # by place: any name may be among the columns
    keyed = docs.select(key["a"].alias("a"), key["b"].alias("b"), *[F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, place)])
    return keyed.join(kept, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select(*place).toDF(*docs.columns)
