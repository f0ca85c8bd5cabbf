"""Suffix-array dedup: remove every byte that a repeated ``LENGTH``-byte string covers.

Finding what may repeat.  A string of LENGTH bytes belongs to its anchor, the
first of its ``GRAM``-byte substrings with the least hash.  Equal strings have equal
anchors at equal places, so strings meet only under an equal anchor.  The strings of
one anchor in a document start at consecutive bytes and make one stretch.
Anchors that occur once are done; stretches equal as a whole are counted by
hash, repeat for certain, and go on as one.  What is left are different
stretches around an equal anchor.

Merging.  Those stretches are collections of strings over an alphabet of
``SYMBOL``-byte blocks (one string for each phase of the blocks, so every byte
starts a suffix).  A task takes the stretches of some anchors in shards; each
shard has its Burrows-Wheeler transform, and the transforms are merged by
interleave refinement: the interleave starts unsorted, and each pass sends
every shard's symbols through it stably by symbol, which sorts the suffixes
by one symbol more.  A boundary between neighbours that first shows after pass h
makes their common prefix h - 1 symbols; neighbours without one after
LENGTH / SYMBOL passes share LENGTH bytes, and such intervals are the
repeated strings.  Suffixes of the union are never sorted as strings.

Anchors with over ``MOST_STRETCHES`` different stretches (a line that very
many documents hold in different surroundings) are divided: their strings are
dealt anew, by what all strings of a narrow range of places have in common, and
again string by string, so no group grows with the input.

Hashes have 64 bits; symbols and stretches that are equal in them count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.text import (CHUNK_BYTES, Tables, chunks, map_arrow, mix, prefix_hash, row_key, span_hash, stored,
                                text_column)

LENGTH, GRAM, SYMBOL = 200, 64, 50
MOST_STRETCHES = 2000
BYTES_PER_TASK, BYTES_PER_SHARD = 1 << 20, 1 << 18
_KEY = "key struct<a: long, b: long>, base int"
_STRETCH = f"{_KEY}, start int, strings int, before int, anchor long, whole long, more array<int>"
_INDEX_BITS = 22
_BLOCK = 1 << (_INDEX_BITS - 1)


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, n, w = values, len(values) - width + 1, 1
    while 2 * w <= width:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[:n], out[width - w:width - w + n])


def stretches(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Arrays (text, start, strings, anchor's place behind start, anchor hash, hash of the whole stretch).

    Start is an offset in the chunk.  Texts shorter than ``length`` have none.
    """
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) < length:
        return empty
    h = prefix_hash(data)
    grams = span_hash(h, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))
    wide = length - gram + 1
    n = len(data) - length + 1
    owner = np.empty(n, np.int64)
    low = np.uint64((1 << _INDEX_BITS) - 1)
    for lo in range(0, n, _BLOCK):  # places in a block fit beside the upper bits of the hash
        hi = min(n, lo + _BLOCK)
        g = grams[lo:hi + wide - 1]
        least = _least_in_window((g & ~low) | np.arange(len(g), dtype=np.uint64), wide)
        owner[lo:hi] = (least & low).astype(np.int64) + lo
    inside = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n) >= length
    place = np.flatnonzero(inside)
    if not len(place):
        return empty
    own = owner[place]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    start, anchor = place[first], own[first]
    strings = np.diff(np.append(first, len(place)))
    text = np.searchsorted(at, start, "right") - 1
    before = anchor - start
    with np.errstate(over="ignore"):
        whole = span_hash(h, start, start + strings - 1 + length) + mix((before * 512 + strings).astype(np.uint64))
    return text, start, strings, before, grams[anchor], whole


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(rows, name).to_numpy().astype(np.int64)


def _stretch_batch(rows: pa.RecordBatch, at: np.ndarray, found) -> pa.RecordBatch:
    """A row for each different stretch of a text; ``more`` has the starts of its other copies there, so a
    text that repeats one line a thousand times is a few rows.  Starts are places in the document, whose part
    from ``base`` on the text is."""
    text, start, strings, before, anchor, whole = found
    order = np.lexsort((start, whole, anchor, text))
    text, start, strings, before, anchor, whole = (x[order] for x in found)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    start = (start - at[text] + _numbers(rows, "base")[text]).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(np.append(first, len(new)) - np.arange(len(first) + 1), pa.int32()), pa.array(start[~new]))
    own = pa.array(text[first])
    return pa.RecordBatch.from_arrays(
        [_column(rows, "key").take(own), _column(rows, "base").take(own), pa.array(start[first]), pa.array(strings[first].astype(np.int32)),
         pa.array(before[first].astype(np.int32)), pa.array(anchor[first].view(np.int64)), pa.array(whole[first].view(np.int64)), more],
        ["key", "base", "start", "strings", "before", "anchor", "whole", "more"])


def find_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The stretches of all texts of ``docs`` (key, base, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, most=CHUNK_BYTES // 2):
            yield _stretch_batch(rows, at, stretches(data, at, length, gram))

    return map_arrow(docs, run, _STRETCH)


def _with_texts(docs: DataFrame, lists: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return docs.join(lists.hint("shuffle_hash"), on, how)


def cut(source: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """(key, base, strings, before, anchor, large, text): the bytes of each stretch of ``members``, cut from the
    texts of ``source`` (key, base, text) once; ``base`` is now the stretch's own start."""
    fields = ["start", "strings", "before", "anchor", "large"]
    lists = members.groupBy("key", "base").agg(F.collect_set(F.struct(*fields)).alias("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat share a key: one of them is enough
        for rows, data, at in chunks(batches):
            keys = list(zip(*(_column(rows, "key").field(i).to_pylist() for i in range(2)), _column(rows, "base").to_pylist()))
            lists = _column(rows, "picked")
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(len(keys), bool)
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            doc = np.repeat(np.arange(len(keys)), sizes)
            use = np.flatnonzero(new[doc])
            doc, flat = doc[use], flat.take(pa.array(use))
            start, strings = flat.field(0), flat.field(1)
            lo = at[doc] + start.to_numpy() - _numbers(rows, "base")[doc]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(lo.tolist(), (lo + strings.to_numpy() - 1 + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [_column(rows, "key").take(pa.array(doc)), start, strings, flat.field(2), flat.field(3), flat.field(4), pa.array(texts, pa.binary())],
                ["key", "base", "strings", "before", "anchor", "large", "text"])

    return map_arrow(_with_texts(source, lists, ["key", "base"]).select("key", "base", "text", "picked"), run,
                     f"{_KEY}, strings int, before int, anchor long, large boolean, text binary")


def divide(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """The stretches of ``pieces`` cut where (anchor - string) is a multiple of ``width``; the new anchor is the hash of the
    bytes that all strings of such a range hold, with the old one and the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            before, strings, old = (_numbers(rows, n) for n in ("before", "strings", "anchor"))
            h = prefix_hash(data)
            lowest = (before - strings + 1) // width
            n = before // width - lowest + 1
            of = np.repeat(np.arange(len(before)), n)
            cell = lowest[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            most = np.minimum(before[of], cell * width + width - 1)
            least = np.maximum(before[of] - strings[of] + 1, cell * width)
            anchor = at[of] + before[of]
            start, strings = anchor - most, most - least + 1
            common = anchor - cell * width
            with np.errstate(over="ignore"):
                new = mix(span_hash(h, common, common + length - width + 1) + old[of].astype(np.uint64)
                          + mix(cell.astype(np.uint64)))
                whole = span_hash(h, start, start + strings - 1 + length) + mix((most * 512 + strings).astype(np.uint64))
            yield _stretch_batch(rows, at, (of, start, strings, most, new, whole))

    return map_arrow(pieces.select("key", "base", "strings", "before", "anchor", "text"), run, _STRETCH)


def _stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable argsort of 32-bit symbols in two counting passes."""
    one = np.argsort(symbols.astype(np.uint16), kind="stable")
    high = (symbols >> 16).astype(np.uint16)
    return one if not high.any() else one[np.argsort(high[one], kind="stable")]


def block_symbols(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol that starts at each position and the position before it, for strings over blocks of ``width`` bytes.

    A string of n bytes has n + 1 positions; those without a whole block end a phase,
    have symbol 0, and stand before the phase's first position.
    """
    n = np.diff(at)
    base = at[:-1] + np.arange(len(n))  # one more position for each string before
    doc = np.repeat(np.arange(len(n)), n + 1)
    local = np.arange(len(doc)) - base[doc]
    full = local + width <= n[doc]
    symbol = np.zeros(len(doc), np.uint64)
    byte = at[doc[full]] + local[full]
    symbol[full] = span_hash(prefix_hash(data), byte, byte + width) | np.uint64(1)
    end = local + width * ((n[doc] - local) // width)
    before = np.where(local >= width, local - width, end) + base[doc]
    return symbol, before


def shard_transform(symbol: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a shard in the order of their first ``depth`` symbols, and its transform: the symbol before each."""
    order = np.arange(len(symbol))
    for _ in range(depth):
        order = before[order]
        order = order[_stable_order(symbol[order])]
    return order, symbol[before[order]]


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): the shard of each suffix of the union in order, and the symbols (at most ``depth``)
    that it has in common with the suffix before it."""
    interleave = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(interleave), np.int32)
    common = np.full(len(interleave), depth, np.int16)
    common[:1] = 0
    for passed in range(1, depth + 1):
        symbols = np.empty(len(interleave), np.uint32)
        for shard, transform in enumerate(transforms):
            symbols[interleave == shard] = transform
        order = _stable_order(symbols)
        interleave, symbols, block = interleave[order], symbols[order], block[order]
        edge = np.zeros(len(order), bool)
        edge[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        common[edge & (common == depth)] = passed - 1
        block = np.cumsum(edge, dtype=np.int32)
    return interleave, common


def repeated_strings(strings: list[tuple[np.ndarray, np.ndarray]], length: int = LENGTH, width: int = SYMBOL) -> list[np.ndarray]:
    """For each shard (bytes, offsets of its strings): which positions start ``length`` bytes that start elsewhere too.

    Positions as in ``block_symbols``; ``width`` divides ``length``.
    """
    depth = length // width
    parts = [block_symbols(data, at, width) for data, at in strings]
    alphabet, ranks = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
    ranks = np.split(ranks.astype(np.uint32) + np.uint32(alphabet[0] != 0), np.cumsum([len(s) for s, _ in parts])[:-1])
    built = [shard_transform(r, before, depth) for r, (_, before) in zip(ranks, parts)]
    interleave, common = merge_transforms([t for _, t in built], depth)
    equal = np.append(common >= depth, False)
    repeats = equal[:-1] | equal[1:]  # members of an interval of two or more
    out = []
    for shard, ((order, _), (_, at)) in enumerate(zip(built, strings)):
        flag = np.zeros(len(order), bool)
        flag[order] = repeats[interleave == shard]
        n = np.diff(at)
        left = np.repeat(n, n + 1) - (np.arange(len(flag)) - np.repeat(at[:-1] + np.arange(len(n)), n + 1))
        out.append(flag & (left >= length))
    return out


def compare(pieces: DataFrame, tasks: int, length: int, width: int) -> DataFrame:
    """(key, starts, strings): the strings of ``pieces`` that occur in another one too."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw = table.column("text")
        at = np.concatenate(([0], np.cumsum(pa.compute.binary_length(raw).to_numpy()))).astype(np.int64)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        shards, edges, lo = [], [], 0
        while lo < len(raw):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max(BYTES_PER_SHARD, len(data) // 1000), "right")) - 1)
            shards.append((data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]))
            edges.append(lo)
            lo = hi
        row, start, strings = [], [], []
        for first, (_, own), flag in zip(edges, shards, repeated_strings(shards, length, width)):
            step = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # a string's last positions are never set
            base = own[:-1] + np.arange(len(own) - 1)
            i = np.searchsorted(base, a, "right") - 1
            row.append(first + i)
            start.append(a - base[i])
            strings.append(b - a)
        row = np.concatenate(row)
        start = (table.column("base").to_numpy()[row] + np.concatenate(start)).astype(np.int32)
        return pa.table({"key": table.column("key").take(pa.array(row)),
                         "starts": pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32), pa.array(start)),
                         "strings": pa.array(np.concatenate(strings).astype(np.int32))})

    dealt = pieces.select(F.pmod("anchor", F.lit(tasks)).alias("part"), "key", "base", "text")
    return dealt.groupBy("part").applyInArrow(merge, "key struct<a: long, b: long>, starts array<int>, strings int")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = SYMBOL) -> DataFrame:
    """(key, repeats: array<struct<starts: array<int>, strings: int>>) for the texts of ``docs`` (key, text) that hold
    repeated strings, stored; what was stored on the way is deleted."""
    docs = docs.select("key", F.lit(0).alias("base"), "text")
    with Tables(docs.sparkSession) as tables:
        found = find_stretches(docs, length, gram)
        # Counts are stored before they are joined: a join of two plain exchanges can be split where an anchor is hot.
        copies = F.sum(F.size("more") + 1)
        often = tables.store(found.groupBy("anchor").agg(copies.alias("n")).filter("n > 1").select("anchor"), "often")
        rows = tables.store(found.join(often, "anchor", "left_semi").select(*found.columns), "stretches")
        tables.drop("often")
        source, sure, different = docs, [], []
        for step, finer in enumerate((16, 1, None)):
            kinds = tables.store(rows.groupBy("anchor", "whole").agg(copies.alias("copies"), F.min(
                F.struct("key", "base", "start", "strings", "before")).alias("one")), f"kinds{step}")
            many = kinds.filter("copies > 1").select("anchor", "whole")
            sure.append(tables.store(rows.join(many, ["anchor", "whole"], "left_semi").select(
                "key", F.concat(F.array("start"), "more").alias("starts"), "strings"), f"sure{step}"))
            tables.drop("stretches", "divided")
            crowd = tables.store(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "crowd")
            large = F.lit(False) if finer is None else F.col("n") > MOST_STRETCHES
            members = kinds.select("anchor", "one.*").join(crowd, "anchor").withColumn("large", large).drop("n")
            pieces = tables.store(cut(source, members, length), f"pieces{step}")
            tables.drop(f"kinds{step}", "crowd")
            different.append(pieces.filter("not large"))
            crowded = pieces.filter("large")
            if crowded.isEmpty():
                break
            source = crowded.select("key", "base", "text")
            rows = tables.store(divide(crowded, finer, length), "divided")
        picked = _union(different)
        size = picked.agg(F.sum(F.col("strings") - 1 + length)).first()[0] or 0
        told = _union([*sure, compare(picked, max(1, ceil(size / BYTES_PER_TASK)), length, width)])
        return stored(told.groupBy("key").agg(F.collect_set(F.struct("starts", "strings")).alias("repeats")), "repeats")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _covered(rows: pa.RecordBatch, at: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of the chunk a repeated string covers."""
    lists = _column(rows, "repeats")
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    step = np.zeros(at[-1] + 1, np.int32)
    if len(doc):
        starts, strings = flat.field(0), flat.field(1).to_numpy()
        n = starts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        lo = at[np.repeat(doc, n)] + starts.flatten().to_numpy()
        np.add.at(step, lo, 1)
        np.add.at(step, lo + np.repeat(strings, n) - 1 + length, -1)
    return np.cumsum(step[:-1]) > 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       text_column(text_col).alias("text"))


def dedup_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    Null texts are empty and, like any text shorter than ``length``, lose
    nothing.  Rows that repeat are documents of their own, so their strings
    repeat.  An empty table gives an empty result.  Only id and text are read.
    """
    keyed = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            gone = _covered(rows, at, length)
            kept = np.concatenate(([0], np.cumsum(~gone)))[at].tolist()
            left = data[~gone].tobytes()
            first = gone.copy()
            first[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), at)
            spans = np.concatenate(([0], np.cumsum(first)))[at]
            yield pa.RecordBatch.from_arrays(
                [_column(rows, "doc_id"), pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(kept)), pa.array(np.diff(spans)),
                 pa.array([hashlib.sha256(left[i:j]).hexdigest() for i, j in zip(kept, kept[1:])])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_texts(keyed, repeated(keyed, length), ["key"], "left").select("doc_id", "text", "repeats")
    return map_arrow(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                    count_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with repeated bytes removed from their texts.

    Where a cut would split a character, the bytes left of it go too.  Texts without
    repeats (null ones too) stay as they are; ``count_col``, if there, gets the new number of characters.
    """
    names = docs.columns
    place, count = names.index(text_col), names.index(count_col) if count_col in names else None
    renamed = docs.select(row_key(id_col, text_col).alias("key"), text_column(text_col).alias("text"),
                          *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            columns = [_column(rows, f"c{i}") for i in range(len(names))]
            gone = _covered(rows, at, length)
            if gone.any():
                lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[at]).tolist()
                texts = columns[place].to_pylist()
                counts = columns[count].to_pylist() if count is not None else None
                for i, n in enumerate(lost):
                    if n:
                        own = data[at[i]:at[i + 1]]
                        texts[i] = own[~gone[at[i]:at[i + 1]]].tobytes().decode("utf-8", "ignore")
                        if counts is not None:
                            counts[i] = len(texts[i])
                columns[place] = pa.array(texts, columns[place].type)
                if counts is not None:
                    columns[count] = pa.array(counts, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    found = _with_texts(renamed, repeated(renamed.select("key", "text"), length), ["key"], "left")
    return map_arrow(
        found.select("text", "repeats", *[f"c{i}" for i in range(len(names))]), run, renamed.select(*[f"c{i}" for i in range(len(names))]).schema).toDF(*names)
