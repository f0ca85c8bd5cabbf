"""Secret scans: fixed shapes, and random strings shown by their token efficiency.

Shapes are assignments to names such as ``password``, access keys and long
hexadecimal runs.  Beyond them, a run of credential characters is tokenised:
prose and names take three or more characters a token, random strings under
``MOST_CHARS_PER_TOKEN``; runs without a digit, among them long words of
languages that the vocabulary knows little of, must stay under
``MOST_WITHOUT_DIGITS``.  Runs that are digests (hexadecimal of a usual
length), UUIDs or plain numbers (no letter) are left out.

Texts are worked on as UTF-8 bytes; every character that a shape names is
ASCII, so spans are the same as over code points, and their offsets are
converted.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.llm.text import chunks, map_arrow, text_column

# The shapes.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512; the shape of a UUID.
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_WORD = re.compile(rb"[0-9A-Fa-f]+")

RANDOM_LEAST, MOST_CHARS_PER_TOKEN, MOST_WITHOUT_DIGITS = 16, 2.2, 1.9
_TOKENISED_AT_ONCE = 1024  # a longer run is tokenised in parts, so its cost stays in proportion

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(data: np.ndarray, at: np.ndarray, wanted: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each text its maximal runs of wanted bytes, ``least`` or longer, as offsets in the chunk."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(at) - 1)]
    if not len(data):
        return out
    on = wanted[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[at] = True
    before = np.concatenate(([False], on[:-1])) & ~opens[:-1]
    after = np.concatenate((on[1:], [False])) & ~opens[1:]
    lo, hi = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    long_ = hi - lo >= least
    lo, hi = lo[long_], hi[long_]
    for d, a, b in zip((np.searchsorted(at, lo, "right") - 1).tolist(), lo.tolist(), hi.tolist()):
        out[d].append((a, b))
    return out


def is_random(run: bytes, path: str) -> bool:
    """Few characters a token, and neither a digest nor an identifier."""
    body = run.strip(b"=-_/+")
    if len(body) < RANDOM_LEAST or not re.search(rb"[A-Za-z]", body):
        return False
    if _UUID.fullmatch(body) or (len(body) in _DIGEST_LENGTHS and _HEX_WORD.fullmatch(body)):
        return False
    text = body.decode("ascii")
    tokens = sum(len(_encoding(path).encode_ordinary(text[i:i + _TOKENISED_AT_ONCE])) for i in range(0, len(text), _TOKENISED_AT_ONCE))
    return len(text) < (MOST_CHARS_PER_TOKEN if re.search(rb"[0-9]", body) else MOST_WITHOUT_DIGITS) * tokens


def chunk_spans(data: np.ndarray, at: np.ndarray, path: str) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, kind, end) in bytes, by start, then kind."""
    raw = data.tobytes()
    hexes, words = runs(data, at, _HEX, HEX_LEAST), runs(data, at, _RUN, RANDOM_LEAST)
    out = []
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        text = raw[lo:hi]
        spans = [(a - lo, 2, b - lo) for a, b in hexes[i]]
        if b":" in text or b"=" in text:
            spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if b"AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [(a - lo, 3, b - lo) for a, b in words[i] if is_random(raw[a:b], path)]
        out.append(sorted(spans))
    return out


def to_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))).tolist()
    return [(before[a], kind, before[b]) for a, kind, b in spans]


def scan(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row.

    Null and empty texts have no spans; rows that repeat have equal results; an empty
    table gives an empty one.  Only id and text are read.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            n, base, all_ = [[], [], [], []], [], []
            for lo, hi, spans in zip(at[:-1].tolist(), at[1:].tolist(), chunk_spans(data, at, path)):
                told = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in (to_code_points(data[lo:hi].tobytes(), spans) if spans else ())]
                for kind, column in enumerate(n):
                    column.append(sum(k == kind for k, _ in told))
                base.append(hashlib.sha256(",".join(s for k, s in told if k < 3).encode()).hexdigest())
                all_.append(",".join(s for _, s in told))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(base), pa.array(all_)], names)

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return map_arrow(plain, run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_bytes(text: bytes, spans: list[tuple[int, int, int]], mark: bytes) -> bytes:
    """The text with every maximal stretch of overlapping spans replaced by the mark."""
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return b"".join([*out, text[end:]])


def redacted(docs: DataFrame, path: str, text_col: str = "text", mark: str = "[SECRET]",
             count_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with the spans of their texts replaced by ``mark``; other texts (null too) stay as they are.

    ``count_col``, if there, gets the new number of characters.
    """
    names = docs.columns
    place, count = names.index(text_col), names.index(count_col) if count_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, "c0"):
            columns = list(rows.columns[1:])
            found = chunk_spans(data, at, path)
            if any(found):
                own = columns[place]
                texts = own.to_pylist()
                counts = columns[count].to_pylist() if count is not None else None
                for i, spans in enumerate(found):
                    if spans:
                        texts[i] = redact_bytes(data[at[i]:at[i + 1]].tobytes(), spans, mark.encode()).decode()
                        if counts is not None:
                            counts[i] = len(texts[i])
                columns[place] = pa.array(texts, own.type)
                if counts is not None:
                    columns[count] = pa.array(counts, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, [f"c{i + 1}" for i in range(len(names))])

    # Renamed by place on the way, so columns of any name pass through.
    kept = docs.select(text_column(text_col).alias("c0"), *[F.col(f"`{c}`").alias(f"c{i + 1}") for i, c in enumerate(names)])
    return map_arrow(kept, run, kept.drop("c0").schema).toDF(*names)
