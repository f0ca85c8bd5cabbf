"""Pre-tokens of byte-level BPE vocabularies, found for whole chunks at once.

The split is that of the vocabularies' pattern (contractions; runs of letters,
of numbers, of other signs, each with one space before it; white space up to
the last one before a word), derived from class changes between code points.
Merges never cross a pre-token, so each distinct one is encoded once and its ids
are reused wherever it stands.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache

import numpy as np
import tiktoken

from leaserisk.llm.text import prefix_hash, span_hash

LETTER, NUMBER, SPACE, SIGN = 1, 2, 3, 4
# The code points with Unicode's White_Space property.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe as a contraction.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


@cache
def _class_of() -> np.ndarray:
    """The class of each code point, asked of the library: Python's own tables may be of another Unicode version."""
    points = np.setdiff1d(np.arange(sys.maxunicode + 1, dtype="<u4"), np.arange(0xD800, 0xE000, dtype="<u4"))
    text = points.tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    table = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(asked.encode_ordinary(text)).decode()  # what the pattern does not match is left out
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    table[_WHITE] = SPACE
    return table


def boundaries(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where pre-tokens start (and the end), and the texts' first pre-tokens (n + 1 entries)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    kind = _class_of()[points]
    opens = np.zeros(n + 1, bool)  # the first code point of each text
    opens[np.searchsorted(byte_of, at)] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | opens[1:n]
    start = change.copy()
    white = kind == SPACE
    # The last white space before a word stands apart; a plain space there joins the word.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~opens[1:n])
    start[last] = True
    joins = last[points[last] == 0x20]
    start[joins + 1] = False
    # Contractions: a lone apostrophe that starts a pre-token, and the letters after it.
    tick = np.flatnonzero((points == 0x27) & start)
    tick = tick[tick + 1 < n]
    tick = tick[change[tick + 1] & ~opens[tick + 1]]
    follow = np.append(points, [0, 0])
    inside = lambda i: (i < n) & ~opens[np.minimum(i, n)]
    short = np.isin(follow[tick + 1], [ord(c) for c in _SHORT])
    long_ = np.zeros(len(tick), bool)
    for a, b in _LONG:
        long_ |= (follow[tick + 1] == ord(a)) & (follow[tick + 2] == ord(b)) & inside(tick + 2)
    for found, size in ((tick[short], 2), (tick[long_ & ~short], 3)):
        start[found + 1] = False
        after = found + size
        start[after[inside(after)]] = True
    first = np.flatnonzero(start)
    cuts = np.append(byte_of[first], len(data))
    return cuts, np.searchsorted(cuts, at)


class PretokenCache:
    """Ids of pre-tokens, kept between the chunks of a task up to a number of distinct ones.

    ``encode`` gets distinct pre-tokens and returns their ids as one array,
    with each one's start and length in it.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[bytes]) -> None:
        flat, starts, sizes = self.encode(words)
        if len(flat) and flat.max() > np.iinfo(self.flat.dtype).max:  # a vocabulary of over 65,536 entries
            self.flat = self.flat.astype(np.uint32)
        self.place.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts = np.concatenate((self.starts, starts + self.used))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(flat)

    def chunk_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, and the texts' offsets among them."""
        cuts, first = boundaries(data, at)
        if len(cuts) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        h = prefix_hash(data)
        keys = span_hash(h, cuts[:-1], cuts[1:]) + np.diff(cuts).astype(np.uint64)
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[i:j] for i, j in zip(cuts[where].tolist(), cuts[where + 1].tolist())]
        if len(self.place) + len(words) > self.most:
            self._clear()
        if new := [w for w in words if w not in self.place]:
            self._add(new)
        own = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[which]
        n = self.sizes[own]
        ends = np.cumsum(n)
        out = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[own] - ends + n, n)]
        return out.astype(np.uint32), np.concatenate(([0], ends))[first]
