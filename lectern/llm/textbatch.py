"""Whole texts of an Arrow batch as NumPy arrays: bytes, words and word hashes.

A batch is cut into slices of bounded bytes, so that the arrays stay small whatever the batch size is; a
text is never cut. Words are the runs of bytes other than the six ASCII white-space characters, which no
UTF-8 sequence of another character contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WHITE_SPACE = b" \t\n\v\f\r"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(WHITE_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Odd bases of the polynomial word hashes; two of them make a key of 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WRAP = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, _WRAP)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (_powers(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS = {base: Powers(base) for base in BASES}


@dataclass
class Slice:
    """Some consecutive texts: rows [first, last) of the batch."""

    first: int
    last: int
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text starts in data, and the end

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Byte ranges of the words of a slice; text i has the words [bounds[i], bounds[i + 1])."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a string column in slices of about ``limit`` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(IS_SPACE[data], out=solid[1:-1])
    begins = solid[1:] & ~solid[:-1]
    stops = solid[:-1] & ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    touching = inner[solid[inner] & solid[inner + 1]]  # a text that ends with a word before one that starts with one
    begins[touching] = True
    stops[touching] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, words: Words, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, from running sums of a polynomial."""
    up, down = _POWERS[base].upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[words.ends] - sums[words.starts]) * down[words.starts])


def gram_hashes(hashes: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp: a hash of every n consecutive words, also of those that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS[base].upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def run_hashes(hashes: np.ndarray, bounds: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A hash of all words of each text."""
    up, down = _POWERS[base].upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]])


def whole_grams(words: Words, n: int) -> np.ndarray:
    """Of the grams that start at each word: does it lie within one text?"""
    total = int(words.bounds[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    room = np.repeat(words.bounds[1:], words.counts) - np.arange(total)
    return room[: total - n + 1] >= n


def text_of_word(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.bounds) - 1), words.counts)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as the bigint of the same bits."""
    return pa.array(x.view(np.int64))
