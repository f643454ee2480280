"""Words and word hashes of Arrow text batches, computed on whole byte buffers.

UTF-8 keeps ASCII bytes apart from those of other characters, so both word rules of this package
(white space as separator; everything but letters, digits and non-ASCII as separator) can be told
byte by byte. Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
SPACED = np.ones(256, dtype=bool)  # words are runs of anything but white space
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)  # words are runs of 0-9, a-z and non-ASCII
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_RANDOM = np.random.RandomState(20240229)
BYTE_CODES = _RANDOM.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
SHINGLE_FACTORS = _RANDOM.randint(1, 2**63 - 1, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 20  # bytes of text hashed at once; a longer text makes a chunk of its own
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of a chunk of texts; positions are byte offsets into ``data`` (lower-cased)."""

    first: int  # number of the first text within the batch
    data: np.ndarray
    bounds: np.ndarray  # byte bounds of the texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray  # word bounds of the texts: text i has words offsets[i] .. offsets[i+1]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``width`` words, and whether the run stays within one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += self.hash[j : j + n] * SHINGLE_FACTORS[j]
        owner = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        return mix(total), owner[:n] == owner[width - 1 :]

    def text_of(self, word: int, count: int = 1) -> bytes:
        """The words from ``word`` on, joined by single blanks."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(word, word + count))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 bounds of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def chunks(bounds: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, last
        first = last


def words(column: pa.Array, letters: np.ndarray) -> Iterator[Words]:
    """The words of each text after lower-casing A-Z, a bounded chunk of texts at a time."""
    data, bounds = text_buffers(column)
    for first, last in chunks(bounds):
        low, high = int(bounds[first]), int(bounds[last])
        part = LOWER_BYTES[data[low:high]]
        yield _words(first, part, bounds[first : last + 1] - low, letters)


def _words(first: int, data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> Words:
    n = len(data)
    inside = letters[data]
    starts, ends = inside.copy(), np.empty(n + 1, bool)
    starts[1:] &= ~inside[:-1]
    ends[0] = False
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]  # a word never goes on into the next text
    starts[edges] = inside[edges]
    ends[edges] = inside[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * _power(BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(BASE_INVERSE, n + 1)[start]) if n else np.zeros(0, np.uint64)
    return Words(first, data, bounds, start, end, hashes, np.searchsorted(start, bounds))
