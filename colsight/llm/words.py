"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Words are maximal runs outside space, tab, newline, vertical tab, form feed and carriage
return. Texts are cut at byte level: all six are ASCII, so no character is split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
LONG_WORD = 64

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_STEP = np.uint64(int(_rng.integers(1, 2**62)) * 8 + 3)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes between words if these are to be letters and digits (and all of non-ASCII) only.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hash of every word; the power tables are kept between chunks."""

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.values = _LOWER_VALUES if lower else _BYTE_VALUES
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):  # pieces, so that the 8-byte arrays stay small
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
            h[i:j] = self._piece(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
            i = j
        sizes = (ends - starts).astype(np.uint64)
        h = mix(h + sizes * np.uint64(0x9E3779B97F4A7C15))
        # A polynomial over long structured words can collide; those few are digested.
        for i in np.flatnonzero(sizes > LONG_WORD):
            word = data[starts[i] : ends[i]].tobytes()
            digest = hashlib.blake2b(word.lower() if self.lower else word, digest_size=8).digest()
            h[i] = np.frombuffer(digest, np.uint64)[0]
        return h

    def _piece(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            self.up = _powers(_BASE, size)
            self.down = _powers(pow(_BASE, -1, 2**64), size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]


class Words:
    """Word bounds of a chunk of texts. ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        self.data = data
        space = between[data]
        n = len(data)
        at_start = np.zeros(n + 1, bool)
        at_start[offsets] = True
        before = np.ones(n, bool)
        after = np.ones(n, bool)
        if n:
            before[1:] = space[:-1]
            after[:-1] = space[1:]
        self.starts = np.flatnonzero(~space & (before | at_start[:n]))
        self.ends = np.flatnonzero(~space & (after | at_start[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of the text each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def place(self) -> np.ndarray:
        """Position of each word in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def whole(self, size: int) -> np.ndarray:
        """Positions at which a window of ``size`` words fits into its text."""
        end = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(len(self.starts)) + size <= end)


def rolling(h: np.ndarray, size: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hash of the ``size`` words from each position on (windows at the very end left out)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= step
        out += h[k : k + n]
    return mix(out + np.uint64(size))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES, between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of pieces of up to ``size`` bytes; a longer text
    is a piece of its own, so memory is bounded by the longest text."""
    data, offsets = text_bytes(column)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, Words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], between)
        row = stop
