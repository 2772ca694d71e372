"""Vector work on the text columns of Arrow batches: one byte buffer and offsets instead of a Python object per text."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; a longer text forms a block of its own.
BLOCK = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x = x * _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ROOT)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary column one after another, and where each starts and the last ends. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(pa.large_string()) if pa.types.is_string(column.type) else column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(kind)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold at most limit bytes, or one text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_blocks(column, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive ranges of a column."""
    data, offsets = column_bytes(column)
    for i, j in spans(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    give_back()


def _trimmer():
    try:
        return ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
    except (OSError, AttributeError):  # not the GNU library: nothing to do
        return lambda _: 0


_TRIM = _trimmer()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for tasks of other kinds, and would keep the largest it ever had."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space, and the text that each belongs to. Runs end with their text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    ink = ~SPACES[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | cut[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


class Hasher:
    """Polynomial hashes of any slices of a block, from one prefix sum. Powers are kept for the largest block so far, up to `keep` bytes."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15 | 1, keep: int = 4 << 20):
        self.base, self.keep = base, keep
        self.inverse = pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) >= n:
            return self._up, self._down
        up, down = (np.full(n, x, np.uint64) for x in (self.base, self.inverse))
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if n <= self.keep:
            self._up, self._down = up, down
        return up, down

    def load(self, data: np.ndarray) -> Hasher:
        """data: byte values, or 64-bit codes of larger units."""
        n = len(data)
        up, self._now = self._powers(n + 1)
        codes = BYTE_CODES[data] if data.dtype == np.uint8 else data
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=self._sums[1:])
        return self

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._now[starts] + (ends - starts).astype(np.uint64) * _ROOT)

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all slices of one width."""
        n = len(self._sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:n]) * self._now[:n] + np.uint64(width * int(_ROOT) % 2**64))


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` consecutive keys."""
    have, out = 1, keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of the sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new
