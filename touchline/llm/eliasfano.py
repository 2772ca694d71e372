"""Elias-Fano sequences that are read in place, such as from memory-mapped files: a rising sequence of n numbers below u takes about 2 + log2(u / n) bits each."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the r-th one of each byte, by r * 256 + byte.
_IN_BYTE = np.zeros(8 * 256, np.int64)
for _byte in range(256):
    for _r, _place in enumerate(i for i in range(8) if _byte >> i & 1):
        _IN_BYTE[_r * 256 + _byte] = _place


def select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th one, from 0, of each 64-bit word (Vigna, 2008)."""
    s = words - ((words >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    r = rank.astype(np.uint64)
    at = np.bitwise_count(((r * _ONES | _HIGHS) - s) & _HIGHS).astype(np.uint64) * _U(8)
    r -= ((s << _U(8)) >> at) & _U(0xFF)
    return at.astype(np.int64) + _IN_BYTE[(r << _U(8) | (words >> at) & _U(0xFF)).astype(np.int64)]


def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """Parts of a rising uint64 sequence below `universe`, equal neighbours allowed: head, low bits, high bits in unary, and the ones before each word of these."""
    n = len(values)
    low = max(0, min(56, (universe // max(1, n)).bit_length() - 1))
    packed = []
    for i in range(0, n, 1 << 15):  # a multiple of 8, so that each step ends with a byte
        bits = (values[i : i + (1 << 15), None] >> np.arange(low, dtype=np.uint64)) & _U(1)
        packed.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    high = (values >> _U(low)).astype(np.int64)
    size = n + (universe >> low) + 2
    unary = np.zeros(-(-size // 64) * 64, bool)
    unary[high + np.arange(n)] = True
    words = np.packbits(unary, bitorder="little").view("<u8")
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
    lows = np.concatenate([*packed, np.zeros(8, np.uint8)])
    return [np.array([n, low, len(lows), len(words)], "<i8"), lows, words, ones.astype("<i8")]


class Sequence:
    """Reads what `encode` made, from an array of bytes and a place in it."""

    def __init__(self, data: np.ndarray, at: int = 0):
        self.n, self.low, lows, words = (int(x) for x in data[at : at + 32].view("<i8"))
        at += 32
        # the eight bytes from each byte on, read in place
        self._lows64 = np.ndarray((lows - 7,), "<u8", data[at : at + lows], strides=(1,))
        at += lows + -lows % 8
        self.words = data[at : at + 8 * words].view("<u8")
        at += 8 * words
        self.ones = data[at : at + 8 * words].view("<i8")
        self.zeros = 64 * np.arange(words) - self.ones
        self.end = at + 8 * words

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero, from 0."""
        j = np.searchsorted(self.zeros, k, "right") - 1
        return j * 64 + select(~self.words[j], k - self.zeros[j])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        return (self._lows64[bit >> 3] >> (bit & 7).astype(np.uint64)) & _U((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        j = np.searchsorted(self.ones, i, "right") - 1
        high = j * 64 + select(self.words[j], i - self.ones[j]) - i
        return high << self.low | self._lows(i).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Rank of each x in the sequence, -1 where it isn't: a search for its successor among the numbers with its high bits, by halving, as these may be many where the sequence is dense."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        high = (x >> _U(self.low)).astype(np.int64)
        low = x & _U((1 << self.low) - 1)
        inside = np.flatnonzero(high < self.zeros[-1] + 64 - np.bitwise_count(self.words[-1]))
        high, low = high[inside], low[inside]
        begin = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high > 0)
        begin[later] = self._zero(high[later] - 1) + 1 - high[later]
        end = self._zero(high) - high
        last = end.copy()
        live = np.flatnonzero(begin < end)
        while len(live):
            middle = (begin[live] + end[live]) >> 1
            less = self._lows(middle) < low[live]
            begin[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[begin[live] < end[live]]
        there = np.flatnonzero(begin < last)
        there = there[self._lows(begin[there]) == low[there]]
        out[inside[there]] = begin[there]
        return out


class Children:
    """A level of a trie: for each node of the level above, the rising numbers of its children.

    Pointers, a rising sequence, tell where each node's children begin. Each child's number is stored on top of the last
    number before its node's, so that the whole level rises; a search goes from the node's own offset to the successor of
    the number in the node's range.
    """

    def __init__(self, data: np.ndarray, at: int):
        self.pointers = Sequence(data, at)
        self.numbers = Sequence(data, self.pointers.end)
        self.end = self.numbers.end

    @staticmethod
    def encode(counts: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        """counts: of the children of each node; numbers: of all children, node by node, rising within one."""
        pointers = np.concatenate(([0], np.cumsum(counts)))
        filled = np.flatnonzero(counts)
        tops = numbers[pointers[filled + 1] - 1].astype(np.uint64) + _U(1) if len(filled) else np.empty(0, np.uint64)
        offsets = np.zeros(len(counts), np.uint64)
        offsets[filled] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tops)[:-1])) if len(filled) else 0
        level = numbers.astype(np.uint64) + np.repeat(offsets, counts)
        universe = int(tops.sum()) if len(tops) else 1
        return [*encode(pointers.astype(np.uint64), int(pointers[-1]) + 1), *encode(level, universe)]

    def ranges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First child, the one after the last, and the offset of each node's numbers."""
        begin, end = self.pointers.access(nodes), self.pointers.access(nodes + 1)
        offset = np.zeros(len(nodes), np.int64)
        later = np.flatnonzero((begin > 0) & (begin < end))
        offset[later] = self.numbers.access(begin[later] - 1) + 1
        return begin, end, offset

    def find(self, begin: np.ndarray, end: np.ndarray, offset: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The child of each range with the given number, -1 where there is none."""
        got = self.numbers.find(offset + numbers)
        return np.where((got >= begin) & (got < end), got, -1)


def padded(parts: list[np.ndarray]) -> bytes:
    """Arrays one after another, each from a multiple of 8 bytes on."""
    out = []
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)
