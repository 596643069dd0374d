"""Elias-Fano sequences and the levels of an n-gram trie made of them.

A monotone sequence of n numbers below u keeps the low log2(u / n) bits of each number as they are and the
rest as gaps in unary: about 2 + log2(u / n) bits a number. Numbers are read and searched in place, many at a
time: a select finds the bucket of the high bits, a binary search within it the low ones.

A level holds the n-grams of one length of one shard. Contexts are the nodes of the level above; successors
are known by their place among the successors of the shorter context. Three sequences (contexts, pointers to where
their successors begin, successors) and two arrays of quantised numbers (log-probability, back-off) are one
byte string, which `mapped` puts into an unlinked file and maps into memory.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

#: Place of the k-th set bit of a byte.
_SELECT = np.array([[*(i for i in range(8) if b >> i & 1), *[8] * 8][:8] for b in range(256)], np.uint8)

_FIVES, _THREES, _FIFTEENS, _ONES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))


def mapped(raw: bytes) -> memoryview:
    """raw as memory that is backed by a file without a name: it can be paged out, and leaves nothing behind."""
    with tempfile.TemporaryFile() as f:
        f.write(raw or b"\0")
        f.flush()
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, by byte places, which compresses well."""
    x = np.asarray(x).astype("<u8", copy=False)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    rest = x.astype("<u4") if width <= 4 else x.copy()
    planes = np.empty((width, len(x)), np.uint8)
    for plane in planes:
        np.copyto(plane, rest, casting="unsafe")
        rest >>= rest.dtype.type(8)
    return bytes([width]) + planes.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = planes[-1].astype(np.uint32 if len(planes) <= 4 else np.uint64)
    for plane in planes[-2::-1]:
        out <<= out.dtype.type(8)
        out |= plane
    return out.astype(np.uint64, copy=False)


class EliasFano:
    """A monotone sequence over a byte string that `encode` made."""

    def __init__(self, raw):
        self.n, self.low_bits, high_words = struct.unpack_from("<QQQ", raw)
        self.high = np.frombuffer(raw, "<u8", high_words, 24)
        at = 24 + 8 * high_words
        low_bytes = self.n * self.low_bits // 8 + 9
        # any eight bytes of the low bits as a number
        self.low = np.ndarray((low_bytes - 7,), "<u8", raw, at, (1,))
        self.size = at + low_bytes
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.append(0, np.cumsum(ones))
        self.zeros = 64 * np.arange(high_words + 1) - self.ones
        self.places: dict[int, np.ndarray] = {}

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        ends = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ends[-1]) + 2 if n else 1) // 64 * 64 + 64, np.uint8)
        high[ends] = 1
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=low_bits, bitorder="little")
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        return struct.pack("<QQQ", n, low_bits, len(high) // 64) + np.packbits(high, bitorder="little").tobytes() + low.ljust(n * low_bits // 8 + 9, b"\0")

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high bits. For many k all places are listed once."""
        sums = self.ones if bit else self.zeros
        if bit not in self.places and 8 * len(k) >= sums[-1]:
            self.places[bit] = np.flatnonzero(np.unpackbits((self.high if bit else ~self.high).view(np.uint8), bitorder="little").view(bool))
        if bit in self.places:
            return self.places[bit][k]
        word = np.searchsorted(sums, k, "right") - 1
        rest = k - sums[word]
        bits = self.high[word] if bit else ~self.high[word]
        # in byte i of upto the ones of bytes 0 to i; those that are at most rest have their top bit set in the difference
        upto = bits - (bits >> np.uint64(1) & _FIVES)
        upto = (upto & _THREES) + (upto >> np.uint64(2) & _THREES)
        upto = (upto + (upto >> np.uint64(4)) & _FIFTEENS) * _ONES
        byte = np.bitwise_count((rest.astype(np.uint64) * _ONES | _TOPS) - upto & _TOPS)
        shift = byte.astype(np.uint64) << np.uint64(3)
        rest -= (upto << np.uint64(8) >> shift & np.uint64(255)).astype(np.int64)
        return 64 * word + 8 * byte.astype(np.int64) + _SELECT[(bits >> shift & np.uint64(255)).astype(np.int64), rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return (self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first number that is at least x within the numbers that share its high bits, the place behind these, low bits of x)."""
        want, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        buckets = int(self.zeros[-1])
        want = np.minimum(want, buckets)
        ends = self._select(np.append(np.maximum(want - 1, 0), np.minimum(want, buckets - 1)), 0)
        left = np.where(want > 0, ends[: len(x)] + 1 - want, 0)
        end = np.where(want < buckets, ends[len(x) :] - want, self.n)
        open_ = np.flatnonzero(left < end)
        first, behind, sought = left[open_], end[open_], low[open_]
        while len(open_):
            middle = (first + behind) >> 1
            less = self._low(middle) < sought
            first, behind = np.where(less, middle + 1, first), np.where(less, behind, middle)
            left[open_] = first
            more = first < behind
            open_, first, behind, sought = (v[more] for v in (open_, first, behind, sought))
        return left, end, low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is at least x; n if there is none."""
        x = np.asarray(x, np.uint64)
        return self._search(x)[0] if len(x) and self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is x; -1 if there is none."""
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), -1)
        at, end, low = self._search(x)
        return np.where((at < end) & (self._low(np.minimum(at, self.n - 1)) == low), at, -1)


class Level:
    """n-grams (context, word) of one length: `encode` writes them, `find` looks them up."""

    def __init__(self, raw):
        self.contexts = EliasFano(raw)
        raw = raw[self.contexts.size :]
        self.pointers = EliasFano(raw)
        raw = raw[self.pointers.size :]
        self.successors = EliasFano(raw)
        n = self.successors.n
        # the longest n-grams are no contexts and have no back-off
        numbers = np.frombuffer(raw, "<u2", offset=self.successors.size)
        self.code, self.backoff = numbers[:n], numbers[n:]

    @staticmethod
    def encode(context: np.ndarray, word: np.ndarray, code: np.ndarray, backoff: np.ndarray) -> bytes:
        """Of n-grams that are sorted by (context, word), and distinct."""
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        # each range goes on where the one before ended, so that all ranges are one monotone sequence
        last = word[np.append(starts[1:], len(word)) - 1] if len(word) else word
        base = np.append(0, np.cumsum(last.astype(np.uint64) + np.uint64(1)))[: len(starts)].astype(np.uint64)
        moved = word + np.repeat(base, np.diff(np.append(starts, len(word))))
        return b"".join((EliasFano.encode(context[starts]), EliasFano.encode(np.append(starts, len(word))), EliasFano.encode(moved), code.astype("<u2").tobytes(), backoff.astype("<u2").tobytes()))

    def find(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of n-grams, -1 where there is none; their places among the successors of the context). The first sizes[0] words
        follow contexts[0], and so on."""
        none = np.full(len(words), -1)
        if not self.successors.n or not len(words):
            return none, none
        j = self.contexts.find(contexts)
        known, j = j >= 0, np.maximum(j, 0)
        bounds = self.pointers.get(np.append(j, j + 1)).astype(np.int64)
        start, end = bounds[: len(j)], bounds[len(j) :]
        base = np.where(start > 0, self.successors.get(np.maximum(start - 1, 0)) + np.uint64(1), np.uint64(0))
        known, start, end, base = (np.repeat(v, sizes) for v in (known, start, end, base))
        at = self.successors.find(base + words)
        known &= (at >= 0) & (at < end)
        return np.where(known, at, -1), np.where(known, at - start, -1)
