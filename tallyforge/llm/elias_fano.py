"""Elias-Fano sequences in numpy: monotone values in about 2 + log2(universe / n) bits each, read without decoding the rest."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U64 = np.uint64
EVERY = 32  # ones or zeros between two kept positions
PAIRS, QUADS, NIBBLES, ONES, TOPS = (U64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
#: The place of the k-th one of a byte, by 8 * byte + k.
IN_BYTE = np.array([[*(i for i in range(8) if b >> i & 1), *[0] * 8][:8] for b in range(256)], dtype=np.uint8).ravel()


def place_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one of each word, which has as many."""
    s = word - ((word >> U64(1)) & PAIRS)
    s = (s & QUADS) + ((s >> U64(2)) & QUADS)
    s = ((s + (s >> U64(4))) & NIBBLES) * ONES  # byte i: ones in bytes 0 to i
    byte = np.bitwise_count(((k * ONES | TOPS) - s) & TOPS).astype(U64) << U64(3)  # bytes whose ones all come before, times 8
    rest = k - ((s << U64(8)) >> byte & U64(0xFF))
    return (byte + IN_BYTE[((word >> byte & U64(0xFF)) << U64(3)) + rest]).astype(np.int64)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, one a byte, packed to 64-bit words and one word more."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(U64)


class EliasFano:
    """values: sorted, not negative, below universe. A sequence is four arrays, so that it can lie in a mapped file."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, width: int):
        self.low, self.high, self.ones, self.zeros, self.n, self.width = low, high, ones, zeros, n, width

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(U64), len(values)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n + (universe >> width) + 2, dtype=bool)
        bits[(values >> U64(width)).astype(np.int64) + np.arange(n)] = True
        low = ((values[:, None] >> np.arange(width, dtype=U64)) & U64(1)).astype(bool).ravel()
        return cls(_words(low), _words(bits), np.flatnonzero(bits)[::EVERY].astype(np.uint32), np.flatnonzero(~bits)[::EVERY].astype(np.uint32), n, width)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The position of the k-th one or zero of the high bits."""
        flip = U64(0) if one else ~U64(0)
        at = (self.ones if one else self.zeros)[k // EVERY].astype(np.int64)
        word, rest = at >> 6, (k % EVERY).astype(U64)
        left = (self.high[word] ^ flip) & (~U64(0) << (at & 63).astype(U64))
        have = np.bitwise_count(left)
        open_ = np.flatnonzero(have <= rest)
        while len(open_):
            rest[open_] -= have[open_]
            word[open_] += 1
            left[open_] = self.high[word[open_]] ^ flip
            have[open_] = np.bitwise_count(left[open_])
            open_ = open_[have[open_] <= rest[open_]]
        return (word << 6) + place_in_word(left, rest)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        spill = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (self.low[word] >> shift | spill) & U64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at i."""
        high = (self._select(i.astype(np.int64), True) - i).astype(U64)
        return (high << U64(self.width) | self._low(i)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it does not occur: the first successor of its low bits in the bucket of its high bits."""
        values = values.astype(U64)
        high, low = (values >> U64(self.width)).astype(np.int64), values & U64((1 << self.width) - 1)
        bit = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        zeros = ~self.high[bit >> 6] >> (bit & 63).astype(U64)  # the bucket's ones are the ones from here to the next zero
        size = np.bitwise_count((zeros & (~zeros + U64(1))) - U64(1)).astype(np.int64)
        first = bit - high
        end = first + size
        over = np.flatnonzero(zeros == 0)  # none in this word
        end[over] = self._select(high[over], False) - high[over]
        stop = end.copy()
        open_ = np.flatnonzero(first < stop)
        while len(open_):
            middle = (first[open_] + stop[open_]) >> 1
            below = self._low(middle) < low[open_]
            first[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[first[open_] < stop[open_]]
        out = np.full(len(values), -1, np.int64)
        there = np.flatnonzero(first < end)
        same = there[self._low(first[there]) == low[there]]
        out[same] = first[same]
        return out


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, read from a memory-mapped file without a name, which goes when they do."""
    with tempfile.TemporaryFile() as file:
        places = []
        for a in arrays:
            file.write(b"\0" * (-file.tell() % 8))
            places.append(file.tell())
            file.write(np.ascontiguousarray(a).tobytes())
        file.write(b"\0" * 8)
        file.flush()
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, a.dtype, len(a), at) for a, at in zip(arrays, places, strict=True)]
