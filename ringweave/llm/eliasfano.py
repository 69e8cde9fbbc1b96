"""Elias-Fano coding of non-decreasing integers, with sampled select (Elias 1974, Fano 1971)."""

from __future__ import annotations

import struct

import numpy as np

#: One position of a set bit is sampled for each so many.
SAMPLE = 256
_HEAD = struct.Struct("<QQB")
#: _IN_BYTE[b, k]: place of the k-th set bit of byte b.
_IN_BYTE = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_set)] = _set


class EliasFano:
    """n values 0 <= v[0] <= v[1] <= ... in about 2 + log2(u / n) bits each.

    The low bits of each value lie packed; the high bits are a bit vector in which bit (v >> low) + i
    is set for the i-th value. ``select`` finds the i-th set bit from the nearest sample and popcounts,
    so any value is read without decoding those before it, and no table of 64-bit offsets is kept.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, words: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.words, self.samples = n, low, lows, words, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(8, np.uint8), np.zeros(1, np.uint64), np.zeros(0, np.uint32))
        if np.any(v[1:] < v[:-1]):
            raise ValueError("values must not decrease")
        low = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lows = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(16, np.uint8)])
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) // 64 + 1) * 64, np.uint8)
        high[at] = 1
        words = np.packbits(high, bitorder="little").view("<u8")
        return cls(n, low, lows, words, at[::SAMPLE].astype(np.uint32))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th set bits."""
        i = np.asarray(i, dtype=np.int64)
        at = self.samples[i // SAMPLE].astype(np.int64)
        left = i % SAMPLE
        word = at >> 6
        bits = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        count = np.bitwise_count(bits).astype(np.int64)
        go = np.flatnonzero(left >= count)
        while len(go):
            left[go] -= count[go]
            word[go] += 1
            bits[go] = self.words[word[go]]
            count[go] = np.bitwise_count(bits[go])
            go = go[left[go] >= count[go]]
        each = np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(each).astype(np.int64), axis=1)
        byte = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(i))
        before = np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
        return word * 64 + byte * 8 + _IN_BYTE[each[rows, byte], left - before]

    def get(self, i) -> np.ndarray:
        """The i-th values, for an array of places."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        high = self.select(i) - i
        if not self.low:
            return high
        bit = i * self.low
        byte = bit >> 3
        # a value's low bits lie within 9 bytes: 8 by a word, the rest by one more byte
        eight = np.zeros(len(i), np.uint64)
        for k in range(8):
            eight |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (bit & 7).astype(np.uint64)
        value = eight >> shift
        more = self.lows[byte + 8].astype(np.uint64)
        value |= np.where(shift > 0, more << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        value &= np.uint64((1 << self.low) - 1)
        return (high << self.low) + value.astype(np.int64)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def to_bytes(self) -> bytes:
        parts = (self.lows.tobytes(), self.words.tobytes(), self.samples.astype("<u4").tobytes())
        return _HEAD.pack(self.n, len(parts[0]), self.low) + struct.pack("<QQ", *map(len, parts[1:])) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, a, low = _HEAD.unpack_from(data)
        b, c = struct.unpack_from("<QQ", data, _HEAD.size)
        at = _HEAD.size + 16
        return cls(
            n,
            low,
            np.frombuffer(data, np.uint8, a, at),
            np.frombuffer(data[at + a : at + a + b], "<u8"),
            np.frombuffer(data[at + a + b : at + a + b + c], "<u4"),
        )
