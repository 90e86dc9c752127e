"""Elias-Fano coding of a non-decreasing sequence: low bits packed, high bits in unary, and a select structure.

For n values up to u it takes about 2 + log2(u / n) bits a value. ``select`` finds one value without decoding the
rest: a sample of every ``SAMPLE``-th set bit's place (32 bits each) gives the byte to start from, and counts of
set bits by byte lead to the value's own bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 256
#: For each byte, how many bits are set, and where its first, second, ... set bit is.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)

_PLACES = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


@dataclass(frozen=True)
class EliasFano:
    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        """``values``: non-negative, non-decreasing, below 2**32."""
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        places = (values >> width) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return EliasFano(n, width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of some values: the eight bytes from the one where they begin hold them all."""
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        raw = np.concatenate((np.frombuffer(self.low, np.uint8), np.zeros(8, np.uint8)))
        words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        start = i * self.low_bits
        return (words[start // 8] >> (start % 8).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def select(self, i: int | np.ndarray) -> int | np.ndarray:
        """The ``i``-th value, or the values at some places. From the sampled bit before a place, bytes are passed by their
        counts of set bits, for all places at once."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        high = np.concatenate((np.frombuffer(self.high, np.uint8), np.full(1, 255, np.uint8)))
        start = np.frombuffer(self.samples, "<u4")[at // SAMPLE].astype(np.int64)
        rest, byte = at % SAMPLE, start // 8
        current = high[byte] >> (start % 8).astype(np.uint8) << (start % 8).astype(np.uint8)
        while len(going := np.flatnonzero(_ONES[current] <= rest)):
            rest[going] -= _ONES[current[going]]
            byte[going] += 1
            current[going] = high[byte[going]]
        found = (byte * 8 + _PLACES[current, rest] - at << self.low_bits) | self._lows(at)
        return found if np.ndim(i) else int(found[0])
