"""Elias-Fano coded monotone sequences that are read in place from a buffer or a memory map."""

from __future__ import annotations

import numpy as np

_HEADER = 4  # unsigned 64-bit words: count, low bits, bytes of the low part, bytes of the high part


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value in a row, least significant first, as bytes."""
    if width == 0 or len(values) == 0:
        return np.zeros(0, np.uint8)
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8]
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little")


def encode(values: np.ndarray, universe: int) -> bytes:
    """Code of a non-decreasing sequence of integers below ``universe``: about 2 + log2(universe / n) bits each."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    low = max(0, (max(1, int(universe)) // max(1, n)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64)
    ones = np.zeros(n + (int(high[-1]) if n else 0) + 1, dtype=np.uint8)
    ones[high + np.arange(n)] = 1
    lows, highs = pack_bits(values, low), np.packbits(ones, bitorder="little")
    return np.array([n, low, len(lows), len(highs)], dtype="<u8").tobytes() + lows.tobytes() + highs.tobytes()


#: Bytes of the high part that one sample of its ones stands for; places that are worked out at once.
_SPAN, _AT_ONCE = 8, 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one in a byte.
_PLACE = np.array([[[b for b in range(8) if i >> b & 1] + [8] * 8][0][:8] for i in range(256)], np.uint8)


class EliasFano:
    """A coded sequence, read where it is asked for: of the high part a count of ones for each _SPAN bytes is held, nothing of the low part."""

    def __init__(self, buffer: np.ndarray):
        n, low, size_low, size_high = (int(x) for x in buffer[: 8 * _HEADER].view("<u8"))
        at = 8 * _HEADER
        self.n, self.low = n, low
        self.lows = buffer[at : at + size_low]
        self.size = at + size_low + size_high
        self.bits = buffer[at + size_low : self.size]
        counts = np.add.reduceat(_ONES[self.bits], np.arange(0, size_high, _SPAN), dtype=np.int64) if size_high else np.zeros(0, np.int64)
        self.ones = np.append(0, np.cumsum(counts))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 8 * _SPAN - self.ones

    def _place(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit at which the k-th one, or zero, of the high part stands."""
        samples = self.ones if one else self.zeros
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), _AT_ONCE):
            want = np.asarray(k[a : a + _AT_ONCE], np.int64)
            span = np.searchsorted(samples, want, side="right") - 1
            at = span[:, None] * _SPAN + np.arange(_SPAN)
            held = self.bits[np.minimum(at, len(self.bits) - 1)]
            held = held if one else ~held
            upto = np.cumsum(_ONES[held], axis=1, dtype=np.int16)
            left = want - samples[span]
            byte = (upto <= left[:, None]).sum(1)
            rows = np.arange(len(want))
            left -= np.where(byte > 0, upto[rows, byte - 1], 0)
            out[a : a + _AT_ONCE] = (span * _SPAN + byte) * 8 + _PLACE[held[rows, byte], left]
        return out

    def _highs(self, index: np.ndarray) -> np.ndarray:
        return self._place(index, True) - index

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry with this high part, and the first behind it."""
        last = 8 * len(self.bits) - self.n  # zeros, padding included
        edge = self._place(np.clip(np.concatenate([high - 1, high]), 0, max(0, last - 1)), False) if last and len(high) else np.zeros(2 * len(high), np.int64)
        before, behind = edge[: len(high)] - (high - 1), edge[len(high) :] - high
        lo = np.where(high == 0, 0, np.where(high - 1 < last, before, self.n))
        hi = np.where(high < last, behind, self.n)
        return np.minimum(lo, self.n), np.minimum(hi, self.n)

    @classmethod
    def of(cls, code: bytes) -> EliasFano:
        return cls(np.frombuffer(code, np.uint8))

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if self.low == 0:
            return np.zeros(len(index), np.uint64)
        bit = index.astype(np.int64) * self.low
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = np.zeros(len(index), np.uint64)
        last = len(self.lows) - 1
        for j in range((self.low + 7 + 7) // 8):
            part = self.lows[np.minimum(byte + j, last)].astype(np.uint64)
            if j == 0:
                out |= part >> shift
            elif 8 * j < 64:
                out |= part << (np.uint64(8 * j) - shift)
            else:  # the ninth byte of a wide value that starts inside a byte
                out |= np.where(shift > 0, part << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.low) - 1)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index)
        return (self._highs(index).astype(np.uint64) << np.uint64(self.low)) | self._lows(index)

    def decode(self) -> np.ndarray:
        highs = np.flatnonzero(np.unpackbits(self.bits, bitorder="little")) - np.arange(self.n)
        if self.low == 0:
            return highs.astype(np.uint64)
        bits = np.unpackbits(self.lows, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        raw = np.zeros((self.n, 8), np.uint8)
        raw[:, : (self.low + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
        return (highs.astype(np.uint64) << np.uint64(self.low)) | raw.view("<u8").ravel()

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first entry that is not below each value, within [first, last) if given."""
        values = np.asarray(values, dtype=np.uint64)
        bucket = (values >> np.uint64(self.low)).astype(np.int64)
        lo, hi = self._bucket(bucket)
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        want = values & np.uint64((1 << self.low) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._lows(mid) < want[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo
