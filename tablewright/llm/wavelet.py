"""A wavelet matrix: a long sequence over a small alphabet that answers how often a symbol occurs
among the first i places, for many i at once.

The highest bit of every symbol makes the first plane; the symbols are then parted by that bit,
zeros first and otherwise in order, and the next bit makes the next plane. A rank follows the
symbol's bits down the planes, each step being a popcount in a packed word and a running count.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BitPlane:
    """Bits in words of 64, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """``symbols`` (uint8) of ``bits`` bits each."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.length, self.bits, self.planes = len(symbols), bits, []
        for k in reversed(range(bits)):
            bit = ((symbols >> k) & 1).astype(bool)
            self.planes.append(BitPlane(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs among the first ``at`` places."""
        ends = np.concatenate([[0], np.asarray(at, np.int64)])
        for k, plane in zip(reversed(range(self.bits)), self.planes, strict=True):
            ones = plane.ones(ends)
            ends = plane.zeros + ones if symbol >> k & 1 else ends - ones
        return ends[1:] - ends[0]

    def rank_any(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How often any of several symbols occurs among the first ``at`` places."""
        return sum(self.rank(s, at) for s in symbols)

    def place_any(self, symbols: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The shortest prefixes, between ``low`` and ``high`` places long, that hold ``wanted`` of the symbols.

        By bisection on ranks; ``high`` where not even that prefix holds so many.
        """
        low, high = low.astype(np.int64), high.astype(np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.rank_any(symbols, middle) >= wanted
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low
