"""A wavelet tree over an array of numbers, level after level, with queries on many ranges at once."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Answers range successor: the least value from x on among values[left:right]."""

    def __init__(self, values: np.ndarray, size: int):
        """values: numbers from 0 to size - 1."""
        self.size = size
        self.bits = max(1, int(size - 1).bit_length()) if size else 0
        self.ones: list[np.ndarray] = []                  # ones before each place, of each bit from the highest on
        values = np.asarray(values)
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones.append(np.r_[0, np.cumsum(one)].astype(np.int32))
            values = np.r_[values[one == 0], values[one == 1]]

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range are less than x."""
        left, right, count = left.astype(np.int64), right.astype(np.int64), np.zeros(len(left), np.int64)
        for bit, ones in zip(range(self.bits - 1, -1, -1), self.ones):
            zeros = len(ones) - 1 - int(ones[-1])
            l1, r1 = ones[left].astype(np.int64), ones[right].astype(np.int64)
            up = (x >> bit) & 1 == 1
            count += np.where(up, (right - r1) - (left - l1), 0)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank (from 0) in each range, which has more values than it."""
        left, right, rank, value = left.astype(np.int64), right.astype(np.int64), rank.copy(), np.zeros(len(left), np.int64)
        for bit, ones in zip(range(self.bits - 1, -1, -1), self.ones):
            zeros = len(ones) - 1 - int(ones[-1])
            l1, r1 = ones[left].astype(np.int64), ones[right].astype(np.int64)
            low = (right - r1) - (left - l1)
            up = rank >= low
            rank -= np.where(up, low, 0)
            value += np.where(up, 1 << bit, 0)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value >= x of each range, or -1."""
        out = np.full(len(left), -1, np.int64)
        inside = x < self.size
        rank = self.below(left[inside], right[inside], x[inside])
        some = rank < (right - left)[inside]
        at = np.flatnonzero(inside)[some]
        out[at] = self.smallest(left[at], right[at], rank[some])
        return out
