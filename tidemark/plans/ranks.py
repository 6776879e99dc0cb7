"""Order statistics of many runs of one sequence, inside a task."""

from __future__ import annotations

import numpy as np


class Ranks:
    """The values of a sequence as a wavelet matrix over their sorted codes: a rank inside any run takes one step per bit of the code."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, codes = np.unique(values, return_inverse=True)
        self.zeros: list[np.ndarray] = []  # per bit from the top: places before this one whose bit is 0
        for bit in range((max(len(self.values), 1) - 1).bit_length() - 1, -1, -1):
            one = (codes >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            codes = np.concatenate([codes[~one], codes[one]])

    def at(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value at a 0-based rank below hi - lo of each run [lo, hi)."""
        code = np.zeros(len(rank), np.int64)
        for before in self.zeros:
            a, b = before[lo], before[hi]
            below = b - a
            up = rank >= below
            lo, hi = np.where(up, before[-1] + lo - a, a), np.where(up, before[-1] + hi - b, b)
            rank, code = np.where(up, rank - below, rank), code * 2 + up
        return self.values[code]
