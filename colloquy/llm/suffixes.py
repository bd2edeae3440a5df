"""Byte suffixes: rolling digit hashes and the choice of anchor suffixes, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_TABLES = [_rng.integers(0, 2**64, 256, np.uint64) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(2**62, 2**63, 2)]
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in range(2)]


def _grown(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_powers[which][0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASES[which], pow(_BASES[which], -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[which][i] = np.multiply.accumulate(steps)
    return _powers[which][0], _powers[which][1]


class Digits:
    """Hashes of any byte range of one text, two independent 64-bit families."""

    def __init__(self, data: np.ndarray, families: int = 2):
        self.n, self.sums = len(data), []
        for which in range(families):
            powers, _ = _grown(which, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_TABLES[which][data] * powers[: self.n], out=sums[1:])
            self.sums.append(sums)

    def at(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[which][stop] - self.sums[which][start]) * _grown(which, self.n + 1)[1][start]

    def all(self, which: int, length: int) -> np.ndarray:
        """The hash of each range of that length."""
        s = self.sums[which]
        return (s[length:] - s[:-length]) * _grown(which, self.n + 1)[1][: self.n - length + 1]


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(digits: Digits, digit: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the digits that are smallest within some range of ``depth`` bytes.

    Equal ranges have their smallest digit at the same offset, so every
    repeated range of ``depth`` bytes holds a repeated anchor.
    """
    if digits.n < depth:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = digits.all(0, digit)
    width = depth - digit + 1
    least = _sliding(np.minimum, h, width)
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(h == _sliding(np.maximum, np.concatenate((pad, least, pad)), width))
    return chosen, h[chosen]


def owned(digits: Digits, digit: int, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, start) of the ranges of ``depth`` bytes whose smallest digit is at one of the places ``at``."""
    h = digits.all(0, digit)
    width = depth - digit + 1
    least = _sliding(np.minimum, h, width)
    near = (at[:, None] - np.arange(width)).ravel()
    anchor = np.repeat(at, width)
    inside = (near >= 0) & (near < len(least))
    anchor, near = anchor[inside], near[inside]
    own = least[near] == h[anchor]
    return anchor[own], near[own]
