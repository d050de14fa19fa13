"""Hashes of many spans of one array at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_values(n: int, seed: int = 11) -> np.ndarray:
    """Odd 64-bit numbers that stand for bytes or characters."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span (start at least 1, none empty); overwrites ``values``.

    A polynomial over the values, of which every span's is a difference of two running sums.
    """
    if len(_powers[0]) < len(values):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(len(values) * 5 // 4, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    values *= _powers[0][: len(values)]
    np.cumsum(values, out=values)
    return mix((values[end - 1] - values[start - 1]) * _powers[1][start])
