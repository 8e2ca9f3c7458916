"""Hashes of any part of a sequence from prefix sums, in 64-bit arithmetic."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix(values: np.ndarray) -> np.ndarray:
    """For ``between``: sums of the values, each times its place's power of a fixed base."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _to(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each part [start, end), alike wherever an equal part stands."""
    return mix((sums[end] - sums[start]) * _to(len(sums))[1][start] + (end - start).astype(np.uint64))
