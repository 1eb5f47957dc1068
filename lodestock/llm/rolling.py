"""Polynomial hashes of byte ranges, by one prefix sum: hash(i, j) = (total[j] - total[i]) * inverse[i], modulo 2 ** 64."""

from __future__ import annotations

import numpy as np

POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(POWER, -1, 1 << 64)
_KEPT: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of POWER and of its inverse. Kept per worker up to 2 ** 22."""
    if not _KEPT or len(_KEPT[0]) < n:
        made = [np.cumprod(np.full(max(n, 1 << 20), p, np.uint64)) for p in (POWER, _INVERSE)]
        if n > 1 << 22:
            return made[0][:n], made[1][:n]
        _KEPT[:] = made
    return _KEPT[0][:n], _KEPT[1][:n]


def prefix_sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power, out=total[1:])
    return total


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with their bits spread, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h
