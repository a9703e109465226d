"""Rolling polynomial hashes over byte arrays, modulo 2 to the 64th, mixed before use."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=3)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to each power, and its inverses."""
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHashes:
    """Hashes of any spans of a byte array, each in constant time."""

    def __init__(self, flat: np.ndarray):
        up, self.down = powers(1 << max(20, int(len(flat)).bit_length()))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, width: int) -> np.ndarray:
        """Of the spans of that width from every place."""
        n = max(0, len(self.total) - width)
        return mix((self.total[width:] - self.total[:n]) * self.down[:n] + np.uint64(width))
