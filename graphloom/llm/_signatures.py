"""MinHash signatures of sets of hashes, by universal hash functions in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._text import mix


def signatures(sets: list[np.ndarray], size: int, seed: int = 7) -> np.ndarray:
    """A row of `size` 32-bit minima for each set; no set is empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, size, dtype=np.uint64)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.empty((len(sets), size), np.uint32)
    # so many sets at a time as stay in the caches while all functions pass over them
    i = 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(at, at[i] + 16384, side="right")) - 1)
        x, begin = flat[at[i] : at[j]], at[i:j] - at[i]
        y = np.empty_like(x)
        for k in range(size):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            out[i:j, k] = np.minimum.reduceat(y, begin) >> np.uint64(32)
        i = j
    return out


def banded(bands: int, rows: int, seed: int) -> Callable[[list[np.ndarray]], np.ndarray]:
    """A function that gives the hashes of each set's bands of minima, 64 bits of each."""

    def of(sets: list[np.ndarray]) -> np.ndarray:
        x = signatures(sets, bands * rows, seed).astype(np.uint64).reshape(len(sets), bands, rows)
        h = np.zeros((len(sets), bands), np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r] + np.uint64(1))
        return h

    return of
