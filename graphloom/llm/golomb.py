"""Golomb-Rice codes of sorted numbers, encoded and decoded whole in numpy."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBQ")


def encode(values: np.ndarray) -> bytes:
    """values: sorted, distinct or not, non-negative. The gaps' quotients by 2**k stand in unary, then their remainders in k bits each."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n * 0.7))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary).tobytes()
    rest = b""
    if k:
        low = gaps & np.uint64((1 << k) - 1)
        bits = np.empty((n, k), np.uint8)
        for j in range(k):
            bits[:, j] = (low >> np.uint64(k - 1 - j)) & np.uint64(1)
        rest = np.packbits(bits.ravel()).tobytes()
    return _HEAD.pack(n, k, len(head)) + head + rest


def decode(data: bytes) -> np.ndarray:
    n, k, size = _HEAD.unpack_from(data)
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[_HEAD.size : _HEAD.size + size]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(raw[_HEAD.size + size :])[: n * k].reshape(n, k)
        low = np.zeros(n, np.uint64)
        for j in range(k):
            low = (low << np.uint64(1)) | bits[:, j]
        gaps |= low
    return np.cumsum(gaps, dtype=np.uint64)
