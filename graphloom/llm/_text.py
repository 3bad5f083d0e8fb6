"""Words, grams and windows of whole Arrow batches of text, hashed in numpy.

A word is a maximal run of characters of the lower-cased text that are letters or
digits in ASCII or lie outside ASCII (``WORD`` as a regular expression). Text of any
length is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The same words for RE2 and Java, applied to the lower-cased text.
WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Bytes of text worked on at a time, so that the arrays stay in the caches.
SLICE_BYTES = 1 << 20
_LOADS = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S32)) * _C2
    x = (x ^ (x >> _S29)) * _C3
    return x ^ (x >> _S32)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers stay, and what one stage freed would count beside the next one's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a slice has about limit bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    at = [0, *cuts.tolist(), n]
    for a, b in zip(at, at[1:]):
        yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets at which each text's words begin (one more than texts)."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    if texts.offset or texts.null_count:
        texts = pa.concat_arrays([pc.fill_null(texts, "")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.empty(last - first + 8, np.uint8)
    raw[: last - first] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:last]
    raw[last - first :] = 0
    offsets = offsets - first
    inside = _IN_WORD[raw[:-8]]
    # a boundary lies between two bytes of which one is in a word, and between texts
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(inside)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    loads = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
    h = mix((loads[starts] & _MASK[np.minimum(lengths, 8)]) + _C1) + lengths.astype(np.uint64)
    for k in range(1, _LOADS):
        more = np.flatnonzero(lengths > 8 * k)
        if not len(more):
            break
        h[more] = mix((h[more] * _C1) ^ (loads[starts[more] + 8 * k] & _MASK[np.minimum(lengths[more] - 8 * k, 8)]))
    for i in np.flatnonzero(lengths > 8 * _LOADS).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes())
    return h, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words and each text's offsets. A text of 1 to n-1 words has one gram, of all its words."""
    counts = np.diff(offsets)
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    out = np.zeros(len(h), np.uint64)
    for j in range(n):
        out = out * _C3
        out[: len(h) - j] += mix(h[j:] + np.uint64(j + 1)) if j else h
    out = mix(out)
    number = np.where(counts >= n, counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    number[short] = 1
    to = np.concatenate([[0], np.cumsum(number)])
    at = np.repeat(offsets[:-1] - to[:-1], number) + np.arange(to[-1])
    result = out[at]
    for i in short.tolist():
        x = np.uint64(counts[i])
        for w in h[offsets[i] : offsets[i + 1]]:
            x = _one(x, w)
        result[to[i]] = x
    return result, to


def _one(x: np.uint64, w: np.uint64) -> np.uint64:
    return mix(np.array([x], np.uint64) * _C1 + np.array([w], np.uint64))[0]


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    g, to = grams(*words(texts), n)
    return [np.unique(g[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist())]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse modulo 2**64, raised to 0..n-1; base is odd."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        two = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            two.append(np.cumprod(x, dtype=np.uint64))
        if size > 1 << 22:
            return two[0], two[1]
        _POWERS[base] = (two[0], two[1])
    return _POWERS[base]


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all runs of n words, whatever text they lie in; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours; len(x) - n + 1 of them."""
    if len(x) < n:
        return x[:0]
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])
