"""Candidates of a similarity join by a prefix filter, which passes over no similar pair.

All grams stand in one order: those that only one document has, then the rare, then the
hot ones, equal ones by their hashes. Two sets with a Jaccard similarity of t share t
times the grams of each at least, so they have a gram in common among the first
size - ceil(t * size) + 1 of both. Grams of one document need no look, and a document
with so many of them that they fill its prefix is similar to none.

How many documents have a gram is counted by fingerprints, in the ranges of the hashes.
From each range come Bloom filters of the grams that so many documents have; one that
passes wrongly stands elsewhere in the order, or is looked up in vain, and the result is
the same. The filters have SHARED_BITS at most: with more shared grams than a tenth of
it more keys are looked up in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import give_back, gram_sets, mix, slices

#: The least numbers of documents for a gram's levels 1, 2 and 3; level 0 are grams of one document.
LEVELS = (2, 32, 1024)
#: Ranges of hashes are told by so many bits.
RANGE = 10
#: Bits of all filters of a level together.
SHARED_BITS = 1 << 31
#: So many grams are sorted at a time.
_AT_ONCE = 2_000_000

#: levels(grams) -> the level of each.
Levels = Callable[[np.ndarray], np.ndarray]


def _range(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - RANGE)).astype(np.int64)


def _print(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(32 - RANGE)).astype(np.uint32)


def _places(g: np.ndarray, mask: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """Of grams by range and fingerprint, as one number."""
    h = mix(g)
    for k in range(3):
        yield (mix(h + np.uint64(k)) & mask).astype(np.int64)


def _filter(x: np.ndarray, bits: int) -> bytes:
    size = min(bits, 1 << max(6, (10 * len(x) - 1).bit_length())) if len(x) else 0
    cells = np.zeros(size, bool)
    for at in _places(x, np.uint64(max(size, 1) - 1)) if size else ():
        cells[at] = True
    return np.packbits(cells, bitorder="little").tobytes()


def levels(docs: DataFrame, n: int, bits: int = SHARED_BITS) -> Levels:
    """Counts the grams of the texts of docs."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            g = np.sort(np.concatenate(held))
            held.clear()
            at, raw = np.searchsorted(_range(g), np.arange((1 << RANGE) + 1)), _print(g)
            some = [r for r in range(1 << RANGE) if at[r] < at[r + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([raw[at[r] : at[r + 1]].tobytes() for r in some], pa.binary())], ["range", "prints"])

        total = 0
        for batch in batches:
            for b in slices(batch):
                sets = [s for s in gram_sets(b["text"], n) if len(s)]
                held += sets
                total += sum(len(s) for s in sets)
                if total >= _AT_ONCE:
                    yield flush()
                    total = 0
        if held:
            yield flush()
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def close() -> pa.RecordBatch:
            p, number = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            x = (np.uint64(now) << np.uint64(32)) | p.astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([_filter(x[number >= k], bits >> RANGE)], pa.binary()) for k in LEVELS)], ["range", "l0", "l1", "l2"])

        for b in batches:
            for r, raw in zip(b["range"].to_pylist(), b["prints"]):
                if held and r != now:
                    yield close()
                now = r
                held.append(np.frombuffer(raw.as_buffer(), np.uint32))
        if held:
            yield close()
        give_back()

    counted = docs.select("text").mapInArrow(prints, "range int, prints binary").repartition("range").sortWithinPartitions("range")
    table = counted.mapInArrow(count, "range int, l0 binary, l1 binary, l2 binary").toArrow()  # a row for each range
    where = table["range"].to_numpy()
    filters = []
    for c in ("l0", "l1", "l2"):
        raw = [x.as_buffer() for x in table[c]]
        size, begin = np.zeros(1 << RANGE, np.int64), np.zeros(1 << RANGE, np.int64)
        size[where] = [len(x) * 8 for x in raw]
        begin[where] = np.cumsum(size[where]) - size[where]
        filters.append((np.frombuffer(b"".join(raw) + b"\0", np.uint8), begin, size))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def level(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.int8)
        at = np.arange(len(g))
        for k, (flat, begin, size) in enumerate(shared.value):
            r = _range(g[at])
            at, r = at[size[r] > 0], r[size[r] > 0]
            x = (r.astype(np.uint64) << np.uint64(32)) | _print(g[at]).astype(np.uint64)
            inside = np.ones(len(at), bool)
            for p in _places(x, (size[r] - 1).astype(np.uint64)):
                p += begin[r]
                inside &= (flat[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            at = at[inside]
            out[at] = k + 1
        return out

    return level


def prefixes(docs: DataFrame, n: int, t: float, level: Levels) -> DataFrame:
    """(rep, size, keys, ranks): the grams of a document's prefix that others may have, and their places in its order; no row without any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = gram_sets(b["text"], n)
                size = np.array([len(s) for s in sets], np.int64)
                if not size.sum():
                    continue
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                lv = level(flat)
                length = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
                open_ = np.bincount(owner[lv == 0], minlength=len(sets)) < length
                some = open_[owner]
                flat, owner, lv = flat[some], owner[some], lv[some]
                if not len(flat):
                    continue
                # sets ascend, so a stable sort by level keeps the order of hashes
                order = np.argsort(owner * 4 + lv, kind="stable")
                flat, lv = flat[order], lv[order]
                begin = np.cumsum(np.where(open_, size, 0)) - np.where(open_, size, 0)
                rank = np.arange(len(flat)) - begin[owner]
                key = (lv > 0) & (rank < length[owner])
                number = np.bincount(owner[key], minlength=len(sets))
                with_key = np.flatnonzero(number)
                ends = pa.array(np.concatenate([[0], np.cumsum(number[with_key])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].take(pa.array(with_key)),
                        pa.array(size[with_key].astype(np.int32)),
                        pa.ListArray.from_arrays(ends, pa.array(flat[key].view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(rank[key].astype(np.int32))),
                    ],
                    ["rep", "size", "keys", "ranks"],
                )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(of, "rep long, size int, keys array<long>, ranks array<int>")


def whole_rooms(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole rooms, about so many rows together."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        if not b.num_rows:
            continue
        if total >= rows:
            # the room that goes on in this batch belongs to what is held
            new = np.flatnonzero(b["room"].to_numpy() != held[-1]["room"][len(held[-1]) - 1].as_py())
            if len(new):
                k = int(new[0])
                yield pa.Table.from_batches([*held, b.slice(0, k)]).combine_chunks()
                held, total = [], 0
                b = b.slice(k)
        held.append(b)
        total += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates(found: DataFrame, t: float, small: int = 24) -> DataFrame:
    """(a, b), a < b, once each: the pairs of found, (rep, part, size, keys, ranks), of different parts that may be similar enough."""

    def able(size: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = size[a], size[b]
        # were the key the first that both have, no more grams than those from there on could be common
        return np.minimum(x - rank[a], y - rank[b]) >= np.ceil(t / (1 + t) * (x + y) - 1e-9)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            p = np.unique(np.concatenate(out), axis=0)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        for g in whole_rooms(batches, 50_000):
            key, rep, part = (g[c].to_numpy() for c in ("room", "rep", "part"))
            size, rank = g["size"].to_numpy().astype(np.int64), g["rank"].to_numpy().astype(np.int64)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            m = np.diff(np.append(first, len(key)))
            mixed = np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)
            first, m = first[mixed], m[mixed]

            def add(a: np.ndarray, b: np.ndarray) -> int:
                ok = part[a] != part[b]
                a, b = a[ok], b[ok]
                ok = able(size, rank, a, b)
                a, b = rep[a[ok]], rep[b[ok]]
                if len(a):
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                return len(a)

            for k in np.unique(m[m <= small]).tolist():
                x, y = np.triu_indices(k, 1)
                starts = first[m == k]
                step = max(1, 100_000 // len(x))
                for c in range(0, len(starts), step):
                    some = starts[c : c + step]
                    total += add((some[:, None] + x).ravel(), (some[:, None] + y).ravel())
            for f, k in zip(first[m > small].tolist(), m[m > small].tolist()):
                # a room's rows ascend by size, so those that are large enough begin at one place
                low = f + np.searchsorted(size[f : f + k], t * size[f : f + k] - 1e-9)
                for i in range(1, k):
                    total += add(np.full(f + i - low[i], f + i), np.arange(low[i], f + i))
                    if total > 1_000_000:
                        yield flush()
                        total = 0
            if total > 1_000_000:
                yield flush()
                total = 0
        if out:
            yield flush()
        give_back()

    rows = found.select("rep", "part", "size", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ranks").alias("rank"))))
    return rows.toDF("rep", "part", "size", "room", "rank").repartition("room").sortWithinPartitions("room", "size").mapInArrow(pairs, "a long, b long").distinct()
