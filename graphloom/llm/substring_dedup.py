"""Repeated passages: windows of `window` words that stand in two documents or more.

Every window has a deputy, the least hash among its runs of half its length, so equal
windows have equal deputies. Each partition sketches the deputies of its documents in a
count-min sketch of two-bit counters; the merged sketch never counts too few, so a
second pass needs to group only windows whose deputy is counted twice or more, and
loses none. These are grouped by deputy and window, 128 bits of hash together.

The sketch grows with the corpus up to `sketch_bytes`. Beyond that it lets more windows
through, up to all: the second pass then shuffles more, in proportion to the corpus,
and its result stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import golomb
from ._rooms import _groups
from ._stage import importable, staged
from ._text import mix, rolling, sliding_min, slices, words

WINDOW = 50
SKETCH_BYTES = 256 << 20
DEPTH = 3
_DEPUTY, _WHOLE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
#: Cells of a slice of the sketch, the unit that is merged.
_SLICE = 1 << 20
#: Counters for each deputy expected. A document of w words has about 2 w / (window / 2 + 1).
_CELLS = 8


def deputies(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window that lies in one text, and the window's deputy."""
    run = max(1, window // 2)
    low = sliding_min(rolling(h, run, _DEPUTY), window - run + 1)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    at = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return at, low[at]


def _cells(deputy: np.ndarray, width: int) -> np.ndarray:
    """A cell in each of the sketch's rows, which lie one after another."""
    return np.stack([(mix(deputy + np.uint64(r + 1)) >> np.uint64(1)) % np.uint64(width) + np.uint64(r * width) for r in range(DEPTH)])


def _distinct(texts: pa.Array, window: int) -> np.ndarray:
    """Each text's distinct deputies, of all texts together."""
    h, offsets = words(texts)
    at, low = deputies(h, offsets, window)
    if not len(at):
        return low
    text = np.searchsorted(offsets, at, side="right") - 1
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    low, text = low[change], text[change]
    order = np.lexsort((low, text))
    low, text = low[order], text[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    return low[first]


def sketch(docs: DataFrame, window: int = WINDOW, sketch_bytes: int = SKETCH_BYTES) -> tuple[np.ndarray, int]:
    """The merged sketch, four counters a byte, and the width of a row. A counter of 2 stands for 2 or more."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / 5.5 * 2 / (window / 2 + 1)
    width = int(min(max(1024, expected * _CELLS / DEPTH), sketch_bytes * 4 / DEPTH))
    total = width * DEPTH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.zeros(0, np.uint64)]
        for batch in batches:
            own.extend(_distinct(b["text"], window) for b in slices(batch))
        own = np.concatenate(own)
        if not len(own):
            return
        cells, times = np.unique(_cells(own, width).ravel(), return_counts=True)
        part = (cells // _SLICE).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        at = [0, *cuts.tolist(), len(cells)]
        for a, b in zip(at, at[1:]):
            once = times[a:b] == 1
            low = cells[a:b] % _SLICE
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])]), pa.array([golomb.encode(low[once])], pa.binary()), pa.array([golomb.encode(low[~once])], pa.binary())], ["part", "once", "more"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counters = np.zeros(_SLICE, np.int64)
        for once, more in zip(pdf["once"], pdf["more"]):
            counters[golomb.decode(once).astype(np.int64)] += 1
            counters[golomb.decode(more).astype(np.int64)] += 2
        c = np.minimum(counters, 2).astype(np.uint8).reshape(-1, 4)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "packed": [(c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()]})

    merged = staged(docs.select("text").mapInArrow(count, "part long, once binary, more binary").groupBy("part").applyInPandas(merge, "part long, packed binary"))
    out = np.zeros((math.ceil(total / _SLICE), _SLICE // 4), np.uint8)
    for row in merged.toLocalIterator():
        out[row.part] = np.frombuffer(row.packed, np.uint8)
    return out.ravel(), width


def estimated_repeated(deputy: np.ndarray, packed: np.ndarray, width: int) -> np.ndarray:
    """Whether the sketch counts a deputy twice or more."""
    keep = np.ones(len(deputy), bool)
    for cells in _cells(deputy, width).astype(np.int64):
        keep &= (packed[cells >> 2] >> ((cells & 3) * 2).astype(np.uint8)) & 3 > 1
    return keep


def repeated_passages(docs: DataFrame, window: int = WINDOW, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc): the parts of each document that windows cover which stand in another document too.

    Words are those of _text.WORD, counted from 0; end_word is the word after the last. Windows that touch or overlap make one passage. first_doc is the lowest id of a document with one of the passage's windows, so passages with first_doc = doc_id are those to keep. Documents of fewer words than a window, and rows with a null doc_id or text, have no passage. A window that is repeated in one document only isn't repeated.
    """
    importable(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    packed, width = sketch(own, window, sketch_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for b in slices(batch):
                h, offsets = words(b["text"])
                at, low = deputies(h, offsets, window)
                if not len(at):
                    continue
                # neighbours of one deputy make a row
                text = np.searchsorted(offsets, at, side="right") - 1
                edge = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])]))
                length = np.diff(np.concatenate([edge, [len(at)]]))
                keep = estimated_repeated(low[edge], counts, width)
                if not keep.any():
                    continue
                edge, length = edge[keep], length[keep]
                whole = rolling(h, window, _WHOLE)
                pick = np.repeat(edge - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(whole[at[pick]].view(np.int64)))
                t = text[edge]
                yield pa.RecordBatch.from_arrays([pa.array(low[edge].view(np.int64)), b["doc_id"].take(pa.array(t)), pa.array((at[edge] - offsets[t]).astype(np.int32)), lists], ["deputy", "doc_id", "start", "windows"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for g in _groups(batches, "deputy"):
            if g.num_rows < 2:
                continue
            held.append(g)
            rows += g.num_rows
            if rows > 50_000:
                yield from _exact(pa.concat_tables(held).combine_chunks(), window)
                held, rows = [], 0
        if held:
            yield from _exact(pa.concat_tables(held).combine_chunks(), window)

    emitted = own.mapInArrow(emit, "deputy long, doc_id long, start int, windows array<long>")
    found = emitted.repartition("deputy").sortWithinPartitions("deputy").mapInArrow(group, "doc_id long, s int, e int, first long")
    before = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True))
    islands = found.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(upto))
    return islands.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("first").alias("first_doc")).drop("island")


def _exact(t: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Of whole groups of deputies, the stretches of windows that two documents have."""
    lists = t["windows"].chunk(0) if t["windows"].num_chunks else pa.array([], pa.list_(pa.int64()))
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    doc = t["doc_id"].to_numpy()[row]
    start = t["start"].to_numpy()[row].astype(np.int64) + place
    deputy, whole = t["deputy"].to_numpy()[row], lists.flatten().to_numpy()
    order = np.lexsort((doc, whole, deputy))
    doc_s, whole_s, deputy_s = doc[order], whole[order], deputy[order]
    edge = np.flatnonzero(np.concatenate([[True], (whole_s[1:] != whole_s[:-1]) | (deputy_s[1:] != deputy_s[:-1])]))
    size = np.diff(np.concatenate([edge, [len(order)]]))
    first, last = doc_s[edge], doc_s[edge + size - 1]
    many = np.repeat(first != last, size)
    flag, low = np.empty(len(order), bool), np.empty(len(order), np.int64)
    flag[order], low[order] = many, np.repeat(first, size)
    pick = np.flatnonzero(flag)
    if not len(pick):
        return
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(pick) != 1) | (row[pick[1:]] != row[pick[:-1]])]))
    end = np.concatenate([begin[1:], [len(pick)]]) - 1
    yield pa.RecordBatch.from_arrays([pa.array(doc[pick[begin]]), pa.array(start[pick[begin]].astype(np.int32)), pa.array((start[pick[end]] + window).astype(np.int32)), pa.array(np.minimum.reduceat(low[pick], begin))], ["doc_id", "s", "e", "first"])
