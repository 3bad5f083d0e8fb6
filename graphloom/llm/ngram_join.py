"""The n-gram Jaccard join by T-occurrence search with DivideSkip.

Two sets of sizes p and q with Jaccard similarity t at least share T = t / (1 + t) (p + q)
grams. In a room (see _rooms) every document is a query against the inverted lists of
the room's grams. Fewer than T of the query's longest lists are set aside, so many as
DivideSkip's rule says. The short ones are merged, by a heap if they hold a few entries,
else by a counting pass over all of them, which gives the heap's counts without a pop for
each entry. Documents that can still reach the overlap are looked up in the long lists by
binary search, and those that reach it stay. Where so many are left that to search is
dearer than to merge, the long lists are merged too.

A pair meets in a room if it agrees in a whole one of BANDS bands of ROWS minima of its
grams under different hash functions, and what meets is decided exactly. One minimum for
a key would let all documents with one common passage meet; two let hardly any but
similar ones. A pair of similarity J agrees in no band with probability
(1 - J ** ROWS) ** BANDS: with 40 bands of 2 rows 0.1 % at J = 0.4. Those pairs are found
by an exact prefix filter (see _rooms._rest and _prefixes), so that none is missed
whatever the bands.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rooms
from ._signatures import banded
from ._stage import split, staged

N, THRESHOLD, BANDS, ROWS = 3, 0.4, 40, 2
#: The cost of a step of binary search in the lists, in steps of merging.
PROBE = 12
#: Short lists of up to so many entries together are merged by a heap.
HEAP = 24
#: DivideSkip's parameter: T / (MU * log2(longest list) + 1) lists are set aside.
MU = 0.01
#: Binary searches at a time.
_AT_ONCE = 500_000


def minima(bands: int, rows: int) -> _rooms.Keys:
    return banded(bands, rows, 3)


class Lists:
    """The inverted lists of sets, of grams that two or more of them have; in each the sets' places ascend."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=new[1:])
        del flat
        many = ~new
        many[:-1] |= ~new[1:]  # grams of one set only have no list
        order = order[many]
        number = np.cumsum(new[many], dtype=np.int32) - 1
        owner = np.repeat(np.arange(self.m, dtype=np.int32), size)
        self.docs = owner[order]
        self.begin = np.flatnonzero(new[many])
        self.length = np.diff(np.append(self.begin, len(number)))
        #: ascending, as lists follow each other and sets ascend in them
        self.entry = number * np.int64(self.m) + self.docs
        back = np.argsort(order, kind="stable")
        self._lists = number[back]
        self._at = np.searchsorted(order[back], np.concatenate([[0], np.cumsum(size)]))

    def of(self, i: int) -> np.ndarray:
        """The lists that hold set i, the shortest first."""
        lists = self._lists[self._at[i] : self._at[i + 1]]
        return lists[np.argsort(self.length[lists], kind="stable")]

    def merged(self, lists: np.ndarray, among: np.ndarray) -> np.ndarray:
        """In how many of the lists each of among is."""
        length = self.length[lists]
        total = int(length.sum())
        if total <= HEAP:
            counts: dict[int, int] = {}
            for d in heapq.merge(*(self.docs[b : b + n].tolist() for b, n in zip(self.begin[lists].tolist(), length.tolist()))):
                counts[d] = counts.get(d, 0) + 1
            return np.array([counts.get(d, 0) for d in among.tolist()], np.int64)
        at = np.repeat(self.begin[lists] - (np.cumsum(length) - length), length) + np.arange(total)
        return np.bincount(self.docs[at], minlength=self.m)[among]

    def probed(self, lists: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The same by binary search of each of among in each list."""
        out = np.zeros(len(among), np.int64)
        step = max(1, _AT_ONCE // max(1, len(among)))
        for c in range(0, len(lists), step):
            asked = (lists[None, c : c + step].astype(np.int64) * self.m + among[:, None]).ravel()
            at = np.minimum(np.searchsorted(self.entry, asked), len(self.entry) - 1)
            out += (self.entry[at] == asked).reshape(len(among), -1).sum(axis=1)
        return out


def t_occurrence(sets: list[np.ndarray], others: _rooms.Others, t: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those of others(i) with a Jaccard similarity of t at least); i ascends, others(i) are below i."""
    size = np.array([len(s) for s in sets])
    index = Lists(sets)
    for i in range(1, len(sets)):
        among = others(i)
        among = among[(size[among] >= t * size[i] - 1e-9) & (size[among] * t <= size[i] + 1e-9)]
        if not len(among):
            continue
        need = np.ceil(t / (1 + t) * (size[i] + size[among]) - 1e-9).astype(np.int64)
        lists, least = index.of(i), max(1, int(need.min()))
        if len(lists) < least:
            continue
        length = index.length[lists]
        if PROBE * len(among) * len(lists) < length.sum():  # so few that none need be found
            counts = index.probed(lists, among)
        else:
            aside = min(least - 1, int(least / (MU * np.log2(length[-1]) + 1)))
            short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
            counts = index.merged(short, among)
            able = counts >= np.maximum(need - aside, 1)
            among, need, counts = among[able], need[able], counts[able]
            if aside and len(among):
                dear = PROBE * len(among) * aside > index.length[long].sum()
                counts = counts + (index.merged(long, among) if dear else index.probed(long, among))
        both = counts / (size[i] + size[among] - counts)
        found = among[(counts >= need) & (both >= t)]
        if len(found):
            yield i, found


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    return _rooms.similar(docs, n, threshold, minima(bands, rows), t_occurrence, whole=True)


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, group_id, links): every document whose set of word n-grams has a Jaccard similarity of the threshold at least with another's.

    class_id is the lowest doc_id with the same set. links counts the classes, other sets that is, which the join pairs with it; copies alone have 0. group_id is the lowest doc_id that a chain of links leads to. A text of fewer than n words has one gram, of all of them; a text without a word, and a null, pairs with nothing and has no row. Rows that repeat a document count once.
    """
    return _rooms.groups(*linked(docs, n, threshold, bands, rows))


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without the documents that are connected, by pairs of the join, with one of a lower doc_id. All other rows and all columns stay, rows without doc_id or text too."""
    gone = staged(ngram_join(docs, n, threshold, bands, rows).filter("doc_id <> group_id").select("doc_id"))
    return split(docs, docs["doc_id"].cast("long"), gone, gone.count())[1]
