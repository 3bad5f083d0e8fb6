"""Document fingerprints: MinHash signatures, banded, with the Jaccard similarity verified.

A signature holds the minima of bands * rows universal hash functions
((a * x + b) mod 2**64, a odd, the high 32 bits) over the document's word n-grams, in
vectorised numpy. Spark joins the documents on the hashes of their bands (see _rooms) and
their sets are compared. A pair of similarity J is found with probability
1 - (1 - J ** rows) ** bands: with 36 bands of 3 rows 0.992 at J = 0.5, 0.9998 at 0.6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import _rooms
from ._signatures import banded

N, THRESHOLD, BANDS, ROWS = 3, 0.5, 36, 3
#: Sets are laid side by side for comparison, so many grams at a time.
_AT_ONCE = 1_000_000


def verified(sets: list[np.ndarray], others: _rooms.Others, t: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those of others(i) with a Jaccard similarity of t at least), by looking up all their grams in i's."""
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    flat = np.concatenate(sets)
    for i in range(1, len(sets)):
        among = others(i)
        among = among[(size[among] >= t * size[i] - 1e-9) & (size[among] * t <= size[i] + 1e-9)]
        found = []
        step = max(1, _AT_ONCE // int(size[i] / t + 1))
        for c in range(0, len(among), step):
            some = among[c : c + step]
            n = size[some]
            grams = flat[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            at = np.minimum(np.searchsorted(sets[i], grams), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == grams).astype(np.int64), np.cumsum(n) - n)
            found.append(some[both / (size[i] + n - both) >= t])
        if found and len(all_ := np.concatenate(found)):
            yield i, all_


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, group_id, links) as ngram_join gives it, of the pairs that agree in a band; the similarity is exact."""
    return _rooms.groups(*_rooms.similar(docs, n, threshold, banded(bands, rows, 7), verified))
