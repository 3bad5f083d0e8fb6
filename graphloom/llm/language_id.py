"""Language identification: averaged hashed subword embeddings with a linear softmax.

The subwords of a text are the byte n-grams (2 to 4 bytes) of its lower-cased words with
a space on either side, hashed to `buckets` rows of an embedding table. A text's vector
is the average of its subwords' rows; a softmax over a linear map gives the languages.
Both are trained by stochastic gradient descent in numpy on at most `sample` labelled
rows, whole texts, those of the least hashes of their ids and texts. A quarter of the sample is
held out to fit a temperature, and the rejection threshold is where `lost` of the
held-out texts that are recognised rightly fall below it. A single language has no
other to be told from: its score is the likelihood of a text's subwords in it against
that of all buckets alike.

After training, table times map is a table of one number for a bucket and a language,
so scoring is one look-up for a subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import importable
from ._text import _IN_WORD, give_back, slices

SAMPLE, BUCKETS, DIM, EPOCHS, LOST = 2000, 1 << 15, 16, 6, 0.001
ORDERS = (2, 3, 4)


def subwords(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, text by text, and where each text's begin."""
    t = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    space = pa.scalar(" ", pa.large_string())
    t = pc.binary_join_element_wise(space, t, space, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    raw = np.frombuffer(t.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letters = _IN_WORD[raw] & ~((raw >= 48) & (raw <= 57))
    x = np.where(letters, raw, 32).astype(np.uint32)
    # of a run of separators one stays, so that n-grams lie in a word with its two ends
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    if len(offsets) > 1:
        starts = offsets[:-1]
        keep[starts] = letters[np.minimum(starts + 1, len(letters) - 1)]
        ahead = np.zeros(len(keep), bool)
        ahead[:-1] = letters[1:]
        keep |= ahead & ~letters
        keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    x, letters = x[keep], letters[keep]
    shift = np.uint32(32 - int(np.log2(buckets)))
    ids, owner = [], []
    code = x.copy()
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | x[n - 1 :]
        if n not in ORDERS or not len(code):
            continue
        # at least one letter, and separators only at the ends
        inner = np.ones(len(code), bool)
        for j in range(1, n - 1):
            inner &= letters[j : j + len(code)]
        if n == 2:
            inner = letters[: len(code)] | letters[1 : 1 + len(code)]
        place = np.flatnonzero(inner)
        ids.append(((code[place] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> shift).astype(np.int32))
        owner.append(place)
    if not ids:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    # text by text: where each order's places fall among the texts
    parts = [np.searchsorted(p, at) for p in owner]
    counts = sum(np.diff(p) for p in parts)
    to = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(to[-1]), np.int32)
    base = to[:-1].copy()
    for p, i in zip(parts, ids):
        n = np.diff(p)
        out[np.repeat(base - p[:-1], n) + np.arange(p[0], p[-1])] = i[p[0] : p[-1]]
        base = base + n
    return out, to


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A row for each text; of a text without subwords all 0."""
        ids, at = subwords(texts, len(self.table))
        n = np.diff(at)
        out = np.zeros((len(n), len(self.labels)))
        some = np.flatnonzero(n)
        if len(some) and len(self.labels):
            for c in range(len(self.labels)):
                out[some, c] = np.add.reduceat(self.table[:, c][ids].astype(np.float64), at[:-1][some])
            z = (out[some] / n[some, None] + self.bias) / self.temperature
            out[some] = _chances(z)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _chances(z: np.ndarray) -> np.ndarray:
    """A softmax; of a single column against 0, which stands for no language."""
    return _softmax(z) if z.shape[1] > 1 else _softmax(np.hstack([z, np.zeros_like(z)]))[:, :1]


def fit(texts: list[str], labels: list[str], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, lost: float = LOST, seed: int = 11) -> Model:
    """Without a labelled text the model has no language and rejects everything."""
    names = tuple(sorted(set(labels)))
    if not names:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    docs = []
    # a slice of the sample at a time, as its subwords take many times its bytes
    for b in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        ids, at = subwords(b["text"], buckets)
        docs += [np.unique(ids[i:j], return_counts=True) for i, j in zip(at[:-1], at[1:])]
    give_back()
    usable = np.array([i for i, d in enumerate(docs) if len(d[0])], np.int64)
    held = usable[3::4]
    train = np.setdiff1d(usable, held)
    e = rng.normal(0, 0.1, (buckets, dim))
    w, bias = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    steps, step = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            which, count = docs[i]
            part = count / count.sum()
            v = part @ e[which]
            g = _softmax((v @ w + bias)[None])[0]
            g[y[i]] -= 1
            rate = 0.5 * (1 - step / steps)
            back = w @ g
            w -= rate * np.outer(v, g)
            bias -= rate * g
            # scaled by the document's subwords, else each row would move by a share of the step only
            e[which] -= rate * np.outer(part * min(len(which), 200), back)
            step += 1
    table = (e @ w).astype(np.float32)
    if len(names) == 1:
        seen = np.ones(buckets)
        for i in train:
            seen[docs[i][0]] += docs[i][1]
        table, bias = np.log(seen / seen.sum() * buckets).astype(np.float32)[:, None], np.zeros(1)
    model = Model(names, table, bias, 1.0, 0.0)
    if not len(held):
        return model
    logits = np.stack([docs[i][1] / docs[i][1].sum() @ table[docs[i][0]] + bias for i in held])
    k = 1.0
    if len(names) > 1:
        # targets short of 1, as one text more of each outcome gives; else where all are right the temperature falls until every text is certain
        target = np.full((len(held), len(names)), 1 / (len(held) + 2) / (len(names) - 1))
        target[np.arange(len(held)), y[held]] = (len(held) + 1) / (len(held) + 2)
        grid = np.geomspace(0.05, 10, 40)
        loss = [-(target * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum(axis=1).mean() for t in grid]
        k = float(grid[int(np.argmin(loss))])
    p = _chances(logits / k)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    # no lower than what mere chance gives; less by what sums in another order may differ
    chance = 1 / max(2, len(names))
    threshold = max(chance, float(np.quantile(right, lost)) - 1e-9) if len(right) else chance
    return Model(names, table, bias, k, threshold)


def train(docs: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """A model from the rows of docs with a text and a lang: the `sample` rows of the least hashes, the bound of what the driver gathers. Rows that repeat an id, text and lang count once.

    Rows are counted first, so that only those below a hash that about so many are below leave the executors, whatever the number of tasks.
    """
    some = docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    left = some.count()
    share = min(1.0, (sample + 6 * sample**0.5 + 50) / max(left, 1))
    while True:
        below = some if share >= 1 else some.filter(F.col("h") < int(share * 2**64) - 2**63)
        rows = sorted(below.dropDuplicates(["h", "lang"]).collect(), key=lambda r: (r.h, r.lang))[:sample]
        if len(rows) == sample or share >= 1:
            return fit([r.text for r in rows], [r.lang for r in rows], **options)
        share = min(1.0, 2 * share)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, predicted, confidence, rejected) for every row; lang is the row's label. A text without letters and a null text have no prediction, confidence 0, and are rejected. Of labels that are equally likely the first by name is predicted. Rows without doc_id and repeated rows stay."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                p = model.probabilities(b["text"])
                best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), np.int64)
                sure = p.max(axis=1) if p.shape[1] else np.zeros(len(p))
                names = [model.labels[i] if c > 0 else None for i, c in zip(best, sure)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], pa.array(names, pa.string()), pa.array(sure), pa.array((sure < model.threshold) | (sure == 0))], ["doc_id", "lang", "predicted", "confidence", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, lang string, predicted string, confidence double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they are."""
    importable(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])
            out = [np.zeros(0, bool)]
            for b in slices(batch):
                p = model.probabilities(b["text"])
                sure = p.max(axis=1) if p.shape[1] else np.zeros(len(p))
                out.append((sure >= model.threshold) & (sure > 0))
            yield pd.Series(np.concatenate(out))
        give_back()

    return docs.filter(F.col("text").isNotNull()).filter(kept("text"))
