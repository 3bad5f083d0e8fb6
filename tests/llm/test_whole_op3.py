"""The n-gram join finds pairs that agree in no band of minima."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from graphloom.llm import ngram_join
from graphloom.llm._prefixes import levels, prefixes
from graphloom.llm._text import gram_sets


def edited(seed: int, pairs: int) -> dict[int, str]:
    """Pairs of texts of which the second has other words at its end, so that they are just similar enough."""
    r = random.Random(seed)
    out = {}
    for k in range(pairs):
        w = [f"w{r.randrange(10**9)}" for _ in range(34)]
        out[2 * k] = " ".join(w)
        out[2 * k + 1] = " ".join([*w[:21], *(f"x{r.randrange(10**9)}" for _ in range(13))])
    return out


def missed(texts: dict[int, str]) -> dict[int, str]:
    """Those pairs of edited() that agree in no band."""
    keys = ngram_join.minima(ngram_join.BANDS, ngram_join.ROWS)(gram_sets(pa.array(list(texts.values())), ngram_join.N))
    apart = np.flatnonzero((keys[0::2] != keys[1::2]).all(axis=1)).tolist()
    return {i: texts[i] for k in apart for i in (2 * k, 2 * k + 1)}


def test_pairs_that_agree_in_no_band(spark):
    texts = missed(edited(1, 6000))
    assert len(texts) >= 4
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.similar_documents(texts, ngram_join.N, ngram_join.THRESHOLD)
    assert len(want) == len(texts) and {tuple(r) for r in ngram_join.ngram_join(docs).collect()} == want


@pytest.mark.parametrize("bands", [1, 40])
def test_bands_change_nothing(spark, docs_of_groups, bands):
    """With few bands links are missing within groups and between them."""
    texts = docs_of_groups
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.ngram_join(docs, bands=bands).collect()]
    assert len(got) == len({i for i, *_ in got}) and set(got) == brute.similar_documents(texts, ngram_join.N, ngram_join.THRESHOLD)


@pytest.fixture(scope="module")
def docs_of_groups() -> dict[int, str]:
    r = random.Random(3)
    out, common = {}, [f"c{k}" for k in range(30)]
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(r.choice([6, 20, 60]))] + common[: 2 * g]
        for _ in range(r.choice([2, 5, 40])):
            w = list(base)
            for _ in range(len(w) // 8):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            out[len(out)] = " ".join(w[: len(w) - r.randrange(len(w) // 3)])
    for _ in range(60):
        out[len(out)] = " ".join(r.choice("abc") for _ in range(r.randrange(1, 9)))
    out |= {len(out) + k: out[k] for k in range(5)}
    return out


def test_an_id_with_several_texts_and_few_bands(spark):
    a, b = "one two three four five six seven eight", "red green blue cyan pink gold grey teal"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " nine"), (3, b + " black"), (3, b + " black"), (4, "quite another text")], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.ngram_join(docs, bands=1, rows=9).collect()} == {(1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 1)}


@pytest.mark.parametrize("bits", [1 << 31, 1 << 16])
def test_prefixes_of_similar_texts_share_a_key(spark, docs_of_groups, bits):
    """However small the filters."""
    docs = spark.createDataFrame(list(docs_of_groups.items()), "doc_id long, text string")
    keys = {r.rep: set(r["keys"]) for r in prefixes(docs, 3, 0.4, levels(docs, 3, bits)).collect()}
    pairs = brute.jaccard_pairs(docs_of_groups, 3, 0.4)
    assert pairs and all(keys[a] & keys[b] for a, b in pairs)
