"""The corpus pipeline against a plain version of every stage, each on what the stage before it kept."""

from __future__ import annotations

import pyarrow as pa
import pytest
import tiktoken

import brute
from graphloom.llm import byte_bpe, language_id, mixing, ngram_join


@pytest.fixture(scope="module")
def kept(spark, small):
    """The rows of every stage, written and read again as the driver does."""
    import corpus_pipeline
    from graphloom.llm._stage import staged

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [("documents", docs, [r.asDict() for r in docs.collect()])]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, small))
        out.append((name, docs, [r.asDict() for r in docs.collect()]))
    return out


def test_stages_are_the_five_in_order(kept):
    assert [k for k, _, _ in kept[1:]] == ["language_id", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]
    for _, docs, _ in kept[1:-1]:
        assert docs.columns == kept[0][1].columns and [t for _, t in docs.dtypes] == [t for _, t in kept[0][1].dtypes]
    sizes = [len(rows) for _, _, rows in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[3] < sizes[2]


def test_language_stage_keeps_what_the_model_is_sure_of(kept):
    rows = kept[0][2]
    model = language_id.train(kept[0][1])
    names = {}
    want = set()
    for r in rows:
        p = [0.0]
        if r["text"] and (grams := brute.subwords(r["text"])):
            ids, at = language_id.subwords(pa.array([r["text"]]))
            assert len(ids) == len(grams)
            z = (model.table[ids].astype(float).mean(axis=0) + model.bias) / model.temperature
            e = [2.718281828459045 ** (x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
        names[r["doc_id"]] = max(p)
        if max(p) >= model.threshold and max(p) > 0:
            want.add(r["doc_id"])
    got = {r["doc_id"] for r in kept[1][2]}
    assert all(abs(names[i] - model.threshold) < 1e-6 for i in got ^ want)
    assert len(got) >= 0.97 * len(rows)


def test_exact_dedup_stage(kept):
    first: dict[str, int] = {}
    for r in sorted(kept[1][2], key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert {r["doc_id"] for r in kept[2][2]} == set(first.values())


def test_near_duplicate_stage(kept):
    texts = {r["doc_id"]: r["text"] for r in kept[2][2]}
    pairs = brute.jaccard_pairs(texts, ngram_join.N, ngram_join.THRESHOLD)
    root = brute.roots(texts, pairs)
    assert {r["doc_id"] for r in kept[3][2]} == {i for i in texts if root[i] == i}


def test_mixing_stage(spark, kept):
    """Every document stays, and they come in the order of a schedule that fills and places blocks one by one."""
    import hashlib

    import corpus_pipeline

    rows = kept[3][2]
    assert sorted(r["doc_id"] for r in kept[4][2]) == sorted(r["doc_id"] for r in rows)
    size: dict[str, int] = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].encode())
    slots = mixing.apportion({s: float(b) ** corpus_pipeline.EXPONENT for s, b in size.items()})
    cycle = [s for s, _, _ in sorted(mixing.schedule(slots), key=lambda x: x[2])]
    places: dict[str, list[int]] = {s: [] for s in size}
    at = 0
    while any(len(places[s]) <= b // corpus_pipeline.BLOCK_BYTES for s, b in size.items()):
        for s in cycle:
            places[s].append(at)
            at += 1
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = []
    for s in size:
        before = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (md5(r["doc_id"]), r["doc_id"])):
            want.append((places[s][before // corpus_pipeline.BLOCK_BYTES], md5(r["doc_id"]), r["doc_id"]))
            before += len(r["text"].encode())
    assert [r.doc_id for r in corpus_pipeline.mix(spark, kept[3][1], "").collect()] == [i for _, _, i in sorted(want)]


def test_encoding_stage(kept):
    texts = {r["doc_id"]: r["text"] for r in kept[4][2]}
    other = tiktoken.Encoding("x", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.held().ranks, special_tokens={})
    assert {r["doc_id"]: r["token_ids"] for r in kept[5][2]} == {i: other.encode_ordinary(t) for i, t in texts.items()}


def test_run_is_its_stages(spark, small, kept):
    import corpus_pipeline

    got = [r.asDict() for r in corpus_pipeline.run(spark, small).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(kept[-1][2], key=key)
