"""The pieces that run in workers, without Spark."""

from __future__ import annotations

import random
from collections import Counter as Bag
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from graphloom.llm import _rooms, byte_bpe, golomb, language_id, license_scan, minhash, mixing, ngram_join, sharding, substring_dedup, token_counts
from graphloom.llm._signatures import signatures
from graphloom.llm._text import gram_sets, rolling, sliding_min, words

TEXTS = st.text(alphabet=st.sampled_from("abAB09 .,'\n\tßéñ日 "), max_size=80)


@given(st.lists(st.integers(0, 2**40), max_size=200))
def test_golomb_round_trip(xs):
    x = np.array(sorted(xs), np.uint64)
    assert golomb.decode(golomb.encode(x)).tolist() == x.tolist()


@given(st.lists(TEXTS, max_size=6))
def test_words_are_the_regular_expressions(texts):
    h, at = words(pa.array(texts, pa.string()))
    parts = [w for t in texts for w in brute.words(t)]
    assert np.diff(at).tolist() == [len(brute.words(t)) for t in texts]
    of: dict[str, int] = {}
    for w, x in zip(parts, h.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


@given(st.lists(TEXTS, min_size=2, max_size=6))
def test_gram_sets_agree_as_sets_do(texts):
    sets = gram_sets(pa.array(texts, pa.string()), 3)
    plain = [brute.gram_set(t, 3) for t in texts]
    for a, x in zip(sets, plain):
        assert len(a) == len(x)
        for b, y in zip(sets, plain):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_rolling_and_sliding_min():
    x = np.random.default_rng(0).integers(0, 2**63, 300, dtype=np.uint64)
    y = np.concatenate([x, x])
    r = rolling(y, 7, 0x5851F42D4C957F2D)
    assert len(r) == 594 and (r[:294] == r[300:]).all() and len(np.unique(r)) == 300
    assert sliding_min(x, 13).tolist() == [x[i : i + 13].min() for i in range(288)]


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.held().ranks
    return tiktoken.Encoding("x", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | TEXTS)
def test_bpe_gives_what_another_encoder_gives(text):
    bpe = byte_bpe.held()
    other = tiktoken.Encoding("x", pat_str=byte_bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ids, at = bpe.encode([text, None, ""])
    assert ids[: at[1]].tolist() == other.encode_ordinary(text)
    assert at[1] == at[2] == at[3]
    assert bpe.decode(ids, at)[0] == text.encode()


def test_bpe_trees_of_either_kind_agree():
    bpe, rng = byte_bpe.held(), random.Random(5)
    raws = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(rng.randint(2, 64))) for _ in range(300)]
    for size in (4, 8, 16, 32, 64):
        some = [r for r in raws if len(r) <= size]
        assert [x.tolist() for x in bpe.many(some, size)] == [bpe.one(r) for r in some]
    merged = byte_bpe.held().one(b"ab" * 20_000)  # n log n, so this ends
    assert b"".join(bpe.bytes_of[i] for i in merged) == b"ab" * 20_000


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 20), TEXTS), max_size=5))
def test_edits_keep_counts_right(text, edits):
    count = token_counts.counter()
    tree = token_counts.TokenTree(text, count)
    for start, length, new in edits:
        start = min(start, len(text))
        text = text[:start] + new + text[start + length :]
        tree.edit(start, start + length, new)
        assert tree.text() == text
        assert tree.total == token_counts.TokenTree(text, count).total


def test_counts_agree_with_the_encoder_and_edits_stay_local(reference):
    text = "Some words, and 1234 more of them. " * 400
    tree = token_counts.TokenTree(text, token_counts.counter())
    assert tree.total == len(reference.encode_ordinary(text))
    tree.edit(5000, 5004, "other")
    assert tree.total == len(reference.encode_ordinary(tree.text()))
    assert tree.encoded < 300


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 100), min_size=1), st.sampled_from([12, 40, 100]))
def test_pfair_stays_within_a_block(weights, period):
    slots = mixing.apportion(weights, period)
    assert sum(slots.values()) == period and set(slots) == set(weights)
    done: Bag = Bag()
    order = mixing.schedule(slots)
    assert [t for _, _, t in order] == list(range(period))
    for s, i, t in order:
        assert i == done[s]
        done[s] += 1
        for x, w in slots.items():
            assert abs(done[x] - Fraction(w * (t + 1), period)) < 1


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(1, 6))
def test_differencing_accounts_for_every_group(sizes, k):
    v = np.zeros((len(sizes), k), np.int64)
    v[:, 0] = sizes
    sums, places = sharding.difference(v)
    got = np.zeros(k, np.int64)
    for row, p in zip(v, places):
        assert sorted(p.tolist()) == list(range(k))
        got[p] += row
    assert got.tolist() == sums.tolist()


def test_differencing_is_tighter_than_greedy():
    rng = np.random.default_rng(1)
    wins = 0
    for _ in range(20):
        sizes = rng.integers(1000, 100_000, 200)
        v = np.zeros((200, 4), np.int64)
        v[:, 0] = sizes
        sums, _ = sharding.difference(v)
        load = [0] * 4
        for x in sorted(sizes.tolist(), reverse=True):
            load[load.index(min(load))] += x
        wins += sums[0] - sums[-1] <= max(load) - min(load)
    assert wins >= 18


PLAIN = st.lists(st.sets(st.integers(1, 40), min_size=1, max_size=25), min_size=2, max_size=12)


def _hashed(plain):
    return [np.sort(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in plain]


def _similar(plain, t):
    return {(a, b) for a in range(len(plain)) for b in range(a) if len(plain[a] & plain[b]) / len(plain[a] | plain[b]) >= t}


@pytest.mark.parametrize("pairs", [ngram_join.t_occurrence, minhash.verified])
@settings(max_examples=60, deadline=None)
@given(PLAIN, st.sampled_from([0.2, 0.4, 0.6, 1.0]))
def test_pairs_are_what_comparing_all_finds(pairs, plain, t):
    got = [(i, j) for i, found in pairs(_hashed(plain), np.arange, t) for j in found.tolist()]
    assert len(got) == len(set(got)) and set(got) == _similar(plain, t)


@pytest.mark.parametrize("probe, heap", [(0, 0), (0, 10**9), (10**9, 0), (10**9, 10**9), (3, 5)])
@settings(max_examples=30, deadline=None)
@given(plain=PLAIN, t=st.sampled_from([0.3, 0.7]))
def test_ways_of_merging_agree(probe, heap, plain, t):
    """Whatever is probed and whatever is merged by the heap."""
    before = ngram_join.PROBE, ngram_join.HEAP
    ngram_join.PROBE, ngram_join.HEAP = probe, heap
    try:
        assert {(i, j) for i, found in ngram_join.t_occurrence(_hashed(plain), np.arange, t) for j in found.tolist()} == _similar(plain, t)
    finally:
        ngram_join.PROBE, ngram_join.HEAP = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 300), min_size=1, max_size=120), min_size=2, max_size=8), st.sampled_from([0.2, 0.4, 0.6, 1.0]))
def test_marks_pass_over_no_similar_pair(plain, t):
    sets = _hashed(plain)
    marks = _rooms.Marks(np.array([len(s) for s in sets]), _rooms.parity(sets), t)
    a, b = (np.array(x) for x in zip(*((a, b) for a in range(len(sets)) for b in range(a))))
    able = {(int(x), int(y)) for x, y, ok in zip(a, b, marks.able(a, b)) if ok}
    assert _similar(plain, t) <= able
    rooms = _rooms.needed(marks, 0, np.zeros((0, len(sets)), np.int64), None)
    assert set(np.flatnonzero(rooms).tolist()) == {x for p in able for x in p}


def test_marks_tell_unlike_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in rng.integers(200, 400, 60)]
    marks = _rooms.Marks(np.array([len(s) for s in sets]), _rooms.parity(sets), 0.4)
    a, b = np.triu_indices(60, 1)
    assert not marks.able(a, b).any()


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    s = signatures([np.sort(a), np.sort(b)], 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.08


@given(st.lists(TEXTS, max_size=5))
def test_subwords_are_those_of_the_plain_version(texts):
    ids, at = language_id.subwords(pa.array(texts, pa.string()))
    shift = 32 - int(np.log2(language_id.BUCKETS))

    def bucket(g: bytes) -> int:
        return ((int.from_bytes(g, "big") ^ (len(g) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> shift

    for k, t in enumerate(texts):
        assert Bag(ids[at[k] : at[k + 1]].tolist()) == Bag(map(bucket, brute.subwords(t)))


def test_a_sketch_never_counts_too_few():
    rng = np.random.default_rng(3)
    d = rng.integers(0, 2**63, 500, dtype=np.uint64)
    width = 64  # far too small, so that collisions abound
    counters = np.zeros(width * substring_dedup.DEPTH, np.int64)
    for x in (d, d[:100]):
        np.add.at(counters, substring_dedup._cells(x, width).astype(np.int64).ravel(), 1)
    c = np.minimum(counters, 2).astype(np.uint8).reshape(-1, 4)
    packed = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    assert substring_dedup.estimated_repeated(d[:100], packed, width).all()


def test_license_keywords_lose_no_match():
    """Each rule alone, without the prefilter, finds no more than with it."""
    s = license_scan.scanner()
    assert len(s.rules) >= 200
    texts = [
        "Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file",
        "SPDX-License-Identifier: MIT\nReleased under the MIT License. See https://opensource.org/licenses/MIT",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "BSD 3-Clause License and the\n#  Mozilla Public License, v. 2.0",
        "nothing of the kind",
        "",
    ]
    for t in texts:
        every = license_scan.resolve([(m.start(), m.end(), r) for r in s.rules for m in r.pattern.finditer(t)])
        assert s.scan(t) == every
    assert [r.license for _, _, r in s.scan(texts[0])] == ["Apache-2.0"]
    assert {r.license for _, _, r in s.scan(texts[1])} == {"MIT"}
    assert not s.scan(texts[4])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10), st.integers(0, 3)), max_size=15))
def test_license_suppression_by_its_definition(spans):
    rules = [license_scan.Rule(i, str(i), p, "", None) for i, (_, _, p) in enumerate(spans)]
    found = [(s, s + n, r) for (s, n, _), r in zip(spans, rules)]
    taken: list = []
    for p in sorted({r.priority for r in rules}, reverse=True):
        level = [x for x in found if x[2].priority == p and not any(a < x[1] and x[0] < b for a, b, _ in taken)]
        taken += [x for x in level if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] and ((y[0], y[1]) != (x[0], x[1]) or y[2].number < x[2].number) for y in level)]
    assert license_scan.resolve(found) == sorted(taken, key=lambda x: (x[0], x[1], x[2].number))
