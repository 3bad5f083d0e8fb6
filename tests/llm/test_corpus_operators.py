"""Every operator on Spark: against brute force on the smallest tables, and on awkward rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
from conftest_shared import matches_oracle
from graphloom.llm import byte_bpe, exact_dedup, language_id, license_scan, minhash, mixing, ngram_join, queries, sharding, substring_dedup, token_counts
from graphloom.llm._rooms import components, groups, similar
from graphloom.llm._signatures import banded
from graphloom.llm._stage import sized, split, staged


@pytest.fixture(scope="module")
def texts(small) -> dict[int, str]:
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, small, name):
    matches_oracle(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], small)


def test_exact_dedup(docs, texts, monkeypatch):
    first: dict[str, int] = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    want = {(i, first[t]) for i, t in texts.items() if first[t] != i}
    assert {tuple(r) for r in exact_dedup.duplicates(docs).collect()} == want and want
    # with hardly any bits fingerprints collide, and bytes decide
    assert {tuple(r) for r in exact_dedup.duplicates(docs, -6).collect()} == want
    monkeypatch.setattr(exact_dedup, "text_hash", lambda: F.pmod(F.xxhash64("text"), F.lit(5)))
    assert {tuple(r) for r in exact_dedup.duplicates(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.without_duplicates(docs).collect()} == set(first.values())


def test_ngram_join_and_groups(docs, texts):
    want = brute.similar_documents(texts, ngram_join.N, ngram_join.THRESHOLD)
    rows = ngram_join.ngram_join(docs).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    assert {tuple(r) for r in rows} == want and any(r.links for r in rows)
    kept = {r.doc_id for r in ngram_join.one_of_each_group(docs).collect()}
    assert kept == set(texts) - {i for i, _, g, _ in want if g != i}


def test_minhash(docs, texts):
    want = brute.similar_documents(texts, minhash.N, minhash.THRESHOLD)
    rows = minhash.near_duplicates(docs).collect()
    assert {tuple(r) for r in rows} == want and any(r.links for r in rows)


@pytest.mark.parametrize("keys, pairs", [(ngram_join.minima(40, 2), ngram_join.t_occurrence), (banded(36, 3, 7), minhash.verified)])
def test_rooms_of_many_blocks(spark, keys, pairs):
    """Rooms that are dealt into blocks give what undivided ones give."""
    rows = []
    for g in range(3):
        for i in range(40):
            w = [f"w{g}x{k}" for k in range(60)]
            w[i] = f"edit{g}x{i}"
            w[(7 * i) % 60] = "other"
            rows.append((g * 100 + i, " ".join(w[: 60 - i % 5])))
    rows += [(500 + i, f"text that stands alone {i} " + " ".join(f"z{i}y{k}" for k in range(9))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{tuple(r) for r in groups(*similar(docs, 3, 0.5, keys, pairs, b)).collect()} for b in (10**6, 500, 120)]
    assert got[0] == got[1] == got[2] == brute.similar_documents(dict(rows), 3, 0.5)


def test_an_id_with_several_texts(spark):
    a, b = "one two three four five six seven eight", "red green blue cyan pink gold grey teal"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " nine"), (3, b + " black"), (3, b + " black"), (4, "quite another text")], "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {(1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 1)}


def test_substring_dedup(spark, docs, texts):
    want = brute.passages(texts, substring_dedup.WINDOW)
    rows = {(r.doc_id, r.start_word, r.end_word, r.first_doc) for r in substring_dedup.repeated_passages(docs).collect()}
    assert rows == want and want
    # a sketch that is far too small lets everything through and changes nothing
    assert {(r.doc_id, r.start_word, r.end_word, r.first_doc) for r in substring_dedup.repeated_passages(docs, sketch_bytes=300).collect()} == want


def test_byte_bpe(docs, texts):
    other = tiktoken.Encoding("x", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.held().ranks, special_tokens={})
    coded = byte_bpe.encoded(docs)
    rows = coded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.token_ids == other.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip
    assert {r.doc_id: r.text for r in byte_bpe.decoded(coded).collect()} == texts


def test_token_counts(spark, docs, texts):
    other = tiktoken.Encoding("x", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.held().ranks, special_tokens={})
    rules = token_counts.masking()
    for r in token_counts.token_counts(docs).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(other.encode_ordinary(text))
        edits = rules(text)
        for s, e, new in edits:
            text = text[:s] + new + text[e:]
        assert (r.n_edits, r.n_tokens_after) == (len(edits), len(other.encode_ordinary(text)))
    given = spark.createDataFrame([(1, "one two three", [(4, 7, "2"), (0, 0, "zero ")]), (2, "x", None), (3, None, [(0, 0, "y")])], "doc_id long, text string, changes array<struct<start:int,end:int,new:string>>")
    out = {r.doc_id: r for r in token_counts.token_counts(given, "changes").collect()}
    assert out[1].n_tokens_after == len(other.encode_ordinary("zero one 2 three")) and out[1].n_edits == 2
    assert out[2].n_tokens_after == out[2].n_tokens == 1 and out[3].n_tokens is None


def test_language_id_is_right_on_texts_it_never_saw(spark, small):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    rows = [r for r in t if r["text"] and r["lang"]]
    train, test = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    model = language_id.fit([r["text"] for r in train], [r["lang"] for r in train])
    p = model.probabilities(pa.array([r["text"] for r in test]))
    right = [model.labels[i] == r["lang"] for i, r in zip(p.argmax(axis=1), test)]
    assert sum(right) / len(right) > 0.95
    assert (p.max(axis=1) < model.threshold).mean() < 0.05
    assert model.probabilities(pa.array(["12345 !!! 67"])).max() == 0
    a, b = language_id.train(spark.read.parquet(f"{small}/documents.parquet")), language_id.train(spark.read.parquet(f"{small}/documents.parquet").repartition(7))
    assert a.labels == b.labels and (a.table == b.table).all() and a.threshold == b.threshold


def test_license_scan(docs, texts):
    s = license_scan.scanner()
    want = {(i, r.license, r.number, a, b) for i, t in texts.items() for a, b, r in license_scan.resolve([(m.start(), m.end(), r) for r in s.rules for m in r.pattern.finditer(t)])}
    got = [tuple(r) for r in license_scan.license_scan(docs).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_mixing_keeps_proportions(docs, texts, small):
    source = {r["doc_id"]: r["source"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    weights = {s: float(1 + k % 3) for k, s in enumerate(sorted(set(source.values())))}
    block = 2000
    slots = mixing.apportion(weights, 200)
    kept = {r.doc_id for r in mixing.to_weights(docs, weights, block, 200).collect()}
    total: dict[str, int] = {}
    for i in kept:
        total[source[i]] = total.get(source[i], 0) + len(texts[i].encode())
    ends = mixing.horizon(docs, weights, block, 200)
    longest = max(len(t.encode()) for t in texts.values())
    for s, n in ends.items():
        assert n * block - longest <= total.get(s, 0) <= n * block + longest
    t = sum(ends.values())
    assert all(abs(n - t * slots[s] / 200) < 1 for s, n in ends.items())
    order = mixing.mixed(docs, weights, block, 200).collect()
    assert len(order) == len(texts) and all(r.source == source[r.doc_id] for r in order)


@pytest.mark.parametrize("fan", [1024, 4])
def test_sharding(docs, texts, fan):
    rows = sharding.sharded(docs, shards=5, fan=fan).collect()
    shard = {r.doc_id: r.shard for r in rows}
    assert len(rows) == len(shard) == len(texts) and set(shard.values()) <= set(range(5))
    of: dict[str, set] = {}
    load = [0] * 5
    for i, t in texts.items():
        of.setdefault(t, set()).add(shard[i])
        load[shard[i]] += len(t.encode())
    assert all(len(x) == 1 for x in of.values())
    largest = max(len(t.encode()) * sum(x == t for x in texts.values()) for t in texts.values())
    # differencing leaves a spread of one group at most, and far less where a cell has many groups to combine
    assert max(load) - min(load) <= largest
    if fan > len(texts):  # one cell, so it is differencing of all groups
        sizes = sorted((len(t.encode()) * sum(x == t for x in texts.values()) for t in set(texts.values())), reverse=True)
        assert sorted(load, reverse=True) == brute.differencing(sizes, 5)


def test_rows_are_split_by_a_filter_of_keys(spark):
    df = spark.createDataFrame([(i if i % 7 else None, f"r{i}", 1, True) for i in range(500)], "id long, x string, __key int, __maybe boolean")
    found = spark.range(0, 500, 3).toDF("k")
    for limit, bits in ((1 << 20, 1 << 28), (0, 1 << 28), (0, 1 << 12), (0, 1 << 6)):
        inside, apart = split(df, F.col("id"), found, 167, limit, max(bits, 64))
        assert inside.columns == apart.columns == df.columns
        assert sorted(r.x for r in inside.collect()) == sorted(f"r{i}" for i in range(500) if i % 7 and i % 3 == 0)
        assert sorted(r.x for r in apart.collect()) == sorted(f"r{i}" for i in range(500) if not (i % 7 and i % 3 == 0))


def test_exact_dedup_beyond_the_broadcast(docs):
    assert {tuple(r) for r in exact_dedup.duplicates(docs, limit=0).collect()} == {tuple(r) for r in exact_dedup.duplicates(docs).collect()}
    key = lambda r: (r.doc_id, r.text)
    assert sorted(exact_dedup.without_duplicates(docs, limit=0).collect(), key=key) == sorted(exact_dedup.without_duplicates(docs).collect(), key=key)


def test_decoding_of_odd_lists(spark):
    a = byte_bpe.held().ranks[b"a"]
    t = spark.createDataFrame([(1, [a, None, a]), (2, []), (3, None), (None, [a, 10**8])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in byte_bpe.decoded(t).collect()} == {1: "a\ufffda", 2: "", 3: None, None: "a\ufffd"}


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (101, 100), (200, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, rep long, fp long, block int, keys string, `__v` string, `__FP` string, `__h` int, `__row` int, `__source` int, `__last` int, `__doc` int, `__slot` int, `__gone` long"
LONG = "word number eleven, again and again. " * 60_000
ROWS = [
    (1, "the same text of some words here", "en", "a"),
    (2, "the same text of some words here", "en", "a"),
    (2, "the same text of some words here", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (None, "the same text of some words here", "en", "a"),
    (None, None, None, None),
    (5, "x", "fr", "b"),
    (6, LONG, "en", "b"),
    (7, "Überall \U0001f600 日本 \t\n", "de", "a"),
    (8, "   ", None, "a"),
    (8, "\0 zero", None, "z"),
]


def awkward(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "k", "v", "f", 1, 2, 3, 4, 5, 6, 7) for r in rows], AWKWARD)


OPERATORS = {
    "token_counts": token_counts.token_counts,
    "substring_dedup": lambda d: substring_dedup.repeated_passages(d, 4),
    "ngram_join": ngram_join.ngram_join,
    "one_of_each_group": ngram_join.one_of_each_group,
    "language_id": lambda d: language_id.identified(d, language_id.train(d)),
    "accepted": lambda d: language_id.accepted(d, language_id.train(d)),
    "mixed": lambda d: mixing.mixed(d, None),
    "mixed by weights": lambda d: mixing.mixed(d, {"a": 1.0, "none": 2.0, "b": 0.0}),
    "scheduled": lambda d: mixing.scheduled(d, mixing.target_weights(d, 0.5)),
    "to_weights": lambda d: mixing.to_weights(d, mixing.target_weights(d, 0.5)),
    "license_scan": license_scan.license_scan,
    "byte_bpe": byte_bpe.encoded,
    "duplicates": exact_dedup.duplicates,
    "without_duplicates": exact_dedup.without_duplicates,
    "sharding": sharding.sharded,
    "minhash": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    out = OPERATORS[name](awkward(spark, []))
    assert out.collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    OPERATORS[name](awkward(spark, [(None,) * 4] * 3)).collect()


def test_awkward_rows(spark):
    d = awkward(spark)
    out = {name: f(d).collect() for name, f in OPERATORS.items()}
    assert {tuple(r) for r in out["duplicates"]} == {(2, 1)} and len(out["duplicates"]) == 1
    kept = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in out["without_duplicates"])
    assert kept == sorted([(1, "the s"), (3, ""), (4, ""), (0, ""), (5, "x"), (6, "word "), (7, "Übera"[:5]), (8, "   "), (8, "\0 zer")])
    for name in ("ngram_join", "minhash"):
        assert sorted(tuple(r) for r in out[name]) == [(1, 1, 1, 0), (2, 1, 1, 0)]
    assert len(out["one_of_each_group"]) == len(ROWS) - 2
    assert out["one_of_each_group"][0].__fields__ == d.columns
    assert {(r.doc_id, r.start_word, r.end_word, r.first_doc) for r in out["substring_dedup"]} == {(1, 0, 7, 1), (2, 0, 7, 1)}
    for name in ("token_counts", "byte_bpe", "language_id"):
        assert len(out[name]) == len(ROWS)
    assert {r.doc_id: r.n_tokens for r in out["byte_bpe"] if r.doc_id in (3, 4)} == {3: 0, 4: None}
    assert all(r.round_trip for r in out["byte_bpe"] if r.n_tokens is not None)
    assert all(r.rejected for r in out["language_id"] if r.doc_id in (3, 4, 8) and r.predicted is None)
    assert len({r.doc_id for r in out["mixed"]}) == len(out["mixed"]) == 8
    assert sorted({r.source for r in out["mixed by weights"]}) == ["a"]
    shards = {r.doc_id: r.shard for r in out["sharding"]}
    assert sorted(shards) == [1, 2, 3, 4, 5, 6, 7, 8] and shards[1] == shards[2]


def test_what_is_staged_and_what_is_broadcast(spark):
    d = spark.range(10)
    assert staged(d).count() == 10
    plan = lambda limit: d.join(sized(spark.range(5), 5, 8, limit), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(40) and "strategy=broadcast" not in plan(39)
