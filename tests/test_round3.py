"""Faults that a reader found at size, each with what would have failed before."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.extraction_queries import ORDER, Clerk
from graphloom.functions import text
from graphloom.operators import chunk, dense, stats
from graphloom.operators.build import Graph

WORDS = ["The Café's  Noir", "an ÆON", "İstanbul ﬁn", "the", "A  b-c_d", "Straße 5½", "x’s y's", "", "  KK ", "áb"]


def test_plain_folds_agree_with_columns(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", text.fold_id("w").alias("a"), text.normalize_name("w").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(text.plain_fold(r.w), text.plain_name(r.w)) for r in rows]


def test_dense_extraction_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "This is order 7 of status O. There is item a flag N quantity 3 in it."), (2, None), (None, "x"), (3, " ")], "k long, text string")
    found = dense.dense(docs, "k", ORDER, Clerk)
    for df in (found.records, found.instances, found.ledger, found.chunks):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    (r,) = found.records.collect()
    assert r.k == 1 and json.loads(found.records.select(F.to_json("record")).first()[0]) == {"number": "7", "status": "O", "lines": [{"item": "a", "flag": "N", "quantity": 3}]}
    assert [(x.document, x.instance, x.parent, x.rung) for x in found.instances.collect()] == [(1, "lines[]|item=a", "", "root")]


def test_short_values_are_searched_as_words_of_their_own():
    assert dense._spans(["7"], ["item 17 of 70", "order 7, again 7"]) == [(1, 6, 7)]
    assert dense._spans(["100", "AB"], ["x1001", "is 100.", "cab ab"]) == [(1, 3, 6), (2, 4, 6)]
    assert len(dense._spans(["long one"], ["a Long One b"] * 9)) == 9


def test_ledger_shows_what_was_searched(spark):
    docs = spark.createDataFrame([(k, f"This is order {k} of status O.") for k in (5, 50, 500, 5000)], "k long, text string")
    assert {r.kind for r in dense.dense(docs, "k", ORDER, Clerk).ledger.collect()} == {"verbatim"}


def _plain(near: dict, nodes: set) -> tuple[dict, tuple]:
    """Betweenness and path summary by counting all shortest paths of all pairs."""
    between, hops = dict.fromkeys(nodes, 0.0), []
    far = {}
    for s in near:
        dist, count, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        far[s] = dist, count
    for s in near:
        d, c = far[s]
        hops += [n for v, n in d.items() if s in nodes and v != s]
        for t in d:
            for v in nodes & d.keys():
                if s < t and v not in (s, t) and d[v] + far[v][0][t] == d[t]:
                    between[v] += c[v] * far[v][1][t] / c[t]
    return between, (len(hops), sum(hops) / len(hops), max(hops))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trees_on_a_core_count_as_all_pairs(spark, seed):
    import random

    r = random.Random(seed)
    # cycles with trees on them, a lone tree, a pair, a lone node, a loop, a repeated edge, and ends that are no nodes
    pairs = [(f"a{i}", f"a{(i + 1) % 6}") for i in range(6)] + [("a0", "a3")] + [(f"a{r.randrange(i)}", f"a{i}") for i in range(6, 20)]
    pairs += [(f"t{r.randrange(i)}", f"t{i}") for i in range(1, 9)] + [("p", "q"), ("a1", "a1"), ("a1", "a0"), ("x", "a2"), ("y", "x"), ("t0", "z")]
    nodes = {e for p in pairs for e in p} - {"x", "y", "z"} | {"lone"}
    near: dict = {v: set() for p in pairs for v in p}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    g = Graph(spark.createDataFrame([(v,) for v in sorted(nodes)], "node_id string"), spark.createDataFrame(pairs, "src string, dst string"))
    between, summary = _plain(near, nodes)
    assert tuple(stats.path_summary(g).first()) == pytest.approx(summary)
    assert {x.node_id: x.betweenness for x in stats.betweenness(g).collect()} == pytest.approx(between)


def test_a_large_star_is_quick():
    near = {"m": [f"s{i}" for i in range(100_000)]} | {f"s{i}": ["m"] for i in range(100_000)}
    up, core = stats._shrunk(near)
    assert len(core) == 1 and len(up) == 100_000


def test_stream_parents_go_by_time_over_many_frames(spark, tmp_path):
    from graphloom.streaming.incremental import running_parents

    n = 500
    spark.range(n).selectExpr("1L as user", "id as event_id", f"timestamp_seconds(1000 + (id * 37) % {n}) as ts", "id % 7 = 0 as p").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        out = running_parents(spark.readStream.schema("user long, event_id long, ts timestamp, p boolean").parquet(f"{tmp_path}/in"), "user", "ts", "p", "1 hour")
        q = out.writeStream.format("memory").queryName("many_frames").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, None
    for e in sorted(range(n), key=lambda e: (e * 37 % n, e)):
        last = e if e % 7 == 0 else last
        want[e] = last
    assert {r.event_id: r.parent for r in spark.table("many_frames").collect()} == want


def test_chunks_are_whole_in_slices(spark, monkeypatch):
    texts = [(k, f"w{k} " * 900) for k in range(40)]
    docs = spark.createDataFrame(texts, "k long, text string").coalesce(1)
    monkeypatch.setattr(chunk, "_HELD", 1000)
    assert "MapInArrow" in chunk.chunks(docs, "k")._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.k, r.chunk_id, r.text) for r in chunk.chunks(docs, "k", limit=100).collect())
    assert got == [(k, i, c) for k, t in texts for i, c in enumerate(chunk.split_text(t, 100))]
