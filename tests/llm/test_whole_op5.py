"""op5 over tables with sources that its weights don't name."""

from __future__ import annotations

from graphloom.llm import mixing, queries


def test_every_source_has_slots(spark, tmp_path):
    rows = [(i, "x" * 70_000, s) for i, s in enumerate(["src0", "src1", "src20", "other", None, ""] * 3)]
    spark.createDataFrame([*rows, (None, "no id", "src1")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.source for r in got} == {i: s or "" for i, _, s in rows} and len(got) == len(rows)
    assert len({r.slot for r in got}) == len({(r.source, r.block) for r in got})


def test_named_sources_keep_their_slots(spark, small):
    docs = queries.documents(spark, small)
    assert sorted(queries.op5_mixing(spark, small).collect()) == sorted(mixing.mixed(docs, queries.WEIGHTS).collect())
