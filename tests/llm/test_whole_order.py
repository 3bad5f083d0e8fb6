"""The order that the mixing stage gives the documents holds through the files that it writes."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from graphloom.llm._stage import _part, placed, staged


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.choice([3, 30, 300]), f"s{min(i % 7, 2)}") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_encoded_documents_come_in_the_order_of_the_mixing(spark, docs):
    mixed = corpus_pipeline.mix(spark, docs, "")
    want = [r.doc_id for r in mixed.collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, small as they are
    try:
        written = staged(corpus_pipeline.mix(spark, docs, ""))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(written.inputFiles()) > 1 and want != sorted(want)
    coded = corpus_pipeline.encode(spark, written, "")
    assert [(r.doc_id, r.place) for r in coded.collect()] == [(i, k) for k, i in enumerate(want)]
    again = staged(coded)
    assert [r.doc_id for r in again.orderBy("place").collect()] == want
    # other weights, another order of the result
    other = corpus_pipeline.encode(spark, staged(docs.orderBy("doc_id")), "")
    assert [r.doc_id for r in other.collect()] == sorted(want)


def test_places_are_those_of_the_rows_as_written(spark):
    """Files of which the last is the largest, which readers take first."""
    d = staged(spark.range(1000, numPartitions=3).selectExpr("id", "repeat(uuid(), cast(id as int) div 100) AS text"))
    assert [r.id for r in placed(d, "n").orderBy("n").collect()] == list(range(1000)) == sorted(r.n for r in placed(d, "n").collect())
    assert [r.id for r in placed(d.filter("id % 7 = 3"), "n").orderBy("n").collect()] == list(range(3, 1000, 7))
    own = spark.range(1000, numPartitions=3)
    assert [r.id for r in placed(own, "n").orderBy("n").collect()] == list(range(1000))
    assert placed(spark.range(0), "n").collect() == [] == placed(staged(spark.range(0)), "n").collect()


def test_files_are_sorted_by_their_numbers():
    names = [f"file:/a/part-{k:05d}-x-c000.parquet" for k in (0, 7, 99999, 100000, 100001)]
    assert sorted(reversed(names), key=_part) == names
