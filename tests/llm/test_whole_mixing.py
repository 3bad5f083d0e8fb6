"""The mixing stage keeps every document, whatever the sizes of the sources."""

from __future__ import annotations

import pytest

import corpus_pipeline

PLAIN = [(i, "x" * 2000, f"s{i % 5}") for i in range(200)]
CASES = {
    "one document": [*PLAIN, (1000, "tiny", "small")],
    "empty and null": [*PLAIN, (1000, "", None), (1001, None, None)],
    "hot": [*PLAIN, *((2000 + i, "y" * 2000, "hot") for i in range(600)), (None, "no id", "hot")],
}


@pytest.mark.parametrize("name", CASES)
def test_no_source_ends_the_schedule_of_others(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.mix(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_order_is_in_proportion(spark):
    rows = CASES["hot"][:-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.source for r in corpus_pipeline.mix(spark, docs, "").collect()]
    weights = {s: float(2000 * sum(x == s for _, _, x in rows)) ** corpus_pipeline.EXPONENT for s in set(got)}
    # a document is about two blocks of 1,024 bytes
    for n in (100, 200, 400):
        for s, w in weights.items():
            assert abs(got[:n].count(s) - n * w / sum(weights.values())) <= 4
