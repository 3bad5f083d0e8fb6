"""Rejection by a model of one or two languages."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.llm import language_id


@pytest.mark.parametrize("labels", [("en",), ("en", "de"), ("en", "fr")])
def test_texts_of_other_languages_are_rejected(labels):
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"]]
    own, other = [r for r in rows if r["lang"] in labels], [r["text"] for r in rows if r["lang"] not in labels]
    model = language_id.fit([r["text"] for r in own[::2]], [r["lang"] for r in own[::2]])

    def rejected(texts):
        return (model.probabilities(pa.array(texts)).max(axis=1) < model.threshold).mean()

    assert rejected(other) > 0.9
    assert rejected([r["text"] for r in own[1::2]]) < 0.03
    assert rejected(["xq zzv kkjw qpx wvv", "日本語の文章です。"]) == 1
