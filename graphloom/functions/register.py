"""The functions by name for SQL text: scalar ones over Arrow batches, one that aggregates, one that gives tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> list[str]:
    """Registers, and names, graph_similarity(a, b), graph_weighted_mean(value, weight) and graph_windows(text, size). Call it once a session; again it replaces them."""
    from .text import fuzzy_similarity

    @F.pandas_udf("double")
    def weighted_mean(v: pd.Series, w: pd.Series) -> float:
        both = v.notna() & w.notna()
        total = w[both].sum()
        return float((v[both] * w[both]).sum() / total) if total else None

    @F.udtf(returnType="number int, start int, part string")
    class Windows:
        def eval(self, text: str, size: int):
            for number, start in enumerate(range(0, len(text or ""), size)):
                yield number, start, text[start : start + size]

    spark.udf.register("graph_similarity", fuzzy_similarity)
    spark.udf.register("graph_weighted_mean", weighted_mean)
    spark.udtf.register("graph_windows", Windows)
    return ["graph_similarity", "graph_weighted_mean", "graph_windows"]
