"""A corpus pipeline of five operators of graphloom.llm: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from graphloom.llm._stage import placed, staged

#: Target weights are the sources' bytes to this power: large sources lose share to small ones.
EXPONENT = 0.9
#: Small blocks, so that even a small source has many.
BLOCK_BYTES = 1 << 10
#: Words that an encoding worker remembers, few because workers stay while other stages run.
WORDS = 150_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    return language_id.accepted(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join connects."""
    return ngram_join.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a schedule by target weights."""
    return mixing.scheduled(docs, mixing.target_weights(docs, EXPONENT), BLOCK_BYTES)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in the order in which the mixing wrote the documents, with their places in it."""
    ordered = placed(docs.select("doc_id", "text"), "place").orderBy("place")
    return byte_bpe.encoded(ordered, cache=WORDS, place="place")


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix), ("byte_bpe", encode)]

#: SQL can express neither the trained model nor BPE; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage kept is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
