"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every partition sends each owner of a range of fingerprints its own, sorted and
Golomb-coded; the owner answers with a bitmap of those that occur more than once;
only documents with such a fingerprint are shuffled, and equal bytes decide.

A fingerprint has about 10 bits more than the number of documents needs, so about one
document in a thousand is a suspect by chance; the comparison of bytes clears it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb
from ._stage import BROADCAST_BYTES, fresh, importable, split, staged

SPARE_BITS = 10
#: Fingerprints that one owner is to receive at most, about.
OWNED = 1_000_000


def fingerprint(bits: int, text: str = "text") -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(text)), 64 - bits)


def text_hash() -> Column:
    """By which suspects are brought together for the comparison of their bytes."""
    return F.xxhash64("text")


def suspects(docs: DataFrame, spare_bits: int = SPARE_BITS) -> tuple[DataFrame, int, int]:
    """The fingerprints (column fp) that more than one row of docs may have, their bits, and their number. Null texts have none."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.count()
    owners_log = max(0, math.ceil(math.log2(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows / OWNED))))
    bits = min(63, max(owners_log + 1, math.ceil(math.log2(max(rows, 2))) + spare_bits))
    width = np.uint64(bits - owners_log)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column(0).to_numpy() for b in batches]
        if not own or not sum(map(len, own)):
            return
        values, counts = np.unique(np.concatenate(own).astype(np.uint64), return_counts=True)
        owner = (values >> width).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        at = [0, *cuts.tolist(), len(values)]
        low = np.uint64((1 << int(width)) - 1)
        pieces = [(a, b) for a, b in zip(at, at[1:])]
        src = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([src] * len(pieces), pa.int32()),
                pa.array([int(owner[a]) for a, _ in pieces], pa.int64()),
                pa.array([golomb.encode(values[a:b] & low) for a, b in pieces], pa.binary()),
                pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in pieces], pa.binary()),
            ],
            ["src", "owner", "sent", "twice"],
        )

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb.decode(x) for x in pdf["sent"]]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(x)].astype(bool) for t, x in zip(pdf["twice"], lists)]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        many = np.union1d(values[counts > 1], np.concatenate([x[t] for x, t in zip(lists, twice)]))
        maps = [np.packbits(np.isin(x, many, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame({"src": pdf["src"], "owner": pdf["owner"], "duplicate": maps})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for owner, sent, bitmap in zip(b["owner"].to_pylist(), b["sent"].to_pylist(), b["duplicate"].to_pylist()):
                values = golomb.decode(sent)
                flags = np.unpackbits(np.frombuffer(bitmap, np.uint8))[: len(values)].astype(bool)
                found.append(values[flags] | (np.uint64(owner) << width))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], ["fp"])

    # written, so that the answers always meet the lists that were sent
    messages = staged(docs.filter(F.col("text").isNotNull()).select(fingerprint(bits).alias("fp")).mapInArrow(send, "src int, owner long, sent binary, twice binary"))
    answers = messages.groupBy("owner").applyInPandas(reply, "src int, owner long, duplicate binary")
    found = staged(messages.join(answers, ["src", "owner"]).mapInArrow(receive, "fp long").distinct())
    return found, bits, found.count()


def duplicates(docs: DataFrame, spare_bits: int = SPARE_BITS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, keep_id) for each document whose text another of a lower id has, byte for byte; keep_id is the lowest id of its copies.

    Rows with a null doc_id or text are in no pair. The empty text is a text like any other. Repeated rows of one doc_id are one document and no pair.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    found, bits, number = suspects(own, spare_bits)
    h = "hash"
    rows = split(own, fingerprint(bits), found, number, limit)[0].withColumn(h, text_hash())
    # equal bytes meet here, one text for each task that has it; where all texts of a hash are one, ids find their group by the hash alone
    groups = rows.groupBy(h, "text").agg(F.min("doc_id").alias("keep_id"))
    texts = staged(groups.select(h, "keep_id")).groupBy(h).agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"))
    pairs = rows.select("doc_id", h).join(texts.filter("texts = 1").select(h, "keep_id"), h).select("doc_id", "keep_id")
    several = staged(texts.filter("texts > 1").select(h))
    if not several.isEmpty():
        both = rows.join(several, h, "left_semi")
        pairs = pairs.unionByName(both.join(both.groupBy(h, "text").agg(F.min("doc_id").alias("keep_id")), [h, "text"]).select("doc_id", "keep_id"))
    return pairs.filter("doc_id > keep_id").distinct()


def without_duplicates(docs: DataFrame, spare_bits: int = SPARE_BITS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one row for each distinct text: that of the lowest doc_id, null ids last, and of those of one id the least by its other columns. Rows without text all stay. The columns stay as they are."""
    found, bits, number = suspects(docs, spare_bits)
    h, row = fresh(docs, "__h"), fresh(docs, "__row")
    rows, rest = split(docs.filter(F.col("text").isNotNull()), fingerprint(bits), found, number, limit)
    clean = docs.filter(F.col("text").isNull())
    others = [c for c in docs.columns if c != "text"]
    value = F.struct(*(F.col(f"`{c}`") for c in others))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.to_json(value))
    one = rows.withColumn(h, text_hash()).groupBy(h, "text").agg(F.min_by(value, order).alias(row))
    one = one.select(*(F.col("text") if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
    return rest.unionByName(one).unionByName(clean)
