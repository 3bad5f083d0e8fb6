"""Sharding by Karmarkar-Karp differencing.

Groups that must stay together go to k shards of nearly equal bytes. Differencing keeps
partial partitions (k sums each) in a heap, takes the two of the largest spread and adds
them in opposite order. A group starts as a partial partition of its own. The groups are
hashed to cells; a cell combines its groups to one partial partition, in parallel; these
are combined by the same rule, level upon level, the last one on the driver, which has
at most `fan` of them whatever the number of groups.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import importable, sized, staged

SHARDS, FAN = 32, 1024


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-way differencing of partial partitions, one a row: the final sums, largest first, and to which of them each sum of each row went.

    Of equal spreads that of the lower row comes first; a combined one counts as a new, higher row.
    """
    m, k = vectors.shape
    order = np.argsort(-vectors, axis=1, kind="stable")
    sums = [vectors[i][order[i]] for i in range(m)]
    parts: list[tuple] = [()] * m  # of a combined one: the two it came from and where their places went
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        by = np.argsort(-total, kind="stable")
        place = np.empty(k, np.int64)
        place[by] = np.arange(k)
        parts.append((a, b, place, place[::-1]))
        sums.append(total[by])
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    to = [None] * len(sums)
    to[-1] = np.arange(k)
    for i in range(len(sums) - 1, m - 1, -1):
        a, b, pa, pb = parts[i]
        to[a], to[b] = to[i][pa], to[i][pb]
    places = np.empty((m, k), np.int64)
    for i in range(m):
        places[i, order[i]] = to[i]
    return sums[-1], places


def assign(groups: DataFrame, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """(g, shard) for groups (g, size): g a long that isn't null, distinct; size in bytes, null as 0."""
    spark = groups.sparkSession
    importable(spark)
    # written, so that every level sees the same groups
    base = staged(groups.select("g", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    n = base.count()
    cells = max(1, math.ceil(n / fan))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "g"], ascending=[False, True])
        v = np.zeros((len(pdf), shards), np.int64)
        v[:, 0] = pdf["size"]
        sums, places = difference(v)
        return pd.DataFrame({"cell": pdf["cell"], "g": pdf["g"], "place": places[:, 0], "sums": [sums if i == 0 else None for i in range(len(pdf))]})

    cell = F.pmod(F.xxhash64("g"), F.lit(cells))
    level = staged(base.withColumn("cell", cell).groupBy("cell").applyInPandas(first, "cell long, g long, place long, sums array<long>"))
    placed = level.select("g", F.col("cell").alias("c"), "place")
    tops = level.filter("sums is not null").select("cell", "sums")
    count = cells

    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        sums, places = difference(np.stack(pdf["sums"].to_list()))
        return pd.DataFrame({"up": pdf["up"], "cell": pdf["cell"], "places": list(places), "sums": [sums if i == 0 else None for i in range(len(pdf))]})

    while count > fan:
        count = math.ceil(count / fan)
        up = staged(tops.withColumn("up", F.pmod(F.xxhash64("cell"), F.lit(count))).groupBy("up").applyInPandas(above, "up long, cell long, places array<long>, sums array<long>"))
        placed = placed.join(up.select(F.col("cell").alias("c"), "up", "places"), "c").select("g", F.col("up").alias("c"), F.expr("places[int(place)]").alias("place"))
        tops = up.filter("sums is not null").select(F.col("up").alias("cell"), "sums")
    last = sorted(tops.collect(), key=lambda r: r.cell)
    if last:
        _, places = difference(np.array([r.sums for r in last], np.int64))
        rows = [(r.cell, p.tolist()) for r, p in zip(last, places)]
    else:
        rows = []
    final = spark.createDataFrame(rows, "c long, places array<int>")
    return placed.join(F.broadcast(final), "c").select("g", F.expr("places[int(place)]").alias("shard"))  # fan rows at most


def sharded(docs: DataFrame, group: Column | None = None, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """(doc_id, shard) for each distinct doc_id: documents of equal group go to one shard, 0 to shards - 1, and shards have nearly equal bytes of text.

    group: any expression over docs; if None, the text itself, so that exact copies stay together. Documents of a null group are groups of their own. A doc_id that rows repeat counts once, with the least group and the longest text; rows without doc_id are left out; a null text has no bytes.
    """
    group = F.col("text") if group is None else group
    key = F.when(group.isNull(), F.xxhash64(F.lit("null"), F.col("doc_id"))).otherwise(F.xxhash64(group))
    d = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("g"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    d = staged(d.groupBy("doc_id").agg(F.min("g").alias("g"), F.max("bytes").alias("bytes")))
    shard = assign(d.groupBy("g").agg(F.sum("bytes").alias("size")), shards, fan)
    return d.join(shard, "g").select("doc_id", "shard")
