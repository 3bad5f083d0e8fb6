"""Graphs that grow: streams of nodes and edges folded into tables, late events under watermarks, and duplicates dropped by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.build import Graph
from ..operators.merge import fold_edges, fold_nodes

#: Rows that a worker hands on at once.
_SLICE = 10_000


def windowed(events: DataFrame, ts: str, keys: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """(begins, keys..., events) of tumbling or sliding windows; events later than the watermark don't count."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("begins"), *keys, "events")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *keys, "events")


def first_seen(rows: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def merge_into(spark: SparkSession, batch: Graph, path: str, version: int) -> Graph:
    """The graph at path/v<version - 1>, if there is one, folded with a batch, written to path/v<version> and read again. The stored graph comes first, so its values stand. A version that is already there is left alone: a repeated batch changes nothing."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = lambda p: (at := fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    new = f"{path}/v{version}"
    if not there(f"{new}/edges/_SUCCESS"):
        nodes = batch.nodes.withColumn("input", F.lit(version)).select("input", "node_id", "class", F.struct(F.lit(version).alias("input"), "pos").alias("pos"), "attrs")
        edges = batch.edges.withColumn("input", F.lit(version)).select("input", "src", "dst", "label", F.struct(F.lit(version).alias("input"), "pos").alias("pos"))
        if version > 0:
            old = spark.read.parquet(f"{path}/v{version - 1}/nodes"), spark.read.parquet(f"{path}/v{version - 1}/edges")
            nodes = nodes.unionByName(old[0].select(F.lit(-1).alias("input"), "node_id", "class", "pos", "attrs"))
            edges = edges.unionByName(old[1].select(F.lit(-1).alias("input"), "src", "dst", "label", "pos"))
        folded, _ = fold_nodes(nodes)
        joined, _ = fold_edges(edges)
        folded.select("node_id", "class", "pos.pos", "attrs").write.mode("overwrite").parquet(f"{new}/nodes")
        joined.select("src", "dst", "label", "pos.pos", "also_labels").write.mode("overwrite").parquet(f"{new}/edges")
    return Graph(spark.read.parquet(f"{new}/nodes"), spark.read.parquet(f"{new}/edges"))


def follow(records: DataFrame, to_graph, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A streaming query that turns each batch of records into a graph by to_graph(DataFrame) and folds it into the versions at path."""

    def each(batch: DataFrame, number: int) -> None:
        g = to_graph(batch)
        pos = lambda df: df.withColumn("pos", F.col("pos.rec"))
        merge_into(batch.sparkSession, Graph(pos(g.nodes), pos(g.edges)), path, number)

    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_parents(events: DataFrame, key: str, ts: str, is_parent: str, late: str, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, event_id, parent): for each event of a key, in the order of ts and event_id within what a batch of the stream brings, the last event up to it that is a parent; the state holds one id a key. A key that has no event until the watermark has gone on by idle_ms forgets its parent. events: (key, event_id, ts, and the boolean column is_parent)."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # a key's rows of one batch come in several frames, in no order among them; three columns of one key are held
        rows = pd.concat([pdf[[ts, "event_id", is_parent]] for pdf in frames]).sort_values([ts, "event_id"], ignore_index=True)
        for i in range(0, len(rows), _SLICE):
            part = rows.iloc[i : i + _SLICE]
            out = []
            for e, p in zip(part["event_id"], part[is_parent]):
                last = int(e) if p else last
                out.append(last)
            yield pd.DataFrame({key: k[0], "event_id": part["event_id"].to_numpy(), "parent": pd.array(out, dtype="Int64")})
        state.update((last,))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark, 0) + idle_ms)

    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, parent long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
