"""Writers: graphs as JSON, CSV and Parquet, chunks and ledgers. Large graphs are written by all tasks; the one-file JSON is for those that fit a driver, behind a check of size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import Graph

ONE_FILE_ROWS = 1_000_000


def _full(g: Graph) -> None:
    if g.nodes.isEmpty():
        raise ValueError("the graph is empty")


def node_objects(g: Graph) -> DataFrame:
    """(json): nodes as objects with their attributes beside id, class and label."""
    base = F.create_map(F.lit("id"), "node_id", F.lit("label"), "class", F.lit("__class__"), "class")
    own = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("id", "label", "__class__"))
    return g.nodes.select("node_id", F.to_json(F.map_concat(base, own)).alias("json"))


def edge_objects(g: Graph) -> DataFrame:
    extra = [c for c in g.edges.columns if c not in ("src", "dst", "label", "pos", "closed")]
    return g.edges.select("src", "dst", F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label", *extra)).alias("json"))


def graph_dict(g: Graph, meta: dict | None = None, limit: int = ONE_FILE_ROWS) -> dict:
    n, e = g.nodes.count(), g.edges.count()
    if n + e > limit:
        raise ValueError(f"{n + e} rows are too many for one file; use write_json_lines or write_parquet")
    nodes = [json.loads(r.json) for r in node_objects(g).orderBy("node_id").collect()]
    edges = [json.loads(r.json) for r in edge_objects(g).orderBy("src", "dst").collect()]
    return {"nodes": nodes, "edges": edges, "metadata": {"node_count": n, "edge_count": e}, "graph": meta or {}}


def write_json(g: Graph, path: str, meta: dict | None = None) -> None:
    _full(g)
    text = json.dumps(graph_dict(g, meta), ensure_ascii=False, indent=2)
    spark = g.nodes.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_json_lines(g: Graph, path: str) -> None:
    _full(g)
    node_objects(g).select("json").write.mode("overwrite").text(f"{path}/nodes")
    edge_objects(g).select("json").write.mode("overwrite").text(f"{path}/edges")


def write_parquet(g: Graph, path: str) -> None:
    _full(g)
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def wide_nodes(g: Graph) -> DataFrame:
    """A column for each attribute that any node has; the names, of which there are as many as a template has fields, come to the driver."""
    keys = sorted(r.k for r in g.nodes.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect())
    return g.nodes.select(F.col("node_id").alias("id"), F.col("class").alias("label"), *(F.col("attrs")[k].alias(k) for k in keys if k not in ("id", "label")))


def wide_edges(g: Graph) -> DataFrame:
    return g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "label")


def write_csv(g: Graph, path: str) -> None:
    _full(g)
    for name, df in (("nodes", wide_nodes(g)), ("edges", wide_edges(g))):
        df.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True, quoteAll=True, escape="\\")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_ledgers(ledger: DataFrame, path: str, key: str = "document_id") -> DataFrame:
    """A folder of JSON for each document, and the manifest (document, entries), which is written beside them."""
    ledger.repartition(key).write.mode("overwrite").partitionBy(key).json(f"{path}/ledger")
    manifest = ledger.groupBy(key).agg(F.count("*").alias("entries"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_documents(docs: DataFrame, path: str, key: str, per_page: bool = False) -> None:
    """Texts of documents (key, text), or with per_page of pages (key, page_no, text), as JSON by document."""
    docs.select(key, *(["page_no"] if per_page else []), "text").write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at the path, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
