"""Readers: texts, pages, documents, exported graphs and ledgers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import Graph

_ITEM = "map<string,string>"


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, pages array<struct<page_no, text>>, problem) of serialised documents in JSON; those that can't be read have a problem and no pages."""
    t = texts(spark, path)
    kind = "struct<schema_name:string,version:string,name:string,pages:array<struct<page_no:int,text:string>>,main_text:string,_corrupt_record:string>"
    d = t.withColumn("d", F.from_json("text", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    pages = F.coalesce("d.pages", F.when(F.col("d.main_text").isNotNull(), F.array(F.struct(F.lit(1).alias("page_no"), F.col("d.main_text").alias("text")))))
    problem = F.when(F.col("d").isNull() | F.col("d._corrupt_record").isNotNull(), "not JSON").when(F.col("d.schema_name").isNull() & F.col("d.main_text").isNull(), "no document")
    return d.select("path", F.col("d.name").alias("name"), F.when(problem.isNull(), pages).alias("pages"), problem.alias("problem"))


def page_texts(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, page_no, text)."""
    return docs.select(key, F.inline("pages"))


def full_text(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): the pages' texts in order, a line apart."""
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, plain) of tagged XML texts, control characters removed."""
    from ..functions.text import strip_markup, without_control

    t = texts(spark, path).withColumn("text", without_control("text"))
    return t.filter(F.contains("text", F.lit("<doclang"))).withColumn("plain", strip_markup("text"))


def resolve(spark: SparkSession, path: str) -> str:
    """The graph's JSON file of a file or a run's directory; CSV and Cypher lose types and are refused."""
    if path.endswith((".csv", ".cypher")):
        raise ValueError(f"{path}: an export in CSV or Cypher can't be read back without loss; give the JSON")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in ([path] if path.endswith(".json") else [f"{path}/graph/graph.json", f"{path}/graph.json", path]):
        at = hadoop(p)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at) and (p.endswith(".json") or fs.getFileStatus(at).isFile()):
            return p
    raise FileNotFoundError(path)


def graph_json(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A graph from one JSON export {nodes: [...], edges: [...]}: attributes as strings, nested ones as JSON."""
    raw = spark.read.text(resolve(spark, path), wholetext=True).select(F.from_json("value", f"struct<nodes:array<{_ITEM}>,edges:array<{_ITEM}>>").alias("g"))
    if check:
        bad = raw.filter("g is null or g.nodes is null or g.edges is null or size(g.nodes) = 0").limit(1).collect()
        if bad:
            raise ValueError(f"{path}: not a graph with nodes and edges")
    n = raw.select(F.posexplode("g.nodes").alias("pos", "n"))
    gone = ("id", "node_id", "__class__", "label", "type")
    attrs = F.map_filter("n", lambda k, v: ~k.isin(*gone) & v.isNotNull())
    place = lambda k: F.struct(F.col("pos").cast("long").alias("rec"), F.lit(k).alias("place"), F.lit("").alias("ix")).alias("pos")
    nodes = n.select(F.coalesce(F.col("n")["id"], F.col("n")["node_id"]).alias("node_id"), F.coalesce(F.col("n")["__class__"], F.col("n")["label"], F.lit("Unknown")).alias("class"), place(0), attrs.alias("attrs"))
    e = raw.select(F.posexplode("g.edges").alias("pos", "e"))
    edges = e.select(F.col("e")["source"].alias("src"), F.col("e")["target"].alias("dst"), F.col("e")["label"].alias("label"), place(1), F.lit(False).alias("closed"))
    g = Graph(nodes, edges)
    if check:
        from ..operators.clean import dangling

        wrong = nodes.filter("node_id is null or node_id rlike '^[\\\\[{]'").limit(1).collect() or dangling(g).limit(1).collect()
        if wrong:
            raise ValueError(f"{path}: {wrong[0]}")
    return g


def graph_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def graph_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a CSV export, all columns strings."""
    read = lambda name: spark.read.csv(f"{path}/{name}.csv", header=True, multiLine=True, escape="\\")
    nodes, edges = read("nodes"), read("edges")
    for name, df, need in (("nodes", nodes, ["id"]), ("edges", edges, ["source", "target"])):
        if absent := set(need) - set(df.columns):
            raise ValueError(f"{name}: no column {', '.join(sorted(absent))}")
    return nodes, edges


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(document_id, source) beside a graph; None if it is absent or can't be read."""
    from pyspark.errors import AnalysisException

    at = path.rsplit("/", 1)[0] + "/provenance.json"
    try:
        d = spark.read.schema("document_id string, source string").json(at, multiLine=True, mode="PERMISSIVE")
        return d if d.filter("document_id is not null").limit(1).collect() else None
    except AnalysisException:
        return None
