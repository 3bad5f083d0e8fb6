"""Runs from a configuration: records or texts to a clean graph with its exports, and merges of graphs."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean, dense, extract, merge, stats
from .operators.build import Graph, build, with_reverse
from .plans.template import Template
from .sinks import cypher, files, report

EXPORTS = ("parquet", "json", "csv", "cypher", "report")


@dataclass(frozen=True)
class Config:
    """Options of a run. mode: records (nested rows), one_to_one (a record a page), many_to_one (a record a document)."""

    template: Template
    output: str | None = None
    mode: str = "records"
    contract: str = "auto"
    exports: tuple[str, ...] = ("parquet",)
    reverse_labels: dict[str, str] = field(default_factory=dict)
    references: bool = True
    output_tokens: int = 4096
    context_tokens: int | None = None
    chunk_tokens: int = 512
    gleaning: int = 0
    sparse_check: bool = True
    validate: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("records", "one_to_one", "many_to_one"):
            raise ValueError(f"mode {self.mode}")
        if self.contract not in ("auto", "direct", "dense"):
            raise ValueError(f"contract {self.contract}")
        if unknown := set(self.exports) - set(EXPORTS):
            raise ValueError(f"exports {sorted(unknown)}")

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class Result:
    graph: Graph
    audit: dict[str, DataFrame]
    metadata: dict[str, Any]


def extracted(docs: DataFrame, key: str, config: Config, factory: extract.ClientFactory) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Records by the configured mode, written, the ledger of where their instances come from, and the chunks if there are any. Of many_to_one each document goes whole (direct), or in two phases over its chunks (dense), as the contract says for its length."""
    t = config.template
    options = {"sparse_check": config.sparse_check, "gleaning": config.gleaning}
    fields = lambda r: r.filter("record is not null").select(key, "record.*")
    # written, so that a client is asked once for each text
    if config.mode == "one_to_one":
        records = stats.written(extract.per_page(docs, key, t, factory, **options))
        return records, dense.record_ledger(fields(records), key, t), None
    c = F.lit(config.contract) if config.contract != "auto" else extract.contract(F.length("text"), config.output_tokens, config.context_tokens)
    d = docs.withColumn("__c", c)
    whole = stats.written(extract.direct(d.filter("__c = 'direct'"), key, t, factory, **options))
    long = d.filter("__c = 'dense'").drop("__c")
    ledger = dense.record_ledger(fields(whole), key, t)
    if config.contract == "direct" or long.isEmpty():
        return whole, ledger, None
    found = dense.dense(long, key, t, factory, config.chunk_tokens, max(dense.BATCH_TOKENS, config.chunk_tokens))
    return stats.written(whole.unionByName(found.records)), ledger.unionByName(found.ledger), found.chunks


def to_graph(records: DataFrame, config: Config, order: str) -> tuple[Graph, dict[str, DataFrame]]:
    """Build, reverse edges, cleaning, closed catalogs, cardinality bounds, in this order; and what each took away."""
    t = config.template
    g = build(records, t, order, config.references)
    g = Graph(stats.written(g.nodes), stats.written(g.edges))  # what follows reads it many times
    if config.reverse_labels:
        g = with_reverse(g, config.reverse_labels)
    audit: dict[str, DataFrame] = {}
    g, audit["dropped_relationships"] = clean.drop_phantoms(g)
    g = clean.drop_orphans(clean.drop_self_edges(clean.dedup_nodes(g)))
    g, audit["closed_catalog"] = clean.closed_catalogs(g)
    g, audit["demoted"] = clean.cardinality_bounds(g, t.bounds(), [t.root])
    audit["empty_identities"] = clean.empty_identities(g, t.identities())
    return g, audit


def run(spark: SparkSession, config: Config, data: DataFrame, key: str, factory: extract.ClientFactory | None = None) -> Result:
    """data: nested records, or texts (key, text) that a client reads. key orders the records."""
    began, trace = time.time(), report.Trace()
    ledger = chunks = None
    trace.emit("started", "extract", mode=config.mode)
    if config.mode == "records":
        records = data
    else:
        if factory is None:
            raise ValueError("texts need a client")
        records, ledger, chunks = extracted(data, key, config, factory)
        records = records.filter("record is not null").select(key, "record.*")
    trace.emit("started", "graph")
    g, audit = to_graph(records, config, key)
    g = Graph(stats.written(g.nodes), stats.written(g.edges))
    if config.validate:
        clean.validate(g)
    if ledger is not None:
        audit["ledger"] = stats.written(ledger)
        audit["provenance"] = dense.node_sources(g.nodes, audit["ledger"], config.template)
    s = stats.summary(g).first()
    trace.emit("done", "graph", nodes=s.nodes, edges=s.edges)
    meta = {"schema_hash": config.template.schema_hash(), "nodes": s.nodes, "edges": s.edges, "average_degree": s.average_degree, "processing_time_seconds": time.time() - began}
    if config.output:
        export(g, config, meta, audit)
        for name, df in (("ledger", audit.get("ledger")), ("provenance", audit.get("provenance")), ("chunks", chunks)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{config.output}/{name}")
        trace.emit("done", "export", exports=list(config.exports))
    meta["trace"] = trace.to_json()
    return Result(g, audit, meta)


def export(g: Graph, config: Config, meta: dict[str, Any], audit: dict[str, DataFrame]) -> None:
    out = config.output
    if "parquet" in config.exports:
        files.write_parquet(g, f"{out}/graph")
    if "json" in config.exports:
        files.write_json(g, f"{out}/graph.json", meta)
    if "csv" in config.exports:
        files.write_csv(g, f"{out}/csv")
    if "cypher" in config.exports:
        cypher.write(g, f"{out}/cypher")
    spark = g.nodes.sparkSession
    if "report" in config.exports:
        text = report.markdown(g, dropped=audit.get("dropped_relationships"))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/metadata")


def merge_runs(spark: SparkSession, paths: list[str], output: str | None = None, strict: bool = True, **options) -> tuple[Graph, dict[str, DataFrame]]:
    """Graphs of earlier runs merged in the order given; one that is named twice counts once. Different templates are refused, or let through if not strict."""
    from .sources.files import graph_json, graph_parquet

    paths = list(dict.fromkeys(paths))
    graphs = [graph_json(spark, p) if p.endswith(".json") else graph_parquet(spark, f"{p}/graph") for p in paths]
    hashes = set()
    for p in paths:
        if not p.endswith(".json") and files.exists(spark, f"{p}/metadata"):
            hashes.add(json.loads(spark.read.text(f"{p}/metadata").first().value)["schema_hash"])
    if strict and len(hashes) > 1:
        raise ValueError(f"{len(hashes)} different templates")
    shape = lambda g: Graph(g.nodes.select("node_id", "class", F.col("pos.rec").alias("pos"), "attrs"), g.edges.select("src", "dst", "label", F.col("pos.rec").alias("pos")))
    g, audit = merge.merge_graphs([shape(g) for g in graphs], **options)
    if output:
        g = Graph(stats.written(g.nodes), stats.written(g.edges))
        files.write_parquet(g, f"{output}/graph")
    return g, audit


def stem(path: str) -> str:
    return Path(path).stem or hashlib.md5(path.encode()).hexdigest()[:8]
