"""Nested records to nodes and edges.

A graph is two DataFrames: nodes (node_id, class, pos, attrs map<string,string>) and
edges (src, dst, label, pos, closed). pos is (record, emission) as one string-free
struct, so that "first" always means the same. Every node class is one projection of
the records, exploded along its path; nothing is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import node_id
from ..plans.template import Place, Template


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _attrs(kind: T.StructType, value: Column, template: Template, model: str) -> Column:
    """The filled fields that aren't nested nodes, as strings; components as JSON without their nodes."""
    m = template.model(model)
    parts = []
    for f in m.fields:
        target = template.model(f.type)
        if f.name not in kind.fieldNames() or (target and target.entity):
            continue
        v = value[f.name]
        text = F.to_json(v) if f.is_list or target else v.cast("string")
        parts.append(F.struct(F.lit(f.name).alias("key"), text.alias("value")))
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull())) if parts else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _id(template: Template, place: Place, value: Column, kind: T.StructType) -> tuple[Column, Column]:
    """Whether any identity field is filled, and the id that holds then. A class without identity is identified by all its scalars. Rows are filtered by the former, as a filter on ids would make ids twice."""
    m = template.model(place.model)
    names = list(place.identity) or [f.name for f in m.fields if template.model(f.type) is None and not f.is_list]
    some = [F.trim(value[n].cast("string")) != "" for n in names]
    filled = F.lit(False)
    for s in some:
        filled = filled | F.coalesce(s, F.lit(False))
    numbers = {n for n in names if isinstance(kind[n].dataType, T.IntegralType)}
    return value.isNotNull() & filled, node_id(place.model, {n: value[n] for n in names}, numbers)


def build(df: DataFrame, template: Template, order: str, references: bool = True) -> Graph:
    """df: one row a record in the template's shape; order: the column whose values put the records in order.

    Each place of the template scans df anew with its own columns alone, so df is to be a table, not a costly plan.
    """
    places = {p.path: p for p in template.places(references)}
    base = df.select(F.col(order).cast("long").alias("__rec"), F.struct(*df.columns).alias("__v"))
    nodes, edges = [], []
    for number, p in enumerate(places.values()):
        at, keys = _reach(base, places, p)
        kind = at.schema["__v"].dataType
        filled, ident = _id(template, p, F.col("__v"), kind)
        pos = F.struct(F.col("__rec").alias("rec"), F.lit(number).alias("place"), F.col("__ix").alias("ix"))
        full = at.filter(filled).withColumn("__id", ident)
        nodes.append(full.select(F.col("__id").alias("node_id"), F.lit(p.model).alias("class"), pos.alias("pos"), _attrs(kind, F.col("__v"), template, p.model).alias("attrs")))
        if p.parent is not None:
            known, above = _id(template, places[p.parent], F.col("__p"), at.schema["__p"].dataType)
            edges.append(at.filter(filled & known).withColumn("__id", ident).withColumn("__src", above).select(F.col("__src").alias("src"), F.col("__id").alias("dst"), F.lit(p.label).alias("label"), pos.alias("pos"), F.lit(p.closed_catalog).alias("closed")))
    out_nodes = nodes[0]
    for n in nodes[1:]:
        out_nodes = out_nodes.unionByName(n)
    out_edges = None
    for e in edges:
        out_edges = e if out_edges is None else out_edges.unionByName(e)
    if out_edges is None:
        out_edges = base.limit(0).select(F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("").alias("label"), F.struct(F.col("__rec").alias("rec"), F.lit(0).alias("place"), F.lit("").alias("ix")).alias("pos"), F.lit(False).alias("closed"))
    keys = sorted({f.name for p in places.values() for f in template.model(p.model).fields if (m := template.model(f.type)) is None or not m.entity})
    return Graph(first_values(out_nodes, keys), last_edges(out_edges))


def _reach(base: DataFrame, places: dict[str, Place], p: Place) -> tuple[DataFrame, list[str]]:
    """Rows of the instances at a place: __v the instance, __p that of its parent, __ix its indexes on the way."""
    if p.parent is None:
        return base.withColumn("__p", F.lit(None).cast("string")).withColumn("__ix", F.lit("")), []
    df, _ = _reach(base, places, places[p.parent])
    df = df.select("__rec", "__ix", F.col("__v").alias("__p"), "__v")
    way = p.path[len(p.parent) :].lstrip(".") if p.parent else p.path
    for step in way.split("."):
        name, many = step.removesuffix("[]"), step.endswith("[]")
        if many:
            df = df.select("__rec", "__ix", "__p", F.posexplode(F.col("__v")[name]).alias("__n", "__v")).withColumn("__ix", F.concat("__ix", F.lit("/"), F.lpad(F.col("__n").cast("string"), 9, "0"))).drop("__n")
        else:
            df = df.withColumn("__v", F.col("__v")[name])
    return df.filter(F.col("__v").isNotNull()), []


def first_values(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a node: of each attribute the first value that isn't empty, in the order of pos.

    With the keys known, as from a template, one aggregation by node with an aggregate for each key; else the attributes are taken apart and grouped by node and key.
    """
    one = [F.min_by("class", "pos").alias("class"), F.min("pos").alias("pos")]
    if keys is not None:
        full = lambda k: ~F.coalesce(F.col("attrs")[k], F.lit("")).isin("", "[]", "{}")
        firsts = [F.min_by(F.col("attrs")[k], F.when(full(k), F.col("pos"))).alias(f"__{i}") for i, k in enumerate(keys)]
        entries = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"__{i}").alias("value")) for i, k in enumerate(keys)))
        entries = entries if keys else F.array().cast("array<struct<key:string,value:string>>")
        return nodes.groupBy("node_id").agg(*one, *firsts).select("node_id", "class", "pos", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("attrs"))
    long = nodes.select("node_id", "pos", F.explode("attrs").alias("key", "value")).filter("value <> '' and value <> '[]' and value <> '{}'")
    values = long.groupBy("node_id", "key").agg(F.min_by("value", "pos").alias("value"))
    attrs = values.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    return nodes.groupBy("node_id").agg(*one).join(attrs, "node_id", "left").select("node_id", "class", "pos", "attrs")


def last_edges(edges: DataFrame) -> DataFrame:
    """A simple graph: of several edges of one pair the last one's label stands."""
    return edges.groupBy("src", "dst").agg(F.max_by("label", "pos").alias("label"), F.min("pos").alias("pos"), F.max_by("closed", "pos").alias("closed")).select("src", "dst", "label", "pos", "closed")


def with_reverse(g: Graph, labels: dict[str, str]) -> Graph:
    """Adds an edge back for each label that has one, where that pair has no edge yet."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.lit(None)
    back = g.edges.withColumn("label", F.element_at(table, F.col("label"))).filter("label is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "pos", "closed") if labels else g.edges.limit(0)
    return Graph(g.nodes, g.edges.unionByName(back.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")))
