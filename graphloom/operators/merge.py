"""Merging graphs of many inputs: ordered folds, conflict records, collision splits.

Inputs are unions of nodes (input, node_id, class, pos, attrs) and edges (input, src,
dst, label, pos). The place of a row is (input, pos); the first input wins. A fold is
one aggregation by key, whatever the number of inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import equivalence_key, merge_sentences
from .build import Graph
from .clean import META, content

COMBINE = ("description", "summary")
MAX_COMBINED = 4096


@dataclass(frozen=True)
class Policy:
    """How graphs are merged.

    precedence: which row of a node comes first: input-order, or richest, the one with the most filled attributes, of equal ones that which more chunks support (attribute __weight__), then that of the first input.
    conflicts: keep-first; keep-all also keeps what is dropped under __conflicts__; variants makes nodes of it.
    combine: attributes whose sentences are joined, up to limit characters.
    """

    precedence: str = "input-order"
    conflicts: str = "keep-first"
    combine: tuple[str, ...] = COMBINE
    limit: int = MAX_COMBINED

    def __post_init__(self) -> None:
        if self.precedence not in ("input-order", "richest"):
            raise ValueError(f"precedence {self.precedence}")
        if self.conflicts not in ("keep-first", "keep-all", "variants"):
            raise ValueError(f"conflicts {self.conflicts}")


def rank(precedence: str) -> Column:
    """Where a row of nodes (input, pos, attrs) stands among those of its node."""
    if precedence == "input-order":
        return F.struct("input", "pos")
    weight = F.coalesce(F.col("attrs")["__weight__"].cast("long"), F.lit(0))
    return F.struct((-F.size(content())).alias("poor"), (-weight).alias("light"), "input", "pos")


def tagged(graphs: list[Graph]) -> Graph:
    """The union of graphs in their order, each row with its input's number."""
    nodes = edges = None
    for i, g in enumerate(graphs):
        n = g.nodes.select(F.lit(i).alias("input"), "node_id", "class", "pos", "attrs")
        e = g.edges.select(F.lit(i).alias("input"), "src", "dst", "label", "pos", *(["attrs"] if "attrs" in g.edges.columns else []))
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    return Graph(nodes, edges)


def unique_inputs(inputs: DataFrame) -> DataFrame:
    """Of inputs (input, document_id, path) the first of each document, or of each path where the document isn't known."""
    w = Window.partitionBy(F.coalesce("document_id", F.concat(F.lit("path:"), "path"))).orderBy("input")
    return inputs.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def long_values(nodes: DataFrame, precedence: str = "input-order") -> DataFrame:
    """(node_id, place, key, value) of the content attributes that aren't empty."""
    return nodes.select("node_id", rank(precedence).alias("place"), F.explode(content()).alias("key", "value"))


def fold_values(values: DataFrame, combine: tuple[str, ...] = COMBINE, limit: int = MAX_COMBINED, by: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(by..., key, value, conflicts): the first value; later ones that aren't equivalent are conflicts in their order, but for combined keys, whose new sentences are appended, and JSON lists, whose new items are."""
    # a value that repeats counts where it stands first; what is listed is a node's different values of a key, not its rows
    different = values.groupBy(*by, "key", "value").agg(F.min("place").alias("place"))
    rows = different.groupBy(*by, "key").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("rows"))
    first = F.col("rows")[0]["value"]
    rest = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: r["value"])
    texts = F.transform("rows", lambda r: r["value"])
    is_list = F.forall(texts, lambda v: v.rlike(r"(?s)^\[.*\]$"))
    union = F.to_json(F.array_distinct(F.flatten(F.transform(texts, lambda v: F.from_json(v, "array<string>")))))
    combined = F.aggregate(rest, first, lambda acc, v: merge_sentences(acc, v, limit))
    unlike = F.array_distinct(F.filter(rest, lambda v: equivalence_key(v) != equivalence_key(first)))
    kind = F.when(F.col("key").isin(*combine), "combine").when(is_list, "list").otherwise("first") if combine else F.when(is_list, "list").otherwise("first")
    none = F.array().cast("array<string>")
    return rows.select(*by, "key", F.when(kind == "combine", combined).when(kind == "list", union).otherwise(first).alias("value"), F.when(kind == "first", unlike).otherwise(none).alias("conflicts"))


def fold_nodes(nodes: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Folded nodes (node_id, class, pos, attrs), and conflicts (node_id, key, kept, dropped)."""
    place = rank(policy.precedence)
    one = nodes.groupBy("node_id").agg(F.min_by("class", place).alias("class"), F.min_by(F.struct("input", "pos"), place).alias("pos"))
    v = fold_values(long_values(nodes, policy.precedence), policy.combine, policy.limit)
    attrs = v.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"), F.array_sort(F.collect_list(F.when(F.size("conflicts") > 0, F.struct("key", "conflicts")))).alias("c"))
    if policy.conflicts == "keep-all":
        attrs = attrs.withColumn("attrs", F.when(F.size("c") > 0, F.map_concat("attrs", F.create_map(F.lit("__conflicts__"), F.to_json(F.map_from_entries("c"))))).otherwise(F.col("attrs")))
    conflicts = v.filter(F.size("conflicts") > 0).select("node_id", "key", F.col("value").alias("kept"), F.explode("conflicts").alias("dropped"))
    return one.join(attrs.drop("c"), "node_id", "left"), conflicts


def fold_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One edge a pair with the first label; the others in also_labels, in order. Second: label conflicts (src, dst, kept, dropped).

    Edges with attributes (attrs) keep, of each, the first value among those of the label that stays; JSON lists are united; other values go without notice, as they identify nothing.
    """
    different = edges.groupBy("src", "dst", "label").agg(F.min(F.struct("input", "pos")).alias("place"))
    e = different.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("rows"))
    labels = F.transform("rows", lambda r: r["label"])
    out = e.select("src", "dst", labels[0].alias("label"), F.col("rows")[0]["place"].alias("pos"), F.array_except(labels, F.array(labels[0])).alias("also_labels"))
    conflicts = out.filter(F.size("also_labels") > 0).select("src", "dst", F.col("label").alias("kept"), F.explode("also_labels").alias("dropped"))
    if "attrs" in edges.columns:
        by = ("src", "dst", "label")
        long = edges.select(*by, F.struct("input", "pos").alias("place"), F.explode("attrs").alias("key", "value")).filter("value <> '' and value <> '[]' and value <> '{}'")
        attrs = fold_values(long, (), by=by).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
        out = out.join(attrs, list(by), "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    return out, conflicts


def fold(g: Graph, policy: Policy = Policy()) -> tuple[Graph, DataFrame, DataFrame]:
    nodes, conflicts = fold_nodes(g.nodes, policy)
    edges, labels = fold_edges(g.edges)
    return Graph(nodes, edges), conflicts, labels


def conflict_variants(nodes: DataFrame, conflicts: DataFrame) -> Graph:
    """Dropped values as nodes of <Class>Variant, one for each node and value, with edges HAS_CONFLICT_VARIANT."""
    c = conflicts.join(nodes.select("node_id", "class", "pos"), "node_id")
    vid = F.concat("node_id", F.lit("__var_"), F.substring(F.sha2(F.concat_ws("\x1f", "key", "dropped"), 256), 1, 8))
    v = c.withColumn("vid", vid)
    return Graph(v.select(F.col("vid").alias("node_id"), F.concat("class", F.lit("Variant")).alias("class"), "pos", F.create_map("key", "dropped").alias("attrs")), v.select(F.col("node_id").alias("src"), F.col("vid").alias("dst"), F.lit("HAS_CONFLICT_VARIANT").alias("label"), "pos"))


def schema_conflicts(inputs: DataFrame) -> DataFrame:
    """One row with the number of distinct template hashes where there are several."""
    return inputs.agg(F.count_distinct("schema_hash").alias("schemas")).filter("schemas > 1")


def rekey(g: Graph, ids: DataFrame) -> Graph:
    """Nodes and edges with new ids by a map (node_id, new_id); ids without a row stay. What comes together is folded later."""
    a, b = ids.select(F.col("node_id").alias("src"), F.col("new_id").alias("s")), ids.select(F.col("node_id").alias("dst"), F.col("new_id").alias("d"))
    nodes = g.nodes.join(ids, "node_id", "left").withColumn("node_id", F.coalesce("new_id", "node_id")).select(*g.nodes.columns)
    edges = g.edges.join(a, "src", "left").join(b, "dst", "left").withColumn("src", F.coalesce("s", "src")).withColumn("dst", F.coalesce("d", "dst")).select(*g.edges.columns)
    return Graph(nodes, edges)


def root_scopes(g: Graph) -> DataFrame:
    """(input, node_id, root): the nodes without inward edge from which each is reached, itself included, input by input."""
    from .stats import written

    n = g.nodes.select("input", "node_id").distinct()
    roots = n.join(g.edges.filter("src <> dst").select("input", F.col("dst").alias("node_id")), ["input", "node_id"], "left_anti")
    seen = written(roots.select("input", "node_id", F.col("node_id").alias("root")))
    step = g.edges.select("input", F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct()
    front = seen
    while True:
        front = written(front.join(step, ["input", "node_id"]).select("input", F.col("next").alias("node_id"), "root").distinct().join(seen, ["input", "node_id", "root"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def collisions(g: Graph) -> DataFrame:
    """(input, node_id, class, owner, conflicting): ids that an earlier input has too though they share no root, and whether their values conflict."""
    n = g.nodes.select("input", "node_id", "class").distinct()
    owner = n.groupBy("node_id").agg(F.min("input").alias("owner"))
    later = n.join(owner, "node_id").filter("input > owner")
    scope = root_scopes(g).groupBy("input", "node_id").agg(F.collect_set("root").alias("roots"))
    pair = later.join(scope, ["input", "node_id"], "left").join(scope.select(F.col("input").alias("owner"), "node_id", F.col("roots").alias("own_roots")), ["owner", "node_id"], "left")
    apart = pair.filter(~F.coalesce(F.arrays_overlap("roots", "own_roots"), F.lit(False))).select("input", "node_id", "class", "owner")
    v = g.nodes.select("input", "node_id", F.explode(content()).alias("key", "value"))
    mine, theirs = v.select("input", "node_id", "key", "value"), v.select(F.col("input").alias("owner"), "node_id", "key", F.col("value").alias("first"))
    unlike = apart.join(mine, ["input", "node_id"]).join(theirs, ["owner", "node_id", "key"]).filter(equivalence_key("value") != equivalence_key("first")).select("input", "node_id").distinct().withColumn("conflicting", F.lit(True))
    return apart.join(unlike, ["input", "node_id"], "left").withColumn("conflicting", F.coalesce("conflicting", F.lit(False)))


def split_collisions(g: Graph, documents: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """One conflicting collision condemns all of its owner and class: later nodes get ids <id>__doc_<document> or __src_<input>. documents: (input, document_id). Second: the splits."""
    c = collisions(g)
    bad = c.groupBy("owner", "class").agg(F.bool_or("conflicting").alias("any")).filter("any")
    split = c.join(bad, ["owner", "class"]).select("input", "node_id", "class", "owner")
    stamp = F.concat(F.lit("__src_"), F.col("input").cast("string"))
    if documents is not None:
        split = split.join(documents.select("input", "document_id"), "input", "left")
        stamp = F.coalesce(F.concat(F.lit("__doc_"), F.substring("document_id", 1, 8)), stamp)
    ids = split.select("input", "node_id", F.concat("node_id", stamp).alias("new_id"))
    nodes = g.nodes.join(ids, ["input", "node_id"], "left").withColumn("node_id", F.coalesce("new_id", "node_id")).select(*g.nodes.columns)
    a = ids.select("input", F.col("node_id").alias("src"), F.col("new_id").alias("s"))
    b = ids.select("input", F.col("node_id").alias("dst"), F.col("new_id").alias("d"))
    edges = g.edges.join(a, ["input", "src"], "left").join(b, ["input", "dst"], "left").withColumn("src", F.coalesce("s", "src")).withColumn("dst", F.coalesce("d", "dst")).select(*g.edges.columns)
    return Graph(nodes, edges), split.select("input", "node_id", "class", "owner")


def skolemize_roots(g: Graph, documents: DataFrame, identities: dict[str, list[str]]) -> Graph:
    """Roots of different documents with one id that is merely a file's stem become nodes of their own: documents (input, document_id, stem)."""
    from ..functions.text import fold_id

    roots = g.nodes.join(g.edges.select("input", F.col("dst").alias("node_id")), ["input", "node_id"], "left_anti")
    fields = sorted({f for fs in identities.values() for f in fs})
    same = F.lit(False)
    for f in fields:
        same = same | F.coalesce(fold_id(F.col("attrs")[f]) == fold_id("stem"), F.lit(False))
    r = roots.join(documents.select("input", "document_id", "stem"), "input").withColumn("stemmed", same)
    first = r.groupBy("node_id").agg(F.min_by("document_id", "input").alias("first"), F.bool_or("stemmed").alias("any"))
    ids = r.join(first, "node_id").filter("any and document_id <> first").select("input", "node_id", F.concat("node_id", F.lit("__doc_"), F.substring("document_id", 1, 8)).alias("new_id"))
    nodes = g.nodes.join(ids, ["input", "node_id"], "left").withColumn("node_id", F.coalesce("new_id", "node_id")).select(*g.nodes.columns)
    edges = g.edges.join(ids.select("input", F.col("node_id").alias("src"), F.col("new_id").alias("s")), ["input", "src"], "left").withColumn("src", F.coalesce("s", "src")).select(*g.edges.columns)
    return Graph(nodes, edges)


def merge_graphs(graphs: list[Graph], documents: DataFrame | None = None, split: bool = True, policy: Policy = Policy(), identities: dict[str, list[str]] | None = None, aliases: DataFrame | None = None) -> tuple[Graph, dict[str, DataFrame]]:
    """The merged graph and its audit: conflicts, label_conflicts, splits, and with aliases their outcomes. Deterministic, idempotent, in the order of the inputs.

    documents: (input, document_id), with which split nodes are named; with a column stem and identities, by class, roots that only a file's name identifies are kept apart. aliases: confirmed pairs (a, b) of nodes that the merged graph proposes by containment; identities are needed for that too.
    """
    from . import alias

    g = tagged(graphs)
    audit: dict[str, DataFrame] = {}
    if documents is not None and identities and "stem" in documents.columns:
        g = skolemize_roots(g, documents, identities)
    if split:
        g, audit["splits"] = split_collisions(g, documents)
    out, audit["conflicts"], audit["label_conflicts"] = fold(g, policy)
    if aliases is not None and identities:
        out, audit["aliases"] = alias.applied(out, alias.propose(out, identities), aliases)
    if policy.conflicts == "variants":
        v = conflict_variants(out.nodes, audit["conflicts"])
        out = Graph(out.nodes.unionByName(v.nodes, allowMissingColumns=True), out.edges.unionByName(v.edges, allowMissingColumns=True))
    return out, audit


def richness() -> Column:
    return F.size(content())


def deep_merge(a: dict, b: dict, identities: dict[str, list[str]] | None = None, describe: tuple[str, ...] = COMBINE, fallback: float | None = None) -> dict:
    """b into a copy of a: empties skipped, dicts merged, entity lists merged by id, identity or content, other lists appended, descriptions by sentences, other scalars overwritten."""
    import re

    out = dict(a)
    for k, v in b.items():
        if v is None or (isinstance(v, (str, list, dict)) and not v):
            continue
        old = out.get(k)
        if old is None or (isinstance(old, (str, list, dict)) and not old):
            out[k] = v
        elif isinstance(old, dict) and isinstance(v, dict):
            out[k] = deep_merge(old, v, identities, describe, fallback)
        elif isinstance(old, list) and isinstance(v, list):
            if any(isinstance(x, dict) for x in (*old, *v)):
                out[k] = _merge_items(old, v, (identities or {}).get(k, []), identities, describe, fallback)
            else:
                out[k] = old + [x for i, x in enumerate(v) if x not in old and x not in v[:i]]
        elif k in describe and isinstance(old, str) and isinstance(v, str):
            if v.strip() not in old:
                new = [s for s in re.split(r"(?<=[.!?])\s+", v.strip()) if s and s not in old]
                out[k] = _whole_sentences(" ".join([old.strip(), *new]))
        else:
            out[k] = v
    return out


def _whole_sentences(text: str, limit: int = MAX_COMBINED) -> str:
    """text within the limit, cut where a sentence ends if one ends there at all."""
    if len(text) <= limit:
        return text
    end = max(text.rfind(x, 0, limit) for x in ".!?")
    return text[: end + 1] if end > 0 else text[:limit]


def _merge_items(old: list, new: list, fields: list[str], identities, describe, fallback: float | None) -> list:
    import json

    def key(x):
        if not isinstance(x, dict):
            return ("value", json.dumps(x, sort_keys=True, default=str))
        if x.get("id") not in (None, ""):
            return ("id", str(x["id"]))
        ids = [str(x.get(f)).strip().lower() for f in fields if x.get(f) not in (None, "")]
        return ("fields", *ids) if ids else ("content", json.dumps(x, sort_keys=True, default=str))

    def items(x):
        return {f"{k}:{json.dumps(v, sort_keys=True, default=str)}" for k, v in x.items()} if isinstance(x, dict) else set()

    out = list(old)
    at = {key(x): i for i, x in reversed(list(enumerate(out)))}
    for x in new:
        i = at.get(key(x))
        if i is None and fallback is not None and isinstance(x, dict):
            score = [(len(items(x) & items(y)) / max(1, len(items(x) | items(y))), -j) for j, y in enumerate(out) if isinstance(y, dict)]
            if score and max(score)[0] >= fallback:
                i = -max(score)[1]
        if i is None:
            at[key(x)] = len(out)
            out.append(x)
        elif isinstance(x, dict) and isinstance(out[i], dict):
            out[i] = deep_merge(out[i], x, identities, describe, fallback)
    return out


def consolidate(records: DataFrame, key: str, order: str, value: str, identities: dict[str, list[str]] | None = None, fallback: float | None = None) -> DataFrame:
    """(key, value): the JSON objects of each key deep-merged in order, a group in a worker at a time."""
    import json

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for text in pdf.sort_values(order)[value]:
            if text:
                out = deep_merge(out, json.loads(text), identities, fallback=fallback)
        return pd.DataFrame({key: [pdf[key].iloc[0]], value: [json.dumps(out, ensure_ascii=False, sort_keys=True)]})

    return records.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {dict(records.dtypes)[key]}, {value} string")


__all__ = ["META", "merge_graphs"]
