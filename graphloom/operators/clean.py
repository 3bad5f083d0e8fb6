"""Filters and integrity checks of a graph, and exact dedup of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .build import Graph

#: Attributes that aren't content.
META = ("id", "label", "type", "__class__", "__provenance__", "__conflicts__", "aliases")
MAX_KEYWORDS = 5


def content(attrs="attrs"):
    return F.map_filter(attrs, lambda k, v: ~k.isin(*META) & v.isNotNull() & (F.trim(v) != "") & (v != "[]") & (v != "{}"))


def phantoms(g: Graph) -> DataFrame:
    """Ids of nodes without any attribute that means something."""
    return g.nodes.filter(F.coalesce(F.size(content()), F.lit(0)) <= 0).select("node_id")


def without_nodes(g: Graph, gone: DataFrame) -> Graph:
    """Without the nodes of gone (node_id) and the edges at them."""
    return Graph(g.nodes.join(gone, "node_id", "left_anti"), g.edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti").select(*g.edges.columns))


def drop_phantoms(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph without phantoms, and the edges that went with them."""
    gone = phantoms(g)
    lost = g.edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_semi").select(*g.edges.columns).unionByName(g.edges.join(gone.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*g.edges.columns)).distinct()
    return without_nodes(g, gone), lost


def drop_self_edges(g: Graph) -> Graph:
    return Graph(g.nodes, g.edges.filter("src <> dst"))


def dangling(g: Graph) -> DataFrame:
    """Edges of which an end is no node, with the ends that are absent."""
    ids = g.nodes.select("node_id").distinct()
    a = g.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_anti").select("src", "dst", "label", F.lit("source").alias("missing"))
    b = g.edges.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst", "label", F.lit("target").alias("missing"))
    return a.unionByName(b)


def drop_orphans(g: Graph) -> Graph:
    ids = g.nodes.select("node_id")
    return Graph(g.nodes, g.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*g.edges.columns))


def drop_duplicate_edges(g: Graph) -> Graph:
    """Of edges with the same ends and label the first by pos."""
    e = g.edges.groupBy("src", "dst", "label").agg(F.min_by(F.struct(*g.edges.columns), "pos").alias("e"))
    return Graph(g.nodes, e.select("e.*"))


def cap_keywords(edges: DataFrame, column: str = "keywords", limit: int = MAX_KEYWORDS) -> DataFrame:
    return edges.withColumn(column, F.slice(column, 1, limit))


def node_hash():
    c = content()
    pairs = F.array_sort(F.map_entries(c))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\x1f")
    unknown = F.exists(F.map_values("attrs"), lambda v: v == "Unknown")
    return F.sha2(F.concat(F.col("class"), F.lit("\x1e"), F.coalesce(text, F.lit("")), F.when(F.coalesce(unknown, F.lit(False)), F.col("node_id")).otherwise("")), 256)


def duplicate_nodes(g: Graph) -> DataFrame:
    """(node_id, survivor) of nodes whose class and content an earlier node has. A value Unknown makes a node unlike any other."""
    h = g.nodes.withColumn("h", node_hash())
    first = h.groupBy("h").agg(F.min_by("node_id", F.struct("pos", "node_id")).alias("survivor"), F.count("*").alias("n")).filter("n > 1")
    return h.join(first, "h").filter("node_id <> survivor").select("node_id", "survivor")


def redirect(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at node_id become edges at survivor; those that would become loops go, of several on a pair the last stands."""
    a = ids.select(F.col("node_id").alias("src"), F.col("survivor").alias("s"))
    b = ids.select(F.col("node_id").alias("dst"), F.col("survivor").alias("d"))
    out = edges.join(a, "src", "left").join(b, "dst", "left").withColumn("was", F.col("src") == F.col("dst"))
    out = out.withColumn("src", F.coalesce("s", "src")).withColumn("dst", F.coalesce("d", "dst")).filter("was or src <> dst")
    return out.groupBy("src", "dst").agg(F.max_by(F.struct(*edges.columns), "pos").alias("e")).select("src", "dst", *(F.col(f"e.{c}").alias(c) for c in edges.columns if c not in ("src", "dst"))).select(*edges.columns)


def dedup_nodes(g: Graph) -> Graph:
    dup = duplicate_nodes(g)
    return Graph(g.nodes.join(dup.select("node_id"), "node_id", "left_anti"), redirect(g.edges, dup))


def clean(g: Graph) -> Graph:
    """Phantoms, content duplicates, self edges, orphans, duplicate edges, in this order."""
    g, _ = drop_phantoms(g)
    return drop_duplicate_edges(drop_orphans(drop_self_edges(dedup_nodes(g))))


def violations(g: Graph) -> DataFrame:
    """(severity, kind, what) of a graph's structure: absent ends, nodes without attributes, no node, no edge."""
    spark = g.nodes.sparkSession
    ends = dangling(g).select(F.lit("error").alias("severity"), F.concat(F.lit("missing "), "missing").alias("kind"), F.concat_ws(" ", "src", "label", "dst").alias("what"))
    empty = phantoms(g).select(F.lit("error").alias("severity"), F.lit("empty node").alias("kind"), F.col("node_id").alias("what"))
    one = spark.range(1)
    none = one.join(g.nodes.agg(F.count("*").alias("n")), F.col("n") == 0).select(F.lit("error").alias("severity"), F.lit("no nodes").alias("kind"), F.lit("").alias("what"))
    bare = one.join(g.edges.agg(F.count("*").alias("n")), F.col("n") == 0).select(F.lit("warning").alias("severity"), F.lit("no edges").alias("kind"), F.lit("").alias("what"))
    return ends.unionByName(empty).unionByName(none).unionByName(bare)


def validate(g: Graph) -> None:
    """Raises on the first errors found."""
    bad = violations(g).filter("severity = 'error'").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.kind}: {r.what}" for r in bad))


def empty_identities(g: Graph, identities: dict[str, list[str]]) -> DataFrame:
    """Nodes whose declared identity fields are all blank."""
    cond = F.lit(False)
    for cls, fields in identities.items():
        if fields:
            blank = F.lit(True)
            for f in fields:
                blank = blank & (F.coalesce(F.trim(F.col("attrs")[f]), F.lit("")) == "")
            cond = cond | ((F.col("class") == cls) & blank)
    return g.nodes.filter(cond).select("node_id", "class")


def closed_catalogs(g: Graph) -> tuple[Graph, DataFrame]:
    """Without edges to targets that only closed references reach, unless that is the whole class; targets left without any edge go. Second: the edges dropped."""
    into = g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.bool_and("closed").alias("only"))
    n = g.nodes.select("node_id", "class").join(into, "node_id", "left").withColumn("only", F.coalesce("only", F.lit(False)))
    per = n.groupBy("class").agg(F.bool_and("only").alias("all"))
    bad = n.join(per, "class").filter("only and not all").select("node_id")
    dropped = g.edges.join(bad.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*g.edges.columns)
    edges = g.edges.join(bad.select(F.col("node_id").alias("dst")), "dst", "left_anti").select(*g.edges.columns)
    alone = bad.join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    return Graph(g.nodes.join(alone, "node_id", "left_anti"), edges), dropped


def cardinality_bounds(g: Graph, bounds: dict[str, int], roots: list[str], weight: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """Keeps of each bounded class the nodes with the most filled attributes, then the most support (node_id, weight), then edges from other classes than roots, then the least id. Second: (node_id, class, reason) of those that went."""
    n = g.nodes.filter(F.col("class").isin(*bounds)) if bounds else g.nodes.limit(0)
    inner = g.edges.join(g.nodes.filter(~F.col("class").isin(*roots) if roots else F.lit(True)).select(F.col("node_id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("inn"))
    n = n.join(inner, "node_id", "left")
    n = n.join(weight, "node_id", "left") if weight is not None else n.withColumn("weight", F.lit(0))
    table = F.create_map(*(F.lit(x) for kv in bounds.items() for x in kv)) if bounds else F.lit(None)
    order = Window.partitionBy("class").orderBy(F.desc(F.size(content())), F.coalesce("weight", F.lit(0)).desc(), F.coalesce("inn", F.lit(0)).desc(), "node_id")
    gone = n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") > F.element_at(table, F.col("class"))).select("node_id", "class", F.lit("cardinality_bound").alias("reason")) if bounds else n.select("node_id", "class", F.lit("").alias("reason"))
    return without_nodes(g, gone.select("node_id")), gone


def prune_barren(g: Graph, order: list[str]) -> Graph:
    """Bottom-up by class: nodes without edges to others and without attributes beside their identity's go."""
    for cls in order:
        parents = g.edges.select(F.col("src").alias("node_id")).distinct()
        gone = g.nodes.filter((F.col("class") == cls) & (F.size(content()) <= 1)).join(parents, "node_id", "left_anti").select("node_id")
        g = without_nodes(g, gone)
    return g


def clear_mislabeled(value, field: str, cls: str):
    """Null for an identity named like a number that holds several words without digit, or that echoes the class."""
    from ..functions.text import is_class_echo

    numbered = F.lit(field.lower()).rlike("(number|no|num|ref|code|id)$")
    words = (~value.rlike("[0-9]")) & (F.size(F.split(F.trim(value), r"\s+")) >= 2)
    return F.when((numbered & words) | is_class_echo(value, cls), None).otherwise(value)
