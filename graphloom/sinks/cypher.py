"""Cypher scripts as text lines: constraints, nodes, relationships, each made by a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.build import Graph


def escaped(c: Column | str) -> Column:
    """Backslashes, quotes and line ends escaped."""
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def literal(c: Column | str) -> Column:
    """The text of a value as a literal: numbers and booleans bare, finite ones only, lists of scalars of one kind as lists, all else quoted."""
    c = F.col(c) if isinstance(c, str) else c
    quoted = F.concat(F.lit("'"), escaped(c), F.lit("'"))
    return F.when(c.rlike(r"^-?(0|[1-9]\d{0,17})(\.\d+)?([eE][-+]?\d+)?$|^(true|false)$"), c).when(c.rlike(r'^\[(\s*-?\d+(\.\d+)?\s*(,\s*-?\d+(\.\d+)?\s*)*)\]$|^\["(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*\]$'), c).otherwise(quoted)


def identifier(c: Column | str) -> Column:
    """Word characters only, no digit first, 'node' for nothing."""
    c = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^a-zA-Z0-9_]", "_")
    return F.when(c == "", "node").when(c.rlike("^[0-9]"), F.concat(F.lit("n_"), c)).otherwise(c)


def name(c: Column | str) -> Column:
    """The name itself if it is plain, else in backticks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), c).otherwise(F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`")))


def constraint_lines(nodes: DataFrame) -> DataFrame:
    """(class, line): a uniqueness constraint for each class; equal names are numbered."""
    c = nodes.select("class").distinct().withColumn("base", F.lower(identifier("class")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("class"))
    c = c.withColumn("n", n).withColumn("called", F.when(F.col("n") > 1, F.concat("base", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("base")))
    return c.select("class", F.concat(F.lit("CREATE CONSTRAINT "), "called", F.lit("_id IF NOT EXISTS FOR (n:"), name("class"), F.lit(") REQUIRE n.id IS UNIQUE;")).alias("line"))


def node_lines(nodes: DataFrame, style: str = "merge") -> DataFrame:
    """(node_id, line): MERGE with SET, or CREATE; null and blank attributes are left out."""
    some = F.array_sort(F.filter(F.map_entries("attrs"), lambda e: e["value"].isNotNull()))
    key = F.concat(F.lit("{id: '"), escaped("node_id"))
    if style == "merge":
        sets = F.array_join(F.transform(some, lambda e: F.concat(F.lit("n."), name(e["key"]), F.lit(" = "), literal(e["value"]))), ", ")
        line = F.concat(F.lit("MERGE (n:"), name("class"), F.lit(" "), key, F.lit("'})"), F.when(sets != "", F.concat(F.lit(" SET "), sets)).otherwise(""), F.lit(";"))
    else:
        props = F.array_join(F.transform(some, lambda e: F.concat(F.lit(", "), name(e["key"]), F.lit(": "), literal(e["value"]))), "")
        line = F.concat(F.lit("CREATE (n:"), name("class"), F.lit(" "), key, F.lit("'"), props, F.lit("});"))
    return nodes.select("node_id", line.alias("line"))


def edge_lines(nodes: DataFrame, edges: DataFrame, style: str = "merge") -> DataFrame:
    """(src, dst, line); edges without both ends have none."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("class").alias("ca"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("class").alias("cb"))
    kind = F.upper(identifier(F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.lit("RELATED_TO"))))
    end = lambda v, c, k: F.concat(F.lit(f"({v}:"), name(c), F.lit(" {id: '"), escaped(k), F.lit("'})"))
    line = F.concat(F.lit("MATCH "), end("a", "ca", "src"), F.lit(", "), end("b", "cb", "dst"), F.lit(f" {style.upper()} (a)-[:"), name(kind), F.lit("]->(b);"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", line.alias("line"))


def script(g: Graph, style: str = "merge") -> DataFrame:
    """(section, line) of all three sections; sorted by section it is a script."""
    return constraint_lines(g.nodes).select(F.lit(1).alias("section"), "line").unionByName(node_lines(g.nodes, style).select(F.lit(2).alias("section"), "line")).unionByName(edge_lines(g.nodes, g.edges, style).select(F.lit(3).alias("section"), "line"))


def write(g: Graph, path: str, style: str = "merge") -> None:
    """Text files that sort in the order of the sections; refuses a graph without nodes."""
    if g.nodes.isEmpty():
        raise ValueError("the graph is empty")
    script(g, style).repartitionByRange("section").sortWithinPartitions("section", "line").select("line").write.mode("overwrite").text(path)
