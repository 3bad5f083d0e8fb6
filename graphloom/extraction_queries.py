"""Registered queries of extraction: texts made from the tables, read back by a client of rules."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dense as dense_
from .operators import merge, stats
from .operators.build import build
from .plans.template import Field, Model, Template
from .queries import halves, query, shown, table

ORDER = Template(
    "Order",
    (
        Model("Order", (Field("number", "str", "identity", required=True), Field("status"), Field("lines", "Line", "edge", True, label="HAS_LINE"))),
        Model("Line", (Field("item", "str", "identity", required=True), Field("flag"), Field("quantity", "int"))),
    ),
)


class Clerk:
    """Reads the texts that order_texts writes: names their lines, and fills orders and lines."""

    def __call__(self, prompt: str, schema: dict | None) -> str:
        if prompt.startswith("Name the instances"):
            nodes = [{"i": 0, "path": "", "ids": {"number": n}} for n in re.findall(r"order (\w+) ", prompt)]
            return json.dumps({"nodes": nodes + [{"i": 1 + k, "path": "lines", "ids": {"item": x}, "p": 0 if nodes else None} for k, x in enumerate(re.findall(r"item (\w+) ", prompt))]})
        text = prompt.split("\n\n", 1)[1]
        if "number" in schema["properties"]["items"]["items"]["properties"]:
            found = re.search(r"order (\w+) of status (\w+)", text)
            return json.dumps({"items": [{"number": found[1], "status": found[2]} if found else {}]})
        asked = json.loads(prompt.split("\n")[1])
        known = {m[0]: {"flag": m[1], "quantity": int(m[2])} for m in re.findall(r"item (\w+) flag (\w+) quantity (\d+)", text)}
        return json.dumps({"items": [known.get(x["item"], {}) for x in asked]})


def order_texts(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, text): every order with its lines as sentences."""
    # numbers are shuffled, not sentences
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag")

    def line(x: Column) -> Column:
        item = F.concat_ws("x", x["l_linenumber"], x["l_partkey"], x["l_suppkey"], x["quantity"], x["l_returnflag"])
        return F.concat(F.lit("There is item "), item, F.lit(" flag "), x["l_returnflag"], F.lit(" quantity "), x["quantity"].cast("string"), F.lit(" in it."))

    # so many tasks that the clients, which are slow, are busy everywhere; small partitions would be put together, and small lines broadcast to the few tasks that read orders
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    lines = table(spark, d, "lineitem").select("l_orderkey", row.alias("row")).repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list("row").alias("lines"))
    lines = lines.select("l_orderkey", F.array_sort(F.array_distinct(F.filter(F.transform("lines", line), lambda x: x.isNotNull()))).alias("lines"))
    o = table(spark, d, "orders").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat(F.lit("This is order "), F.col("o_orderkey").cast("string"), F.lit(" of status "), "o_orderstatus", F.lit("."))
    return o.select("o_orderkey", F.concat_ws(" ", head, F.array_join("lines", " ")).alias("text"))


@lru_cache(4)
def _dense(spark: SparkSession, d: str) -> dense_.Extracted:
    """Once a session, as four queries show parts of it."""
    return dense_.dense(order_texts(spark, d), "o_orderkey", ORDER, Clerk, 24, 48)


_ITEMS = """
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber || 'x' || l_partkey || 'x' || l_suppkey || 'x' || CAST(l_quantity AS INTEGER) || 'x' || l_returnflag AS item, l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""


@query(_ITEMS + "SELECT o AS o_orderkey, CAST(o AS VARCHAR) AS number, o_orderstatus AS status, item, flag, quantity FROM l JOIN orders ON o_orderkey = o")
def dense_records(spark: SparkSession, d: str) -> DataFrame:
    r = _dense(spark, d).records
    return r.select("o_orderkey", "record.number", "record.status", F.inline("record.lines"))


@query(_ITEMS + "SELECT o AS document, count(*) AS lines, 'root' AS rung FROM l GROUP BY o")
def dense_parents(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).instances.filter("path <> ''").groupBy("document", "rung").agg(F.count("*").alias("lines"))


@query(_ITEMS + "SELECT o AS document, 'lines[]|item=' || lower(item) AS instance, 'verbatim' AS kind FROM l UNION ALL SELECT o_orderkey, '|Order', 'verbatim' FROM orders")
def dense_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).ledger.select("document", "instance", "kind")


@query(_ITEMS + "SELECT 'Line' AS class, count(DISTINCT lower(item)) AS nodes, count(*) AS sources, 'verbatim' AS kind FROM l")
def dense_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the extracted graph with the documents that they are in."""
    found = _dense(spark, d)
    nodes = build(stats.written(found.records.select("o_orderkey", "record.*")), ORDER, "o_orderkey").nodes
    return dense_.node_sources(nodes.filter("class = 'Line'"), found.ledger, ORDER).groupBy("kind").agg(F.lit("Line").alias("class"), F.count_distinct("node_id").alias("nodes"), F.count("*").alias("sources"))


# -- merge policies

_ROWS = """
WITH l AS (SELECT 'p' || l_partkey AS p, l_returnflag AS flag, l_linestatus AS status, [l_orderkey % 2, l_orderkey, l_linenumber, l_suppkey, ascii(l_returnflag)] AS pos FROM lineitem),
r AS (SELECT *, [CASE WHEN status <> 'O' THEN -2 ELSE -1 END] || pos AS place FROM l)
"""


@query(_ROWS + "SELECT p AS node_id, 'flag=' || arg_min(flag, place) || coalesce(';status=' || arg_min(status, place) FILTER (status <> 'O'), '') AS attrs FROM r GROUP BY p")
def merge_richest(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a status are richer than those without, and come first."""
    return merge.fold_nodes(halves(spark, d).nodes, merge.Policy("richest"))[0].select("node_id", shown().alias("attrs"))


@query(_ROWS + """, k AS (SELECT p, arg_min(flag, pos) AS kept FROM l GROUP BY p), v AS (SELECT p, flag, min(pos) AS pos FROM l GROUP BY p, flag),
c AS (SELECT p, string_agg('"' || flag || '"', ',' ORDER BY pos) AS dropped FROM v JOIN k USING (p) WHERE flag <> kept GROUP BY p)
SELECT p AS node_id, '{"flag":[' || dropped || ']}' AS conflicts FROM c""")
def merge_keeping_all(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_nodes(halves(spark, d).nodes, merge.Policy(conflicts="keep-all"))[0].select("node_id", F.col("attrs")["__conflicts__"].alias("conflicts")).filter("conflicts is not null")


@query("""
WITH l AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_returnflag AS label, CAST(l_linenumber AS VARCHAR) AS line, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS status,
  [l_orderkey % 2, l_orderkey, l_linenumber, l_suppkey] AS pos FROM lineitem),
k AS (SELECT s, p, arg_min(label, pos || [ascii(label)]) AS label FROM l GROUP BY s, p)
SELECT s AS src, p AS dst, k.label, arg_min(line, pos) AS line, arg_min(status, pos || [ascii(status)]) FILTER (status <> '') AS status FROM l JOIN k USING (s, p) WHERE l.label = k.label GROUP BY ALL""")
def merge_edge_attributes(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    place = F.struct(F.col("l_orderkey").alias("rec"), F.lit(0).alias("place"), F.concat_ws("/", F.lpad("l_linenumber", 3, "0"), F.lpad("l_suppkey", 9, "0")).alias("ix")).alias("pos")
    attrs = F.create_map(F.lit("line"), F.col("l_linenumber").cast("string"), F.lit("status"), F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.col("l_linestatus")))
    e = l.select(F.expr("int(l_orderkey % 2)").alias("input"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("label"), place, attrs.alias("attrs"))
    return merge.fold_edges(e)[0].select("src", "dst", "label", F.col("attrs")["line"].alias("line"), F.col("attrs")["status"].alias("status"))
