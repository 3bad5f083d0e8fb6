"""Registered queries of single functions and of graphs that go out and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, hashing, text
from .operators import alias, build, clean, evaluate, merge, provenance, stats
from .operators.build import Graph
from .queries import _BROKEN, _TRADE, broken, geography, order_tree, query, shown, table, trade
from .sinks import files as sinks
from .sources import files as sources


@query("""
SELECT c_custkey, trim(v) <> '' AS meaningful, v = '' AS empty, trim(v) <> '' AS usable, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') = 'building' AS echo, CASE WHEN trim(v) <> '' AND lower(v) <> 'building' THEN v ELSE 'c' || c_custkey END AS root
FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN c_mktsegment WHEN c_acctbal > 2000 THEN ' ' ELSE '' END AS v FROM customer)""")
def value_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    c = c.withColumn("v", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).when(F.col("c_acctbal") > 2000, " ").otherwise(""))
    stem = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", text.is_meaningful("v").alias("meaningful"), text.is_empty("v").alias("empty"), text.is_usable_id("v").alias("usable"), text.is_class_echo("v", "Building").alias("echo"), coerce.root_identity("v", "Building", stem).alias("root"))


@query("""
SELECT o_orderkey, o_totalprice AS european, o_totalprice AS english, CASE o_orderstatus WHEN 'F' THEN 'EUR' WHEN 'O' THEN 'USD' ELSE 'SEK' END AS currency,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' ELSE 'OTHER' END AS state, [o_orderstatus, o_orderpriority] AS items, lower(replace(o_orderpriority, ' ', '_')) AS snake
FROM orders""")
def read_values(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in two ways and read again, currencies, members of an enumeration, lists."""
    o = table(spark, d, "orders")
    english = F.format_number("o_totalprice", 2)
    european = F.translate(english, ",.", ".,")
    sign = F.expr("CASE o_orderstatus WHEN 'F' THEN ' € ' WHEN 'O' THEN 'Dollars' ELSE 'sek' END")
    priority = F.regexp_replace("o_orderpriority", "-", " ")
    return o.select(
        "o_orderkey",
        text.parse_number(european).alias("european"),
        text.parse_number(F.concat(F.lit("$ "), english)).alias("english"),
        text.currency_code(sign).alias("currency"),
        text.enum_member("o_orderstatus", ["OPEN", "DONE"], {"f": "DONE", "o": "OPEN"}).alias("state"),
        text.string_list(F.concat_ws(" , ", "o_orderstatus", F.lit(""), "o_orderpriority")).alias("items"),
        F.regexp_replace(text.snake_case(priority), "^(.)_", "$1-").alias("snake"),
    )


@query("""
WITH p AS (SELECT *, regexp_extract_all(lower(p_name), '[a-z]+') AS a, regexp_extract_all(lower(p_type), '[a-z]+') AS b FROM part)
SELECT p_partkey, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / CAST(len(list_distinct(a || b)) AS DOUBLE) END AS jaccard,
  replace(replace(p_brand, '#', '_'), ' ', '_') AS file, p_name AS clean FROM p""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)
    raw = F.concat(F.lit("\x01"), "p_name", F.lit("\x0b"))
    return p.select("p_partkey", text.jaccard(words("p_name"), words("p_type")).alias("jaccard"), text.file_name(F.concat(F.lit(" ."), F.translate("p_brand", "# ", "?:"))).alias("file"), text.without_control(raw).alias("clean"))


@query("""
WITH s AS (SELECT p_partkey, sha256('Part|name=' || upper(replace(p_name, ' ', '_')) || '|p_brand=' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g')) AS h, upper(replace(p_name, ' ', '_')) AS n, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part)
SELECT p_partkey, 'Part_' || substr(h, 1, 16) AS node_id, 'parts[]|name=' || n || ',p_brand=' || b AS key, n || ' ' || b AS canonical FROM s""")
def identities(spark: SparkSession, d: str) -> DataFrame:
    fields = {"name": F.col("p_name"), "p_brand": F.col("p_brand")}
    return table(spark, d, "part").select("p_partkey", hashing.node_id("Part", fields).alias("node_id"), hashing.identity_key("parts[]", fields).alias("key"), hashing.canonical_text(fields).alias("canonical"))


@query(_TRADE + "SELECT node_id, class FROM nodes")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = stats.shared(spark)
    sinks.write_parquet(trade(spark, d), at)
    return sources.graph_parquet(spark, at).nodes.select("node_id", "class")


@query("""
SELECT 'n' || n_nationkey AS node_id, 'Nation' AS class, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = f"{stats.shared(spark)}/graph.json"
    sinks.write_json(geography(spark, d), at)
    return sources.graph_json(spark, at).nodes.select("node_id", "class", F.col("attrs")["name"].alias("name"))


@query(_TRADE + "SELECT src AS source, dst AS target, label FROM edges")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = stats.shared(spark)
    sinks.write_csv(trade(spark, d), at)
    return sources.graph_csv(spark, at)[1]


@query(_TRADE + "SELECT src, dst, label FROM edges UNION ALL SELECT dst, src, 'HOLDS' FROM edges WHERE label = 'PART_OF'")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return build.with_reverse(trade(spark, d), {"PART_OF": "HOLDS"}).edges.select("src", "dst", "label")


@query(_BROKEN + "SELECT src, dst, label, pos FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE seg = 'BUILDING') OR dst IN (SELECT node_id FROM nodes WHERE seg = 'BUILDING')")
def phantom_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_phantoms(broken(spark, d))[1].select("src", "dst", "label", F.col("pos.rec").alias("pos"))


@query(_BROKEN + "SELECT count(*) FILTER (src NOT IN (SELECT node_id FROM nodes)) + count(*) FILTER (dst NOT IN (SELECT node_id FROM nodes)) AS dangling, (SELECT count(*) FROM nodes WHERE seg = 'BUILDING') AS phantoms, count(*) FILTER (src = dst) AS self_loops FROM edges")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.integrity(broken(spark, d)).select("dangling", "phantoms", "self_loops")


@query("""
SELECT 'c' || c_custkey AS node_id, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'r' || r_regionkey, 'name', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'name', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'name', s_name FROM supplier""")
def attribute_texts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.attribute_texts(trade(spark, d)).select("node_id", "key", "value")


_TWO = """
WITH a AS (SELECT 'c' || c_custkey AS node_id, c_custkey AS k, c_mktsegment AS seg FROM customer),
b AS (SELECT DISTINCT 'c' || o_custkey AS node_id, o_custkey AS k FROM orders)
"""


def _two(spark: SparkSession, d: str) -> list[Graph]:
    """Customers with their segments, and the customers of orders with their best priority, below one root each."""
    none = F.lit(0).cast("long").alias("pos")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), none, F.create_map(F.lit("segment"), "c_mktsegment").alias("attrs"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), none, F.create_map(F.lit("priority"), "p").alias("attrs"))
    root = spark.range(1).select(F.lit("all").alias("node_id"), F.lit("Root").alias("class"), none, F.create_map(F.lit("name"), F.lit("all")).alias("attrs"))
    edges = lambda n: n.select(F.lit("all").alias("src"), F.col("node_id").alias("dst"), F.lit("HAS").alias("label"), none)
    return [Graph(c.unionByName(root), edges(c)), Graph(o.unionByName(root), edges(o))]


@query(_TWO + "SELECT a.node_id, 'Customer' AS class, coalesce('priority=' || p || ';', '') || 'segment=' || seg AS attrs FROM a LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) ON o_custkey = a.k UNION ALL SELECT 'all', 'Root', 'name=all'")
def merged_graphs(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_graphs(_two(spark, d))[0].nodes.select("node_id", "class", shown().alias("attrs"))


@query(_TWO + "SELECT 0 AS input, node_id, 'all' AS root FROM a UNION ALL SELECT 1, node_id, 'all' FROM b UNION ALL SELECT 0, 'all', 'all' UNION ALL SELECT 1, 'all', 'all'")
def root_scopes(spark: SparkSession, d: str) -> DataFrame:
    return merge.root_scopes(merge.tagged(_two(spark, d)))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), f AS (SELECT c, min(k) AS first FROM o GROUP BY c)
SELECT CAST(k AS VARCHAR) AS document, CASE WHEN k = first THEN 'c' || c ELSE 'c' || c || '__doc_' || substr('d' || k, 1, 8) END AS node_id FROM o JOIN f USING (c)""")
def skolemized_roots(spark: SparkSession, d: str) -> DataFrame:
    """Every order is an input whose one root is its customer, named like its file."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    n = o.select(F.col("o_orderkey").alias("input"), name.alias("node_id"), F.lit("Customer").alias("class"), F.col("o_orderkey").alias("pos"), F.create_map(F.lit("ref"), name).alias("attrs"))
    e = n.select("input", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("X").alias("label"), "pos").filter("src <> dst")
    docs = o.select(F.col("o_orderkey").alias("input"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("document_id"), name.alias("stem"))
    return merge.skolemize_roots(Graph(n, e), docs, {"Customer": ["ref"]}).nodes.select(F.col("input").cast("string").alias("document"), "node_id")


@query("""
WITH k AS (SELECT DISTINCT p_brand AS class, lower(p_name) AS t FROM part)
SELECT class, count(*) AS names FROM k GROUP BY class""")
def exact_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ by case alone merge; a similarity of 1 lets no others."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"))
    kept = alias.fuzzy_merge(p.withColumn("text", F.when(F.col("pos") % 2 == 0, F.upper("text")).otherwise(F.col("text"))), 1.0)
    return kept.select(F.col("path").alias("class"), "survivor").distinct().groupBy("class").agg(F.count("*").alias("names"))


@query("""
WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n FROM lineitem)
SELECT 'q' || (p // 2) AS key, list(DISTINCT n ORDER BY n) AS chunk_ids FROM l GROUP BY 1""")
def rekeyed_ledger(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    ledger = l.groupBy(part.alias("key")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("chunk_ids"))
    ids = l.select(part.alias("key"), F.concat(F.lit("q"), F.expr("l_partkey div 2").cast("string")).alias("new_key")).distinct()
    return provenance.rekeyed(ledger, ids)


@query("""
WITH n AS (SELECT 'o' || o_orderkey AS node_id, o_orderkey AS k FROM orders), e AS (SELECT k FROM n WHERE k % 3 = 0), h AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS c FROM lineitem)
SELECT node_id, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN x.k IS NOT NULL THEN 'verbatim' ELSE 'unresolved' END AS kind, CASE WHEN e.k IS NOT NULL THEN [0] ELSE coalesce(x.cs, []) END AS chunk_ids
FROM n LEFT JOIN e USING (k) LEFT JOIN (SELECT k, list(c ORDER BY c)[:8] AS cs FROM h GROUP BY k) x USING (k)""")
def bound_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders bound to entries by key, where a third has one, else to the lines that name them."""
    o = table(spark, d, "orders")
    node = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id")
    key = F.concat(F.lit("orders|k="), F.col("o_orderkey").cast("string")).alias("key")
    nodes = o.select(node, F.lit("orders").alias("path"), key, F.lit(None).cast("string").alias("text"))
    entries = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("orders").alias("path"), key, F.lit(None).cast("string").alias("text"), F.array(F.lit(0)).alias("chunk_ids")).drop("o_orderkey")
    hits = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node_id"), F.col("l_linenumber").alias("chunk_id"))
    return provenance.bind(nodes, entries, hits.join(nodes, "node_id", "left_semi"))


@query("SELECT 'o' || (CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_orderkey // 10 END) AS source, count(*) AS edges FROM orders GROUP BY 1")
def streamed_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a graph folded into versions by two batches, the second of which is sent again."""
    from .streaming.incremental import merge_into

    at = stats.shared(spark)
    g = order_tree(spark, d)
    nodes = g.nodes.select("node_id", "class", F.lit(0).alias("pos"), F.create_map(F.lit("x"), F.lit("1")).alias("attrs"))
    edges = g.edges.withColumn("pos", F.lit(0)).withColumn("half", F.crc32("dst") % 2)
    for version, half in ((0, 0), (1, 1), (1, 1)):
        out = merge_into(spark, Graph(nodes, edges.filter(F.col("half") == half).drop("half")), at, version)
    return out.edges.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("edges"))
