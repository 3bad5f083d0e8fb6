"""The registered queries of the graph operators, each over whole tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, text
from .operators import alias, attach, chunk, clean, evaluate, merge, provenance, stats
from .operators.build import Graph, build
from .plans import induce, ontology
from .plans.template import Field, Model, Template

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- orders as nested records, and the graph built from them

ORDERS = Template(
    "Order",
    (
        Model("Order", (Field("o_orderkey", "int", "identity", required=True), Field("o_orderstatus"), Field("o_orderpriority"), Field("customer", "Customer", "edge", label="PLACED_BY"), Field("lines", "Line", "edge", True, label="HAS_LINE"))),
        Model("Customer", (Field("c_custkey", "int", "identity", required=True), Field("c_name"), Field("c_mktsegment"), Field("nation", "Nation", "edge", label="IN_NATION"))),
        Model("Nation", (Field("n_name", "str", "identity", required=True), Field("n_nationkey", "int"))),
        Model("Line", (Field("l_orderkey", "int", "identity", required=True), Field("l_linenumber", "int", "identity", required=True), Field("l_partkey", "int"), Field("l_returnflag"))),
    ),
)


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer, its nation, and their lines nested; written, because each node class scans them."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))).alias("lines"))
    n = table(spark, d, "nation").select("n_nationkey", F.struct("n_name", "n_nationkey").alias("nation"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.struct("c_custkey", "c_name", "c_mktsegment", "nation").alias("customer"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return stats.written(o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "customer", "lines"))


def shown(attrs: str = "attrs") -> Column:
    """Attributes as key=value in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _fold(x: str) -> str:
    return f"regexp_replace(lower(trim(CAST({x} AS VARCHAR))), '[^a-z0-9]', '', 'g')"


def _nid(cls: str, **fields: str) -> str:
    text = " || ".join([f"'{cls}'", *(f"'|{k}=' || {_fold(v)}" for k, v in sorted(fields.items()))])
    return f"'{cls}_' || substr(sha256({text}), 1, 16)"


_LINE = _nid("Line", l_orderkey="l_orderkey", l_linenumber="l_linenumber")
_ORDER, _CUSTOMER, _NATION = _nid("Order", o_orderkey="o_orderkey"), _nid("Customer", c_custkey="c_custkey"), _nid("Nation", n_name="n_name")


@query(f"""
WITH used AS (SELECT DISTINCT c.* FROM orders JOIN customer c ON c_custkey = o_custkey)
SELECT {_ORDER} AS node_id, 'Order' AS class, 'o_orderkey=' || o_orderkey || ';o_orderpriority=' || o_orderpriority || ';o_orderstatus=' || o_orderstatus AS attrs FROM orders
UNION ALL SELECT {_CUSTOMER}, 'Customer', 'c_custkey=' || c_custkey || ';c_mktsegment=' || c_mktsegment || ';c_name=' || c_name FROM used
UNION ALL SELECT DISTINCT {_NATION}, 'Nation', 'n_name=' || n_name || ';n_nationkey=' || n_nationkey FROM used JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT {_LINE}, 'Line', 'l_linenumber=' || l_linenumber || ';l_orderkey=' || l_orderkey || ';l_partkey=' || l_partkey || ';l_returnflag=' || l_returnflag
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE n = 1""")
def build_nodes(spark: SparkSession, d: str) -> DataFrame:
    return build(order_records(spark, d), ORDERS, "o_orderkey").nodes.select("node_id", "class", shown().alias("attrs"))


@query(f"""
SELECT {_ORDER} AS src, {_CUSTOMER} AS dst, 'PLACED_BY' AS label FROM orders JOIN customer ON c_custkey = o_custkey
UNION SELECT {_CUSTOMER}, {_NATION}, 'IN_NATION' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION SELECT {_ORDER}, {_LINE}, 'HAS_LINE' FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def build_edges(spark: SparkSession, d: str) -> DataFrame:
    return build(order_records(spark, d), ORDERS, "o_orderkey").edges.select("src", "dst", "label")


# -- a graph straight from the tables

_TRADE = """
WITH nodes AS (
  SELECT 'r' || r_regionkey AS node_id, 'Region' AS class, r_regionkey AS rec FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'Customer', c_custkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_suppkey FROM supplier),
edges AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS label FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN' FROM supplier
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'c' || o_custkey, 'SERVES' FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""


def trade(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, customers and suppliers; suppliers serve the customers of the lines that they send."""
    none = F.create_map().cast("map<string,string>")

    def nodes(name: str, cls: str, p: str, key: str, attrs: Column = none) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("node_id"), F.lit(cls).alias("class"), F.struct(F.col(key).cast("long").alias("rec"), F.lit(0).alias("place"), F.lit("").alias("ix")).alias("pos"), attrs.alias("attrs"))

    def edges(df: DataFrame, a: str, x: str, b: str, y: str, label: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(label).alias("label"), F.struct(F.col(x).cast("long").alias("rec"), F.lit(0).alias("place"), F.lit("").alias("ix")).alias("pos"), F.lit(False).alias("closed"))

    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    served = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    all_nodes = nodes("region", "Region", "r", "r_regionkey", F.create_map(F.lit("name"), "r_name")).unionByName(nodes("nation", "Nation", "n", "n_nationkey", F.create_map(F.lit("name"), "n_name")))
    all_nodes = all_nodes.unionByName(nodes("customer", "Customer", "c", "c_custkey", F.create_map(F.lit("name"), "c_name", F.lit("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("")))).unionByName(nodes("supplier", "Supplier", "s", "s_suppkey", F.create_map(F.lit("name"), "s_name")))
    all_edges = edges(n, "n", "n_nationkey", "r", "n_regionkey", "PART_OF").unionByName(edges(c, "c", "c_custkey", "n", "c_nationkey", "IN")).unionByName(edges(s, "s", "s_suppkey", "n", "s_nationkey", "IN")).unionByName(edges(served, "s", "l_suppkey", "c", "o_custkey", "SERVES"))
    return Graph(all_nodes, all_edges)


def geography(spark: SparkSession, d: str) -> Graph:
    """Regions, nations and suppliers, each below the other: all rows of the three tables, and a tree for each region."""
    g = trade(spark, d)
    return Graph(g.nodes.filter("class <> 'Customer'"), g.edges.filter("label = 'PART_OF' or label = 'IN' and src like 's%'"))


@query(_TRADE + """
SELECT n AS nodes, e AS edges, l AS self_loops, 2.0 * e / n AS average_degree, e / (n * (n - 1.0)) AS density
FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e, count(*) FILTER (src = dst) AS l FROM edges)""")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(trade(spark, d))


@query(_TRADE + "SELECT class AS type, count(*) AS n FROM nodes GROUP BY class")
def node_types(spark: SparkSession, d: str) -> DataFrame:
    return stats.node_types(trade(spark, d))


@query(_TRADE + "SELECT label AS type, count(*) AS n FROM edges GROUP BY label")
def edge_types(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_types(trade(spark, d))


_DEGREES = _TRADE + """, deg AS (
  SELECT node_id, class, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM nodes
  LEFT JOIN (SELECT dst AS node_id, count(*) AS i FROM edges GROUP BY dst) USING (node_id)
  LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM edges GROUP BY src) USING (node_id))
"""


@query(_DEGREES + "SELECT *, in_degree + out_degree AS degree, (in_degree + out_degree) / (SELECT count(*) - 1.0 FROM nodes) AS centrality FROM deg")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return stats.degrees(trade(spark, d))


@query(_DEGREES + "SELECT class, rank, node_id, degree FROM (SELECT class, node_id, in_degree + out_degree AS degree, row_number() OVER (PARTITION BY class ORDER BY in_degree + out_degree DESC, node_id) AS rank FROM deg) WHERE rank <= 5")
def top_degree(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_degree(trade(spark, d), 5)


@query(_TRADE + "SELECT class, count(*) AS nodes, min(degree) AS least, max(degree) AS most, avg(degree) AS mean FROM (SELECT node_id, class, count(e.src) AS degree FROM nodes LEFT JOIN (SELECT src, src AS k FROM edges UNION ALL SELECT src, dst FROM edges) e ON e.k = node_id GROUP BY node_id, class) GROUP BY class")
def degree_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.degrees(trade(spark, d)).groupBy("class").agg(F.count("*").alias("nodes"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.avg("degree").alias("mean"))


@query("SELECT 'p' || p_partkey AS node_id, 'Part' AS class FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Part").alias("class"))
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return stats.isolated(Graph(n, e))


@query("""
SELECT 'Region' AS class, 'name' AS attribute, count(*) AS filled, 1.0 AS share FROM region
UNION ALL SELECT 'Nation', 'name', count(*), 1.0 FROM nation
UNION ALL SELECT 'Supplier', 'name', count(*), 1.0 FROM supplier
UNION ALL SELECT 'Customer', 'name', count(*), 1.0 FROM customer
UNION ALL SELECT 'Customer', 'segment', count(*) FILTER (c_acctbal > 0), avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) FROM customer""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return stats.completeness(trade(spark, d))


@query(_TRADE + "SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS sources, max(n) / CAST(sum(n) AS DOUBLE) AS top_share FROM (SELECT label, src, count(*) AS n FROM edges GROUP BY ALL) GROUP BY label")
def edge_fanout(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_fanout(trade(spark, d).edges)


_PARTS = """
WITH RECURSIVE e AS (SELECT 'o' || (o_orderkey // 10) AS a, 'o' || o_orderkey AS b FROM orders WHERE o_orderstatus <> 'F'),
ids AS (SELECT 'o' || o_orderkey AS node_id, o_orderkey FROM orders),
up AS (
  SELECT node_id, o_orderkey AS k FROM ids
  UNION ALL
  SELECT node_id, k // 10 FROM up JOIN e ON e.b = 'o' || k AND k <> k // 10),
root AS (SELECT node_id, min(k) AS k FROM up GROUP BY node_id)
"""


def order_tree(spark: SparkSession, d: str) -> Graph:
    """Every order below the one of its number without the last digit, but those of status F below themselves: a forest."""
    o = table(spark, d, "orders")
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    n = o.select(name(F.col("o_orderkey")).alias("node_id"), F.lit("Order").alias("class"))
    e = o.select(name(F.expr("if(o_orderstatus = 'F', o_orderkey, o_orderkey div 10)")).alias("src"), name(F.col("o_orderkey")).alias("dst"), F.lit("ABOVE").alias("label"))
    return Graph(n, e)


@query(_PARTS + "SELECT r.node_id, min(s.node_id) AS component FROM root r JOIN root s ON r.k = s.k GROUP BY r.node_id")
def components(spark: SparkSession, d: str) -> DataFrame:
    return stats.components(order_tree(spark, d))


@query(_PARTS + ", c AS (SELECT k, min(node_id) AS component, count(*) AS size FROM root GROUP BY k) SELECT component, size FROM c")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.component_sizes(order_tree(spark, d))


@query("""
SELECT 's' || s_suppkey AS src, 'r' || n_regionkey AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def two_hops(spark: SparkSession, d: str) -> DataFrame:
    return stats.neighbours(trade(spark, d), 2, ["IN", "PART_OF"])


@query("""
SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node_id, 0 AS hops FROM customer
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def paths_up_to_three(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    return stats.reach(g.edges, g.nodes.filter("class = 'Customer'"), 3)


@query("""
WITH v AS (
  SELECT r_regionkey AS r, NULL AS n, NULL AS s, 0 AS depth FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, NULL, 1 FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT a.depth + b.depth - 2 * CASE WHEN a.n = b.n THEN 1 ELSE 0 END AS hops FROM v a JOIN v b ON a.r = b.r AND (a.n, a.s) IS DISTINCT FROM (b.n, b.s))
SELECT count(*) AS pairs, avg(hops) AS average_path, max(hops) AS diameter FROM p""")
def path_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.path_summary(geography(spark, d))


@query("""
WITH n AS (SELECT n_regionkey AS r, n_nationkey AS n, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2),
t AS (SELECT r, sum(1 + k) AS below, sum((1 + k) * (1 + k)) AS squares FROM n GROUP BY r)
SELECT 'r' || r_regionkey AS node_id, CAST(coalesce((below * below - squares) / 2, 0) AS DOUBLE) AS betweenness FROM region LEFT JOIN t ON r = r_regionkey
UNION ALL SELECT 'n' || n, CAST((below * below - k - (below - k) * (below - k)) / 2 AS DOUBLE) FROM n JOIN t USING (r)
UNION ALL SELECT 's' || s_suppkey, 0.0 FROM supplier""")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return stats.betweenness(geography(spark, d))


@query("SELECT 'n' || c_nationkey AS node_id, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean, count(DISTINCT c_mktsegment) AS segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names FROM customer GROUP BY c_nationkey")
def neighbour_aggregates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer")
    return e.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node_id")).agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"), (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"), F.count_distinct("c_mktsegment").alias("segments"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("names"))


# -- filters and integrity


def broken(spark: SparkSession, d: str) -> Graph:
    """Customers with a positive balance, of which those of one segment have nothing but a blank name, and edges from orders' numbers to all customers."""
    c = table(spark, d, "customer")
    pos = F.struct(F.col("c_custkey").alias("rec"), F.lit(0).alias("place"), F.lit("").alias("ix")).alias("pos")
    n = c.filter("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), pos, F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("segment"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(" "), F.lit("nation"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("string")).otherwise("")).alias("attrs"))
    o = table(spark, d, "orders")
    e = o.select(F.concat(F.lit("c"), F.expr("o_orderkey % 1000").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"), F.col("o_orderstatus").alias("label"), F.struct(F.col("o_orderkey").alias("rec"), F.lit(0).alias("place"), F.lit("").alias("ix")).alias("pos"), F.lit(False).alias("closed"))
    return Graph(n, e)


_BROKEN = """
WITH nodes AS (SELECT 'c' || c_custkey AS node_id, c_custkey, c_mktsegment AS seg, c_nationkey AS nation FROM customer WHERE c_acctbal > 0),
edges AS (SELECT 'c' || (o_orderkey % 1000) AS src, 'c' || o_custkey AS dst, o_orderstatus AS label, o_orderkey AS pos FROM orders),
good AS (SELECT * FROM nodes WHERE seg <> 'BUILDING')
"""


@query(_BROKEN + """
SELECT src, dst, label, 'source' AS missing FROM edges WHERE src NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT src, dst, label, 'target' FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes)""")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean.dangling(broken(spark, d))


@query(_BROKEN + "SELECT node_id FROM nodes WHERE seg = 'BUILDING'")
def phantom_nodes(spark: SparkSession, d: str) -> DataFrame:
    return clean.phantoms(broken(spark, d))


@query(_BROKEN + "SELECT src, dst, label FROM edges WHERE src <> dst AND src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes) GROUP BY ALL")
def sound_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_duplicate_edges(clean.drop_orphans(clean.drop_self_edges(broken(spark, d)))).edges.select("src", "dst", "label")


_CLEANED = _BROKEN + """,
map AS (SELECT node_id, first_value(node_id) OVER (PARTITION BY seg, nation ORDER BY c_custkey) AS survivor FROM good),
moved AS (SELECT coalesce(a.survivor, e.src) AS src, coalesce(b.survivor, e.dst) AS dst, label, pos, e.src = e.dst AS was
          FROM edges e LEFT JOIN map a ON a.node_id = e.src LEFT JOIN map b ON b.node_id = e.dst
          WHERE e.src NOT IN (SELECT node_id FROM nodes WHERE seg = 'BUILDING') AND e.dst NOT IN (SELECT node_id FROM nodes WHERE seg = 'BUILDING')),
one AS (SELECT src, dst, arg_max(label, pos) AS label FROM moved WHERE src <> dst GROUP BY src, dst)
"""


@query(_CLEANED + "SELECT src, dst, label FROM one WHERE src IN (SELECT survivor FROM map) AND dst IN (SELECT survivor FROM map)")
def cleaned_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean(broken(spark, d)).edges.select("src", "dst", "label")


@query(_CLEANED + "SELECT DISTINCT survivor AS node_id FROM map")
def cleaned_nodes(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean(broken(spark, d)).nodes.select("node_id")


@query(_BROKEN + """
SELECT severity, kind, count(*) AS n FROM (
  SELECT 'error' AS severity, 'missing source' AS kind FROM edges WHERE src NOT IN (SELECT node_id FROM nodes)
  UNION ALL SELECT 'error', 'missing target' FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes)
  UNION ALL SELECT 'error', 'empty node' FROM nodes WHERE seg = 'BUILDING') GROUP BY ALL""")
def structure_violations(spark: SparkSession, d: str) -> DataFrame:
    return clean.violations(broken(spark, d)).groupBy("severity", "kind").agg(F.count("*").alias("n"))


@query("SELECT 'p' || p_partkey AS node_id, 'p' || min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS survivor FROM part QUALIFY p_partkey <> min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type, p_size)")
def duplicate_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Part").alias("class"), F.col("p_partkey").alias("pos"), F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("kind"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("attrs"))
    return clean.duplicate_nodes(Graph(n, n))


@query("SELECT 'p' || p_partkey AS node_id, 'Part' AS class, 'cardinality_bound' AS reason FROM (SELECT p_partkey, row_number() OVER (ORDER BY 'p' || p_partkey) AS r FROM part) WHERE r > 100")
def cardinality_bounds(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Part").alias("class"), F.create_map(F.lit("name"), "p_name").alias("attrs"))
    e = n.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("SELF").alias("label")).limit(0)
    return clean.cardinality_bounds(Graph(n, e), {"Part": 100}, [])[1]


@query("""
WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag = 'R' AS closed FROM lineitem),
bad AS (SELECT dst FROM e GROUP BY dst HAVING bool_and(closed))
SELECT src, dst FROM e WHERE dst IN (SELECT dst FROM bad)""")
def closed_catalogs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Part").alias("class"))
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), (F.col("l_returnflag") == "R").alias("closed"))
    return clean.closed_catalogs(Graph(n, e))[1].select("src", "dst")


@query("SELECT o_orderkey, list_slice(list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey), 1, 5) AS keywords FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def capped_keywords(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("k")))), lambda x: x["k"]).alias("keywords"))
    return clean.cap_keywords(k.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi"))


@query("SELECT 'c' || c_custkey AS node_id, 'Customer' AS class FROM customer WHERE c_acctbal <= 0")
def empty_identities(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), F.create_map(F.lit("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" ")).alias("attrs"))
    return clean.empty_identities(Graph(n, n), {"Customer": ["segment"]})


# -- merging


def halves(spark: SparkSession, d: str) -> Graph:
    """Two inputs of parts by suppliers: lines of orders of even and of odd numbers; the parts that both have agree in brand and differ in others."""
    l = table(spark, d, "lineitem")
    pos = F.struct(F.col("l_orderkey").alias("rec"), F.lit(0).alias("place"), F.concat_ws("/", F.lpad("l_linenumber", 3, "0"), F.lpad("l_suppkey", 9, "0")).alias("ix")).alias("pos")
    n = l.select(F.expr("int(l_orderkey % 2)").alias("input"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node_id"), F.lit("Part").alias("class"), pos, F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.col("l_linestatus"))).alias("attrs"))
    e = l.select(F.expr("int(l_orderkey % 2)").alias("input"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.concat(F.lit("SENT_"), "l_returnflag").alias("label"), pos)
    return Graph(n, e)


_ROWS = """
WITH l AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_returnflag AS flag, l_linestatus AS status, [l_orderkey % 2, l_orderkey, l_linenumber, l_suppkey] AS pos FROM lineitem)
"""


@query(_ROWS + "SELECT p AS node_id, 'flag=' || arg_min(flag, [pos, [ascii(flag)]]) || coalesce(';status=' || arg_min(status, pos) FILTER (status <> 'O'), '') AS attrs FROM l GROUP BY p")
def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_nodes(halves(spark, d).nodes)[0].select("node_id", shown().alias("attrs"))


@query(_ROWS + """, k AS (SELECT p, arg_min(flag, [pos, [ascii(flag)]]) AS kept FROM l GROUP BY p)
SELECT DISTINCT p AS node_id, 'flag' AS key, kept, flag AS dropped FROM l JOIN k USING (p) WHERE flag <> kept""")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_nodes(halves(spark, d).nodes)[1]


@query(_ROWS + """, k AS (SELECT s, p, flag, min([pos, [ascii(flag)]]) AS first FROM l GROUP BY s, p, flag)
SELECT s AS src, p AS dst, 'SENT_' || arg_min(flag, first) AS label, array_to_string((list('SENT_' || flag ORDER BY first))[2:], ',') AS also FROM k GROUP BY s, p""")
def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_edges(halves(spark, d).edges)[0].select("src", "dst", "label", F.array_join("also_labels", ",").alias("also"))


@query("""
WITH i AS (SELECT conv_id * 1000 + turn AS input, CASE WHEN role = 'system' THEN NULL ELSE role || (conv_id // 3) END AS document_id, 'p' || (conv_id // 2) AS path FROM conversations)
SELECT input, document_id, path FROM i QUALIFY row_number() OVER (PARTITION BY coalesce(document_id, 'path:' || path) ORDER BY input) = 1""")
def unique_inputs(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn").alias("input"), F.when(F.col("role") != "system", F.concat("role", F.expr("conv_id div 3").cast("string"))).alias("document_id"), F.concat(F.lit("p"), F.expr("conv_id div 2").cast("string")).alias("path"))
    return merge.unique_inputs(i)


@query("SELECT count(DISTINCT p_brand) AS schemas FROM part HAVING count(DISTINCT p_brand) > 1")
def schema_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return merge.schema_conflicts(table(spark, d, "part").withColumnRenamed("p_brand", "schema_hash"))


@query("""
WITH n AS (SELECT DISTINCT CAST(o_orderkey % 2 AS INTEGER) AS input, o_custkey AS c FROM orders),
o AS (SELECT c FROM n WHERE input = 0),
v AS (SELECT o_custkey AS c, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS a, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)
SELECT input, 'Customer' AS class, 0 AS owner, a <> b AS conflicting, 'c' || c AS node_id FROM n JOIN o USING (c) JOIN v USING (c) WHERE input = 1""")
def identity_collisions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("input", F.expr("int(o_orderkey % 2)"))
    n = o.groupBy("input", "o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"), F.min("o_orderkey").alias("pos")).select("input", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), "pos", F.create_map(F.lit("priority"), "p").alias("attrs"))
    e = n.select("input", F.concat(F.lit("root"), F.col("input").cast("string")).alias("src"), F.col("node_id").alias("dst"), F.lit("HAS").alias("label"), "pos")
    ends = o.select("input", F.concat(F.lit("root"), F.col("input").cast("string")).alias("node_id")).distinct().select("input", "node_id", F.lit("Root").alias("class"), F.lit(0).cast("long").alias("pos"), F.create_map(F.lit("name"), F.lit("x")).alias("attrs"))
    return merge.collisions(Graph(n.unionByName(ends), e))


# -- aliases


@query("""
WITH t AS (SELECT DISTINCT p_brand AS class, p_name AS x FROM part UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) FROM part),
p AS (SELECT a.class, a.x AS superset, b.x AS base, count(*) OVER (PARTITION BY a.class, a.x) AS n FROM t a JOIN t b ON a.class = b.class AND length(b.x) >= 4 AND length(b.x) < length(a.x) AND contains(a.x, b.x))
SELECT class, superset, base FROM p WHERE n = 1""")
def alias_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    t = p.select(F.col("p_brand").alias("class"), F.col("p_name").alias("text")).union(p.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)))).distinct()
    return alias.containment(t.withColumn("id", F.col("text")), ["class"])


@query("""
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
c AS (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 1) AS b FROM part)
SELECT DISTINCT c.a, c.b FROM c JOIN e x ON x.dst = c.a JOIN e y ON y.dst = c.b AND y.src = x.src""")
def sibling_veto(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    e = table(spark, d, "lineitem").select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("SENT").alias("label"))
    c = table(spark, d, "part").select(name("p", "p_partkey").alias("a"), name("p", F.col("p_partkey") + 1).alias("b"))
    return alias.siblings(Graph(c, e), c)


# -- text, hashes and other functions

@query("SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS normal, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS folded, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS squashed, regexp_extract_all(p_brand, '\\d+') AS digits, '_' || regexp_replace(upper(p_brand), '[^0-9A-Z]+', '_', 'g') || '_' AS phrase, lower(replace(p_name, ' ', '')) AS same FROM part")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalize_name("p_name").alias("normal"), text.fold_id("p_name").alias("folded"), text.squash("p_brand").alias("squashed"), text.digit_signature("p_brand").alias("digits"), text.phrase_key("p_brand").alias("phrase"), text.equivalence_key("p_name").alias("same"))


@query("""
SELECT page_id, x AS stripped, length(x) AS chars FROM (SELECT page_id, trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS x FROM pages)""")
def stripped_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_markup("html").alias("stripped"), text.content_chars("html").alias("chars"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS shortened, CASE WHEN length(text) <= 200 THEN text WHEN regexp_matches(substr(text, 1, 200), '[.!?]') THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) ELSE substr(text, 1, 200) END AS cut FROM conversations")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.truncate("text", 80).alias("shortened"), text.cut_at_sentence("text", 200).alias("cut"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(511, greatest(0, CAST(round_even(512.0 * l_quantity / 100, 0) AS INTEGER))) AS x0, least(511, greatest(0, CAST(round_even(512.0 * (l_quantity + 50) / 100, 0) AS INTEGER))) AS x1 FROM lineitem")
def page_locations(spark: SparkSession, d: str) -> DataFrame:
    q, one = F.col("l_quantity"), F.lit(100.0)
    at = hashing.location(q + 50, F.lit(1.0), q, F.lit(2.0), one, one)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", at.alias("at")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("at")[0].alias("x0"), F.col("at")[2].alias("x1"))


@query("SELECT o_orderkey, replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'T', ' ') AS stamp, 'o' || o_orderkey || '__var_' || substr(o_orderpriority, 1, 8) AS variant FROM orders")
def temporal_and_variants(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", hashing.temporal(iso).alias("stamp"), hashing.variant_id(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), "o_orderpriority").alias("variant"))


@query("SELECT p_partkey, sha256('p_brand=' || p_brand || chr(31) || 'p_name=' || p_name) AS h, 'parts|p_brand=' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || ',p_name=' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", hashing.content_hash(["p_name", "p_brand"]).alias("h"), hashing.identity_key("parts", {"p_name": "p_name", "p_brand": "p_brand"}).alias("key"))


# -- chunks, windows, anchors


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(table(spark, d, "documents"), "doc_id", limit=256)


@query()
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    return chunk.batches(chunk.chunks(table(spark, d, "documents"), "doc_id", limit=64), "doc_id", 400)


@query("""
WITH s AS (SELECT conv_id, list(greatest(1, length(text) // 6) ORDER BY turn) AS c, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, unnest(t) AS chunk_id, unnest(list_transform(range(1, len(c) + 1), lambda i: c[i])) AS token_count FROM s)
SELECT conv_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, avg(token_count) AS average, max(token_count) AS largest FROM r GROUP BY conv_id""")
def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("chunk_id"), F.greatest(F.lit(1), F.expr("length(text) div 6")).alias("token_count"))
    return chunk.chunk_stats(c, "conv_id")


@query("""
WITH n AS (SELECT doc_id, text, length(text) AS t, greatest(1, CAST(ceil(length(text) / 1000.0) AS INTEGER)) AS n FROM documents),
w AS (SELECT doc_id, text, CAST(unnest(range(n)) AS INTEGER) AS win, t, n FROM n),
s AS (SELECT doc_id, text, win, CAST(CASE WHEN n = 1 THEN 0 ELSE (win * (t - 1000)) // (n - 1) END AS INTEGER) AS start FROM w)
SELECT doc_id, win AS "window", start, substr(text, start + 1, 1000) AS text FROM s""")
def text_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunk.windows(table(spark, d, "documents"), "doc_id", 1000)


@query("""
WITH h AS (SELECT item_id, doc_id, instr(lower(d.text), lower(b.text)) - 1 AS start, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))),
c AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS m FROM h)
SELECT item_id, doc_id AS chunk_id, start, start + n AS "end" FROM c WHERE m <= 6""")
def anchor_scan(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    hits = provenance.anchors(b.select(F.col("text").alias("value")), table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), [])
    return hits.join(b.select("item_id", F.col("text").alias("value")), "value").select("item_id", "chunk_id", "start", "end")


_VIEW = """
WITH h AS (SELECT DISTINCT l_partkey AS p, CAST(l_orderkey AS INTEGER) AS c FROM lineitem), g AS (SELECT p, list(c ORDER BY c) AS c FROM h GROUP BY p)
"""


@query(_VIEW + "SELECT p AS node_id, list_slice(c, 1, 8) AS chunk_ids, CAST(greatest(len(c) - 8, 0) AS INTEGER) AS chunks_omitted FROM g")
def compact_views(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").cast("int").alias("chunk_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("ref"))
    return provenance.capped_view(rows, ["node_id"]).select("node_id", "chunk_ids", "chunks_omitted")


def supplier_views(spark: SparkSession, d: str) -> DataFrame:
    """A view a line: the part's support in the document of its supplier."""
    kind = F.when(F.col("l_returnflag") == "R", "unresolved").when(F.col("l_returnflag") == "A", "exact").otherwise("verbatim")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("document_id"), kind.alias("kind"), F.array(F.col("l_orderkey").cast("int")).alias("chunk_ids"), F.array().cast("array<struct<chunk_id:int,start:int,end:int>>").alias("spans"), F.array("l_linestatus").alias("refs"), (F.col("l_linestatus") == "O").alias("approximate"), F.lit(0).alias("chunks_omitted"))


@query("""
WITH v AS (SELECT l_partkey AS p, l_suppkey AS s, CAST(l_orderkey AS INTEGER) AS c, l_linestatus AS r, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 5 ELSE 3 END AS k FROM lineitem),
b AS (SELECT *, max(k) OVER (PARTITION BY p, s) AS best FROM v),
g AS (SELECT p, s, max(k) AS k, list(DISTINCT c) AS c, list(DISTINCT r) AS r, bool_and(r = 'O') AS a FROM b WHERE k > 0 OR best = 0 GROUP BY p, s),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s) AS n, count(*) OVER (PARTITION BY p) AS t FROM g)
SELECT p AS node_id, s AS document_id, CASE k WHEN 0 THEN 'unresolved' WHEN 5 THEN 'exact' ELSE 'verbatim' END AS kind, array_to_string(list_slice(list_sort(c), 1, 8), ',') AS chunks, array_to_string(list_sort(r), ',') AS refs, a AS approximate, CAST(greatest(len(c) - 8, 0) AS BIGINT) AS chunks_omitted, greatest(t - 8, 0) AS sources_omitted
FROM n WHERE n <= 8""")
def merged_views(spark: SparkSession, d: str) -> DataFrame:
    return provenance.merged_views(supplier_views(spark, d)).select("node_id", "document_id", "kind", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunks"), F.array_join("refs", ",").alias("refs"), "approximate", "chunks_omitted", "sources_omitted")


@query("SELECT l_partkey AS node_id, count(*) AS weight FROM lineitem GROUP BY 1")
def provenance_weight(spark: SparkSession, d: str) -> DataFrame:
    return provenance.weight(supplier_views(spark, d))


# -- skeletons and parents


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS parent FROM events")
def adjacent_parent(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return e.select("event_id", "user_id", attach.adjacent(e, ["user_id"], "at", F.col("event_type") == "signup", "event_id").alias("parent"))


@query("""
WITH c AS (SELECT user_id AS document, event_id AS chunk_id, event_type FROM events),
m AS (SELECT document, chunk_id, CASE WHEN event_type = 'signup' THEN chunk_id END AS head, CASE WHEN event_type IN ('signup', 'purchase') THEN chunk_id END AS "any" FROM c),
l AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY document ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m),
o AS (SELECT document, chunk_id, head, "any", CASE WHEN chunk_id - last <= 600 THEN last END AS carried FROM l)
SELECT document, chunk_id, coalesce(head, "any", carried) AS owner, CASE WHEN head IS NOT NULL THEN 'head' WHEN "any" IS NOT NULL THEN 'mention' ELSE 'carried' END AS how FROM o WHERE coalesce(head, "any", carried) IS NOT NULL""")
def chunk_owners(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("chunk_id"), "event_type")
    m = c.filter("event_type in ('signup', 'purchase')").select("document", "chunk_id", F.col("chunk_id").alias("owner"), (F.col("event_type") == "signup").alias("in_head"))
    return attach.chunk_owners(c.select("document", "chunk_id"), m, 600)


@query("""
WITH r AS (SELECT l_suppkey AS document, l_partkey AS key, l_orderkey AS batch, l_linenumber AS pos, l_quantity AS q, l_extendedprice AS x FROM lineitem),
b AS (SELECT *, min(batch) OVER (PARTITION BY document, key) AS b FROM r)
SELECT document, key, array_to_string(list_sort(list(DISTINCT batch)), ',') AS batches, array_to_string(list_sort(list(DISTINCT pos) FILTER (batch = b)), ',') AS chunks FROM b GROUP BY document, key""")
def merged_skeleton(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document"), F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").alias("chunk_id"), F.col("l_quantity").alias("q"))
    m = attach.merge_batches(r, ["document"])
    return m.select("document", "key", F.array_join(F.col("batches").cast("array<string>"), ",").alias("batches"), F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunks"))


@query("SELECT user_id, event_id, -CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS handle FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50")
def reference_handles(spark: SparkSession, d: str) -> DataFrame:
    return attach.reference_handles(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""
WITH c AS (SELECT conv_id AS document, turn AS chunk_id, length(text) AS token_count, role FROM conversations),
t AS (SELECT document, sum(token_count) AS t, sum(token_count) FILTER (role <> 'user') AS u FROM c GROUP BY 1)
SELECT document, chunk_id, token_count FROM c JOIN t USING (document) WHERE role <> 'user' AND u >= 0.4 * t""")
def uncovered_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("chunk_id"), F.length("text").alias("token_count"), "role")
    return attach.uncovered(c, c.filter("role = 'user'"), 0.4)


# -- evaluation


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Truth: the toxic documents by source; found: those of even numbers, and others of numbers that 7 divides."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("class"), F.col("doc_id").cast("string").alias("key"), "doc_id", "toxic")
    return l.filter("toxic = 1"), l.filter("(toxic = 1 and doc_id % 2 = 0) or (toxic = 0 and doc_id % 7 = 0)")


_PRF = """
WITH l AS (SELECT source AS class, doc_id, toxic FROM labels JOIN documents USING (doc_id)),
c AS (SELECT class, count(*) FILTER (toxic = 1 AND doc_id % 2 = 0) AS tp, count(*) FILTER (toxic = 0 AND doc_id % 7 = 0) AS fp, count(*) FILTER (toxic = 1 AND doc_id % 2 = 1) AS fn FROM l GROUP BY class),
"""
_PRF_TAIL = """
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r FROM k)
SELECT * EXCLUDE (p, r), round(p, 3) AS "precision", round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM q"""


@query(_PRF + "k AS (SELECT * FROM c WHERE tp + fp + fn > 0)," + _PRF_TAIL)
def evaluation_by_class(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.strict(*_judged(spark, d))


@query(_PRF + "k AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c)," + _PRF_TAIL)
def evaluation_micro(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.micro(evaluate.strict(*_judged(spark, d)))


@query("SELECT 'Customer' AS class, count(*) AS nodes, avg((1 + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / 2.0) AS mean_fill, count(*) AS names, count(*) FILTER (c_acctbal > 0) AS segments FROM customer")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.fill_rates(trade(spark, d), {"Customer": ["name", "segment"]})
    return r.select("class", "nodes", "mean_fill", F.col("filled")["name"].alias("names"), F.col("filled")["segment"].alias("segments"))


@query("""
WITH v AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS v FROM conversations WHERE turn <= 1),
t AS (SELECT conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM conversations WHERE turn > 1),
f AS (SELECT conv_id, turn, v, coalesce(bool_or(contains(t, v)), false) AS ok FROM v LEFT JOIN t USING (conv_id) WHERE v <> '' GROUP BY ALL)
SELECT conv_id, count(*) AS checked, count(*) FILTER (ok) AS found, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS share FROM f GROUP BY conv_id""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return evaluate.grounding(c.filter("turn <= 1").select("conv_id", F.col("text").alias("value")), c.filter("turn > 1"), ["conv_id"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS runs, avg(o_totalprice) AS mean_o_totalprice FROM orders GROUP BY 1, 2")
def cell_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cell_summary(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


@query("""
WITH c AS (SELECT p_name AS path, count(*) AS n FROM part GROUP BY 1), s AS (SELECT list(n ORDER BY n) AS a FROM c)
SELECT path, n, a[len(a) // 2 + 1] AS median FROM c, s WHERE n > 1.5 * a[len(a) // 2 + 1]""")
def over_discovered(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.over_discovered(table(spark, d, "part").groupBy(F.col("p_name").alias("path")).agg(F.count("*").alias("n")), 1.5)


# -- votes and merging across documents


@query("SELECT name, kind FROM (SELECT p_name AS name, p_type AS kind, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, first) = 1")
def majority_kind(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("pos"))
    return induce.majority(p, ["name"], "kind", "pos").select("name", "kind")


@query("SELECT arg_max(name, [votes, -first]) AS root FROM (SELECT p_name AS name, count(*) FILTER (p_size = 1) AS votes, min(p_partkey) AS first FROM part GROUP BY 1)")
def elected_root(spark: SparkSession, d: str) -> DataFrame:
    return induce.elected_root(table(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_size") == 1).alias("is_root"), F.col("p_partkey").alias("pos")))


@query("SELECT name, documents FROM (SELECT p_name AS name, count(DISTINCT p_brand) AS documents, min(p_partkey) AS first FROM part GROUP BY 1) ORDER BY documents DESC, first LIMIT 10")
def capped_models(spark: SparkSession, d: str) -> DataFrame:
    return induce.capped(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("document"), F.col("p_partkey").alias("pos")), 10)


@query("""
WITH r AS (SELECT p_type AS name, p_brand AS document, p_name AS example, p_partkey AS pos, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY p_type, p_brand) AS d FROM part),
f AS (SELECT name, example, min([turn, d]) AS place FROM r GROUP BY ALL)
SELECT name, list_slice(list(example ORDER BY place), 1, 5) AS examples FROM f GROUP BY name""")
def round_robin_examples(spark: SparkSession, d: str) -> DataFrame:
    return induce.round_robin(table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("document"), F.col("p_name").alias("example"), F.col("p_partkey").alias("pos")))


@query("SELECT p_brand AS name, CASE max(CASE WHEN p_size < 10 THEN 1 WHEN p_size < 45 THEN 2 ELSE 3 END) WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'str' END AS type FROM part GROUP BY 1")
def scalar_lattice(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") < 10, "int").when(F.col("p_size") < 45, "float").otherwise("str")
    return induce.widest(table(spark, d, "part").select(F.col("p_brand").alias("name"), kind.alias("type")))


@query("SELECT p_brand AS name, CASE WHEN count(DISTINCT p_name) > 24 THEN 'str' ELSE 'enum' END AS kind, CASE WHEN count(DISTINCT p_name) > 24 THEN NULL ELSE string_agg(DISTINCT p_name, ',' ORDER BY p_name) END AS members FROM part GROUP BY 1")
def enum_union(spark: SparkSession, d: str) -> DataFrame:
    r = induce.enums(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.array("p_name").alias("members")))
    return r.select("name", "kind", F.when(F.col("kind") == "enum", F.array_join("members", ",")).alias("members"))


# -- ontologies as triples


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Orders from 10 on as classes, each below that of its number without the last digit, where its status isn't F."""
    return order_tree(spark, d).edges.filter("length(dst) > 2").select(F.col("dst").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("src").alias("o"))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS s, o_orderkey // 10 AS o FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey >= 10),
up AS (SELECT s AS c, o AS a, 1 AS depth FROM e UNION ALL SELECT c, e.o, depth + 1 FROM up JOIN e ON e.s = up.a)
SELECT 'o' || c AS class, 'o' || a AS ancestor, depth FROM up""")
def class_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return ontology.ancestors(_triples(spark, d))


# -- traces and input kinds


@query("SELECT user_id, event_type, count(*) AS events, min(ts) AS began, max(ts) AS ended, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS took_us FROM events GROUP BY 1, 2")
def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    from .sinks.report import trace_steps as steps

    return steps(table(spark, d, "events"), ["user_id", "event_type"], "ts")


@query("""
SELECT page_id, 'url' AS kind, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) LIKE '%.pdf' THEN '.pdf' ELSE '.html' END AS extension FROM pages""")
def input_kinds(spark: SparkSession, d: str) -> DataFrame:
    from .sources import detect

    p = table(spark, d, "pages")
    return p.select("page_id", detect.kind("url").alias("kind"), detect.host("url").alias("host"), detect.url_extension("url", F.lit("text/html")).alias("extension"))


@query("""
SELECT 'MERGE (n:Customer {id: ''c' || c_custkey || '''}) SET n.name = ''' || c_name || ''', n.segment = ''' || c_mktsegment || ''';' AS line FROM customer""")
def cypher_nodes(spark: SparkSession, d: str) -> DataFrame:
    from .sinks.cypher import node_lines

    n = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("attrs"))
    return node_lines(n).select("line")


@query(_TRADE + """
SELECT 'MATCH (a:' || a.class || ' {id: ''' || src || '''}), (b:' || b.class || ' {id: ''' || dst || '''}) MERGE (a)-[:' || label || ']->(b);' AS line
FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst""")
def cypher_edges(spark: SparkSession, d: str) -> DataFrame:
    from .sinks.cypher import edge_lines

    g = trade(spark, d)
    return edge_lines(g.nodes, g.edges).select("line")


@query()
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties, of which every third has lost its end, as JSON again."""
    from .functions.json_repair import repaired

    e = table(spark, d, "events").withColumn("raw", F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")))
    return e.select("event_id", repaired("raw").alias("json"))


@query("""
SELECT doc_id, CASE WHEN length(text) // 4 + 500 <= 3000 AND length(text) <= 2000 THEN 'direct' ELSE 'dense' END AS contract FROM documents""")
def auto_contract(spark: SparkSession, d: str) -> DataFrame:
    from .operators.extract import contract

    return table(spark, d, "documents").select("doc_id", contract(F.length("text"), 500, 3000).alias("contract"))


PAGES = Template("Page", (Model("Page", (Field("title", "str", "identity"), Field("links", "str", is_list=True))),))


@query("""
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), '') AS title, coalesce(len(regexp_extract_all(html, '<a href="[^"]*">([^<]+)</a>', 1)), 0) AS links FROM pages""")
def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    """A client of rules over whole pages."""
    from .operators.extract import Rules, direct

    rules = {"title": "<title>([^<]+)</title>", "links": '<a href="[^"]*">([^<]+)</a>'}
    r = direct(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), "page_id", PAGES, lambda: Rules(rules), sparse_check=False)
    return r.select("page_id", "record.title", F.coalesce(F.size("record.links"), F.lit(0)).alias("links"))


# -- more of merging, rekeying and attaching


@query("""
WITH c AS (SELECT o_custkey AS c, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS a, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1),
split AS (SELECT bool_or(a <> b) AS x FROM c)
SELECT 'c' || c AS node_id FROM c WHERE a IS NOT NULL UNION ALL SELECT 'c' || c || CASE WHEN a IS NOT NULL AND x THEN '__src_1' ELSE '' END FROM c, split WHERE b IS NOT NULL
UNION ALL SELECT 'root0' UNION ALL SELECT 'root1'""")
def split_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers of even and of odd orders as two inputs: one conflict splits all that both have."""
    o = table(spark, d, "orders").withColumn("input", F.expr("int(o_orderkey % 2)"))
    root = F.concat(F.lit("root"), F.col("input").cast("string"))
    n = o.groupBy("input", "o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"), F.min("o_orderkey").alias("pos")).select("input", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), "pos", F.create_map(F.lit("priority"), "p").alias("attrs"))
    r = o.select("input", root.alias("node_id")).distinct().select("input", "node_id", F.lit("Root").alias("class"), F.lit(0).cast("long").alias("pos"), F.create_map(F.lit("name"), F.lit("x")).alias("attrs"))
    e = n.select("input", root.alias("src"), F.col("node_id").alias("dst"), F.lit("HAS").alias("label"), "pos")
    return merge.split_collisions(Graph(n.unionByName(r), e))[0].nodes.select("node_id")


@query(_ROWS + """, k AS (SELECT p, arg_min(flag, [pos, [ascii(flag)]]) AS kept FROM l GROUP BY p), c AS (SELECT DISTINCT p, flag AS dropped FROM l JOIN k USING (p) WHERE flag <> kept)
SELECT p AS src, p || '__var_' || substr(sha256('flag' || chr(31) || dropped), 1, 8) AS dst, 'HAS_CONFLICT_VARIANT' AS label FROM c""")
def conflict_variants(spark: SparkSession, d: str) -> DataFrame:
    nodes, conflicts = merge.fold_nodes(halves(spark, d).nodes)
    return merge.conflict_variants(nodes, conflicts).edges.select("src", "dst", "label")


@query("SELECT DISTINCT 's' || l_suppkey AS src, CASE WHEN l_partkey % 2 = 0 THEN 'q' || (l_partkey // 2) ELSE 'p' || l_partkey END AS dst, 'SENT_' || l_returnflag AS label FROM lineitem")
def rekeyed_edges(spark: SparkSession, d: str) -> DataFrame:
    old = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    ids = table(spark, d, "part").select(old.alias("node_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("q"), F.expr("p_partkey div 2").cast("string"))).otherwise(old).alias("new_id"))
    return merge.rekey(halves(spark, d), ids).edges.select("src", "dst", "label").distinct()


@query("""
WITH e AS (SELECT user_id AS document, CAST(event_id % 8 AS INTEGER) AS batch, event_id, event_id // 8 AS i FROM events)
SELECT a.event_id, b.event_id AS parent FROM e a LEFT JOIN e b ON a.document = b.document AND a.batch = b.batch AND b.i = a.i - 1""")
def resolved_handles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("document"), F.expr("int(event_id % 8)").alias("batch"), F.expr("event_id div 8").alias("i"), F.lit("x").alias("path"), F.col("event_id").alias("ids")).withColumn("p", F.col("i") - 1)
    return attach.resolve_handles(e).select(F.col("ids").alias("event_id"), F.col("parent_ids").alias("parent"))


@query("""
WITH b AS (SELECT event_type AS path, count(*) AS had FROM events WHERE user_id % 3 = 0 GROUP BY 1),
n AS (SELECT event_type AS path, event_id AS pos, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE user_id % 3 <> 0)
SELECT path, pos FROM n JOIN b USING (path) WHERE k <= had""")
def growth_cap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("event_id").alias("pos"), "user_id")
    return attach.growth_cap(e.filter("user_id % 3 <> 0").select("path", "pos"), e.filter("user_id % 3 = 0"))


@query("""
WITH h AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS c FROM lineitem)
SELECT p AS node_id, array_to_string(list_sort(list(DISTINCT g)), ',') AS pages FROM (SELECT p, unnest([c // 100, c // 100 + 1]) AS g FROM h) GROUP BY p""")
def pages_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("chunk_id"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id")).distinct().withColumn("pages", F.array(F.expr("chunk_id div 100"), F.expr("chunk_id div 100") + 1))
    return provenance.pages_of(h, c, ["node_id"]).select("node_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("SELECT l_suppkey AS entry, l_returnflag AS ref, l_orderkey AS place FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) = 1")
def first_geometry(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entry"), F.col("l_returnflag").alias("ref"), F.col("l_orderkey").alias("place"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"))
    return provenance.first_geometry(r, ["entry"]).select("entry", "ref", "place")


@query("""
WITH e AS (SELECT DISTINCT l_returnflag AS label, l_suppkey AS s, l_partkey AS p, l_linestatus AS st FROM lineitem),
k AS (SELECT label, s, p, bool_or(st = 'O') AS t, bool_or(st = 'F') AS g FROM e GROUP BY ALL),
c AS (SELECT label, count(*) FILTER (t AND g) AS tp, count(*) FILTER (g AND NOT t) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM k GROUP BY label),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r FROM c)
SELECT label, tp, fp, fn, round(p, 3) AS "precision", round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM q""")
def edge_evaluation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), "l_linestatus")
    return evaluate.edge_prf(e.filter("l_linestatus = 'O'"), e.filter("l_linestatus = 'F'"))


@query("""
WITH u AS (SELECT p_size AS unit, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS c, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS f FROM part),
c AS (SELECT unit, count(*) AS n FROM (SELECT c, min(unit) AS unit FROM u GROUP BY c) GROUP BY unit),
f AS (SELECT unit, count(*) AS n FROM (SELECT c, f, min(unit) AS unit FROM u GROUP BY c, f) GROUP BY unit)
SELECT unit, coalesce(c.n, 0) AS new_classes, coalesce(f.n, 0) AS new_fields FROM (SELECT DISTINCT unit FROM u) LEFT JOIN c USING (unit) LEFT JOIN f USING (unit)""")
def induction_novelty(spark: SparkSession, d: str) -> DataFrame:
    return induce.novelty(table(spark, d, "part").select(F.col("p_size").alias("unit"), F.col("p_brand").alias("cls"), F.col("p_name").alias("field")))


@query("""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT item_id FROM (SELECT b.item_id, CAST(b.item_id AS BIGINT) AS document, b.text FROM benchmark b) JOIN t ON t.doc_id = document WHERE contains(t, lower(text))""")
def grounded_identity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("document"), F.array("text").alias("examples"))
    return induce.grounded_identity(c, table(spark, d, "documents").select(F.col("doc_id").alias("document"), "text")).select("item_id")


@query("SELECT page_id, CASE WHEN length(url) > 2048 THEN 'too long' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' ELSE NULL END AS problem FROM pages")
def url_problems(spark: SparkSession, d: str) -> DataFrame:
    from .sources.detect import url_problem

    return table(spark, d, "pages").select("page_id", url_problem("url").alias("problem"))


@query("SELECT event_id, 'json' AS kind FROM events")
def json_kinds(spark: SparkSession, d: str) -> DataFrame:
    from .sources.detect import json_kind

    return table(spark, d, "events").select("event_id", json_kind("props").alias("kind"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT 'p' || p AS target, min('s' || s) AS home, count(*) AS n FROM e GROUP BY p HAVING count(*) >= 2""")
def multiply_referenced(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("HAS").alias("label"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return ontology.multiply_referenced(e)


@query("SELECT doc_id, 0 AS chunk_id, length(text) AS chars, 'document' AS resolution FROM documents")
def document_ledgers(spark: SparkSession, d: str) -> DataFrame:
    return chunk.document_ledger(table(spark, d, "documents"), "doc_id").select("doc_id", "chunk_id", F.length("text").alias("chars"), "resolution")


@query("""
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def full_texts(spark: SparkSession, d: str) -> DataFrame:
    from .sources.files import full_text

    return full_text(table(spark, d, "conversations").withColumnRenamed("turn", "page_no"), "conv_id")


@query("SELECT c_custkey, '{\"id\":\"c' || c_custkey || '\",\"label\":\"Customer\",\"__class__\":\"Customer\",\"name\":\"' || c_name || '\"}' AS json FROM customer")
def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    from .sinks.files import node_objects

    n = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("class"), F.create_map(F.lit("name"), "c_name").alias("attrs"))
    return node_objects(Graph(n, n)).select(F.expr("bigint(substring(node_id, 2))").alias("c_custkey"), "json")


@query("SELECT 'n' || n_nationkey AS id, 'Nation' AS label, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier")
def csv_nodes(spark: SparkSession, d: str) -> DataFrame:
    from .sinks.files import wide_nodes

    return wide_nodes(geography(spark, d))
