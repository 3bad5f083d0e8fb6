"""More registered queries: joins by ranges and time, grouping sets, set operations, estimates, functions by name, formats, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relational, stats
from .queries import _TRADE, query, table, trade
from .sources import tables


@query("SELECT a.p_partkey AS part, b.p_partkey AS near FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_retailprice BETWEEN a.p_retailprice - 2 AND a.p_retailprice + 2")
def price_neighbours(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    spans = p.select("p_brand", F.col("p_partkey").alias("part"), (F.col("p_retailprice") - 2).alias("low"), (F.col("p_retailprice") + 2).alias("high"))
    points = p.select("p_brand", F.col("p_partkey").alias("near"), F.col("p_retailprice").alias("price"))
    return relational.range_join(points, "price", spans, "low", "high", 4.0, ["p_brand"]).select("part", "near")


@query("SELECT p.event_id AS purchase, e.event_id AS before FROM events p JOIN events e ON p.event_type = 'purchase' AND e.user_id = p.user_id AND e.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts")
def before_purchases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.expr("ts - interval 1 hour").alias("since"), F.col("ts").alias("until"))
    return relational.range_join(e.select("user_id", F.col("event_id").alias("before"), "ts"), "ts", spans, "since", "until", 3600.0, ["user_id"]).select("purchase", "before")


@query("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM customer WHERE abs(c_acctbal - p_retailprice) <= 1)")
def parts_without_balance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select((F.col("c_acctbal") - 1).alias("low"), (F.col("c_acctbal") + 1).alias("high"))
    return relational.range_join(table(spark, d, "part"), "p_retailprice", c, "low", "high", 2.0, how="left_anti").select("p_partkey")


@query("SELECT a.event_id, b.event_id AS view FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def last_view(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    return relational.asof_join(e.select("user_id", "ts", "event_id"), views, ["user_id"], "ts", "view").select("event_id", "view")


@query("SELECT a.event_id, CASE WHEN a.ts <= b.ts + INTERVAL 30 MINUTE THEN b.value END AS value FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def recent_click(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return relational.asof_join(e.select("user_id", "ts", "event_id"), e.filter("event_type = 'click'"), ["user_id"], "ts", "value", "30 minutes").select("event_id", "value")


_SETS = "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY "


def _grouped(spark: SparkSession, d: str, how: str, sets: list[list[str]] | None = None) -> DataFrame:
    return relational.grouped(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")], how, sets)


@query(_SETS + "ROLLUP (l_returnflag, l_linestatus)")
def lines_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "rollup")


@query(_SETS + "CUBE (l_returnflag, l_linestatus)")
def lines_cube(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "cube")


@query(_SETS + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def lines_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, "sets", [["l_returnflag"], ["l_linestatus"]])


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS parts_near, true AS median_near FROM lineitem GROUP BY 1")
def estimated(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of parts, and whether the estimates of it and of the median price are within a tenth."""
    l = table(spark, d, "lineitem")
    exact = l.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.median("l_extendedprice").alias("m"))
    e = relational.estimates(l, ["l_returnflag"], "l_partkey", "l_extendedprice")
    near = lambda a, b: F.abs(a - b) <= F.abs(b) / 10
    return exact.join(e, "l_returnflag").select("l_returnflag", "parts", near(F.col("distinct"), F.col("parts")).alias("parts_near"), near(F.col("quantiles")[0], F.col("m")).alias("median_near"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def users_intersect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return relational.set_operation(e.filter("event_type = 'purchase'").select("user_id"), e.filter("event_type = 'error'"), "intersect")


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer INTERSECT ALL SELECT n_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)")
def segments_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    every = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).crossJoin(F.broadcast(c.select("segment").distinct()))  # nations and segments, a few each
    return relational.set_operation(c, every, "intersect", every=True)


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def users_except(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return relational.set_operation(e.select("user_id"), e.filter("event_type = 'purchase'"), "except")


@query("SELECT user_id FROM events EXCEPT ALL SELECT user_id FROM events WHERE event_type <> 'view'")
def users_except_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return relational.set_operation(e.select("user_id"), e.filter("event_type <> 'view'"), "except", every=True)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def nations_union(spark: SparkSession, d: str) -> DataFrame:
    return relational.set_operation(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "union")


@query("SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def found_nodes(spark: SparkSession, d: str) -> DataFrame:
    return relational.find(trade(spark, d), {"segment": "building"}, "Customer", fold=True).select("node_id")


@query(_TRADE + ", k AS (SELECT substr(src, 1, 1) AS batch, count(*) AS edges, count(DISTINCT label) AS labels FROM edges GROUP BY 1) SELECT substr(node_id, 1, 1) AS batch, count(*) AS nodes, count(DISTINCT class) AS classes, coalesce(any_value(edges), 0) AS edges, coalesce(any_value(labels), 0) AS labels FROM nodes LEFT JOIN k ON batch = substr(node_id, 1, 1) GROUP BY 1")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    g = trade(spark, d)
    return relational.batch_summary(g.nodes.withColumn("batch", F.substring("node_id", 1, 1)), g.edges.withColumn("batch", F.substring("src", 1, 1)), "batch")


# -- functions by name


@query("SELECT event_type, round(sum(value * (event_id + 1)) / sum(event_id + 1), 4) AS mean FROM events GROUP BY 1")
def registered_aggregate(spark: SparkSession, d: str) -> DataFrame:
    from .functions.register import register

    register(spark)
    table(spark, d, "events").createOrReplaceTempView("__graph_events")
    return spark.sql("SELECT event_type, round(graph_weighted_mean(value, event_id + 1), 4) AS mean FROM __graph_events GROUP BY event_type")


@query("SELECT doc_id, CAST(s // 500 AS INTEGER) AS number, CAST(s AS INTEGER) AS start, substr(text, s + 1, 500) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents)")
def registered_table_function(spark: SparkSession, d: str) -> DataFrame:
    from .functions.register import register

    register(spark)
    table(spark, d, "documents").createOrReplaceTempView("__graph_documents")
    return spark.sql("SELECT doc_id, w.number, w.start, w.part FROM __graph_documents, LATERAL graph_windows(text, 500) w")


# -- formats


def _through(spark: SparkSession, df: DataFrame, kind: str, schema: str | None = None, **options) -> DataFrame:
    at = stats.shared(spark)
    tables.write(df, kind, at, **options)
    return tables.read(spark, kind, at, schema, **options)


@query("SELECT * FROM part")
def through_orc(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, table(spark, d, "part"), "orc")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def through_csv(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    return _through(spark, df, "csv", ", ".join(f"{n} {t}" for n, t in df.dtypes), header=True)


@query("SELECT conv_id, turn, role, text FROM conversations")
def through_json(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations")
    return _through(spark, df, "json", ", ".join(f"{n} {t}" for n, t in df.dtypes))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def through_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Written in a folder for each status and read again, the status from the folders' names."""
    at = stats.shared(spark)
    tables.write(table(spark, d, "orders").drop("o_orderdate"), "parquet", at, ["o_orderstatus"])
    return tables.read(spark, "parquet", at).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


# -- streams


def _streamed(spark: SparkSession, d: str, name: str, plan, mode: str) -> DataFrame:
    """What plan makes of the table as a stream, to its end, the last state of it written."""
    at = stats.shared(spark)
    static = table(spark, d, name)
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/{name}.*")  # a pattern, as one file alone is no folder to follow
    out = plan(stream.withColumns({c: F.col(c).cast("timestamp") for c, t in static.dtypes if t == "timestamp_ntz"}))  # as watermarks want it

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query("SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.incremental import windowed

    return _streamed(spark, d, "events", lambda e: windowed(e, "ts", ["event_type"], "1 hour", "1 hour"), "complete").withColumn("begins", F.col("begins").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.incremental import first_seen

    return _streamed(spark, d, "events", lambda e: first_seen(e, ["user_id", "event_type"], "ts", "36500 days").select("user_id", "event_type"), "append")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events")
def stream_parents(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.incremental import running_parents

    return _streamed(spark, d, "events", lambda e: running_parents(e.select("user_id", "event_id", "ts", (F.col("event_type") == "view").alias("view")), "user_id", "ts", "view", "1 hour"), "append")
