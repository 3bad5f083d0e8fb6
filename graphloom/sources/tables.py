"""Tables by format: files of any kind that Spark reads, databases, topics, and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = ("parquet", "orc", "csv", "json", "text", "avro", "xml")


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options) -> DataFrame:
    """A table from files at path, from a database's table (jdbc: path is its address, the option dbtable its name), or from a topic (kafka: path is the servers, the option subscribe the topic; the drivers must be on the class path)."""
    r = spark.read.format(kind).options(**options)
    if kind == "jdbc":
        return r.option("url", path).load()
    if kind == "kafka":
        return r.option("kafka.bootstrap.servers", path).load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")
    if kind not in FILES:
        raise ValueError(kind)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, kind: str, path: str, partition_by: list[str] | None = None, **options) -> None:
    """Replaces what is at path."""
    if kind not in FILES:
        raise ValueError(kind)
    df.write.format(kind).options(**options).partitionBy(*(partition_by or [])).mode("overwrite").save(path)


def save_table(df: DataFrame, name: str, buckets: int = 0, keys: list[str] | None = None, statistics: bool = True) -> DataFrame:
    """df as a table of the catalog, bucketed and sorted by keys if buckets are given, so that joins on them need no shuffle, with statistics for the optimizer."""
    w = df.write.mode("overwrite").format("parquet")
    if buckets and keys:
        w = w.bucketBy(buckets, *keys).sortBy(*keys)
    w.saveAsTable(name)
    spark = df.sparkSession
    if statistics:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)


def statistics(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """(column, distinct_count, null_count, rows) as ANALYZE TABLE stored them: a row for each named column."""
    rows = []
    size = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Statistics'").first()
    count = int(size.data_type.rpartition(", ")[2].split()[0]) if size and "rows" in size.data_type else None
    for c in columns:
        d = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} {c}").collect()}
        rows.append((c, *(int(d[k]) if d.get(k, "NULL") != "NULL" else None for k in ("distinct_count", "num_nulls")), count))
    return spark.createDataFrame(rows, "column string, distinct_count long, null_count long, rows long")
