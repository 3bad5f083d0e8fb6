"""Written tables that cut lineage, and broadcasts behind a check of size."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix

#: Tables of at most so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bits of a Bloom filter at most, 32 MB, whatever the number of keys. With more keys than a tenth of it more rows pass it, and the join behind it has more to do.
BLOOM_BITS = 1 << 28


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver found it."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{home}:{env.get('PYTHONPATH', '')}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where that is unset a folder of this machine will do in local mode alone, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            at = given.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark.sparkContext.setCheckpointDir(at)
            given = spark.sparkContext._jsc.sc().getCheckpointDir()
            at = given.get() if given.isDefined() else at
    return f"{at.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later steps survive the loss of any executor without computing it anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str) -> DataFrame:
    """df and the place of each row in it, a long that ascends: in the order in which they were written if df is a Parquet table, whose readers take files by size, else in that of df's rows. Places of a whole table are 0, 1 and so on. A row for each file comes to the driver."""
    try:
        at = df.metadataColumn("_metadata")
        file, row = fresh(df, "__file"), fresh(df, "__row")
        d = df.select("*", at.getField("file_path").alias(file), at.getField("row_index").alias(row))
    except AnalysisException:  # not a Parquet table
        return df.withColumn(name, F.monotonically_increasing_id())
    before, rows = 0, []
    found = d.groupBy(file).agg(F.max(row).alias("last")).collect()
    for path, last in sorted(found, key=lambda r: _part(r[0])):
        rows.append((path, before))
        before += last + 1
    base = fresh(d, "__before")
    begin = F.broadcast(df.sparkSession.createDataFrame(rows, f"{file} string, {base} long"))
    return d.join(begin, file).select(*(d[f"`{c}`"] for c in df.columns), (F.col(base) + F.col(row)).alias(name))


def _part(path: str) -> tuple[str, int, str]:
    """Sorts the files of a table as their tasks were numbered, which have five digits or more."""
    folder, _, file = path.rpartition("/")
    number = re.match(r"part-(\d+)", file)
    return folder, int(number[1]) if number else -1, file


def clean(spark: SparkSession) -> None:
    """Deletes what this application staged; for when its results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sized(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df to be broadcast if rows of row_bytes are within the limit, else unchanged, so that a shuffle joins it."""
    return F.broadcast(df) if rows * row_bytes <= limit else df.hint("merge")


def split(df: DataFrame, key: Column, found: DataFrame, number: int, limit: int = BROADCAST_BYTES, bits: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key, a long, is in the one column of found, and all others, those of a null key among them. number: of found's rows, which are distinct.

    found is broadcast if it is within the limit. Else a Bloom filter of it is, of a fixed size at most, and only rows that pass that are shuffled, to be joined with found.
    """
    name = fresh(df, "__key")
    d, f = df.withColumn(name, key), found.toDF(name)
    if number * 16 <= limit:
        return d.join(F.broadcast(f), name, "left_semi").drop(name), d.join(F.broadcast(f), name, "left_anti").drop(name)
    maybe = fresh(d, "__maybe")
    passes = _bloom(f, number, bits)
    d = d.withColumn(maybe, F.coalesce(passes(F.col(name)), F.lit(False)))
    near = d.filter(F.col(maybe))
    inside, apart = (near.join(f.hint("merge"), name, how).drop(name, maybe) for how in ("left_semi", "left_anti"))
    return inside, d.filter(~F.col(maybe)).drop(name, maybe).unionByName(apart)


def _bloom(keys: DataFrame, number: int, bits: int):
    """A function that says of a column of longs which may be among keys."""
    size = min(bits, 1 << max(12, math.ceil(math.log2(max(1, number) * 10))))

    def places(x: np.ndarray) -> list[np.ndarray]:
        h = mix(x.astype(np.int64).view(np.uint64))
        return [(mix(h + np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in range(3)]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(b.column(0).to_numpy())))
            word, begin = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    importable(keys.sparkSession)
    table = keys.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row for each word of the filter at most
    packed = np.zeros(size >> 6, np.int64)
    packed[table["word"].to_numpy()] = table["mask"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def passes(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        x = s.fillna(0).to_numpy(dtype=np.int64)
        for at in places(x):
            known &= (shared.value[at >> 6] >> (at & 63)) & 1 > 0
        return pd.Series(known)

    return passes


def shuffle_parts(spark: SparkSession, total_bytes: float, each: int = 32 << 20) -> int:
    """So many partitions that one has about each bytes, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each))
