"""Joins by ranges and by time, sets of groupings, set operations, estimates, and search by attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .build import Graph


def range_join(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, width: float, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Each row of points with each row of spans for which low <= at <= high, and keys equal: an equality join on bins of the width.

    A span stands in each bin it touches, so width should be about a usual span. A point has one bin, so no pair comes twice. Numbers, or timestamps with the width in seconds. how: inner, left (points without a span stay), left_semi or left_anti. at, low and high null match nothing. No other columns than keys may have one name on both sides.
    """
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if dict(df.dtypes)[c].startswith("timestamp") else F.col(c).cast("double")
    bin_of = lambda x: F.floor(x / F.lit(float(width))).cast("long")
    keys = keys or []
    p = points.withColumn("__bin", bin_of(number(points, at)))
    inside = F.col(low) <= F.col(high)
    s = spans.filter(inside).withColumn("__bin", F.explode(F.sequence(bin_of(number(spans, low)), bin_of(number(spans, high)))))
    s = s.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (p[k] == s[f"__{k}"] for k in keys), p["__bin"] == s["__bin"])
    out = p.join(s, on & (p[at] >= s[low]) & (p[at] <= s[high]), how)
    return out.drop(p["__bin"]).drop(*(f"__{k}" for k in keys)) if how in ("left_semi", "left_anti") else out.drop(p["__bin"]).drop(s["__bin"]).drop(*(f"__{k}" for k in keys))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance: str | None = None) -> DataFrame:
    """left with the value of the latest row of right that has its keys and isn't later; null where there is none, or none within the tolerance, an interval.

    Both sides are sorted together once by key and time, with no pairs. At one instant right comes before left. Of rows of right at one instant the greatest value stands.
    """
    order = Window.partitionBy(*keys).orderBy(at, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.struct(*rest).alias("__row") if rest else F.lit(1).alias("__row"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__value"))
    kind = a.schema["__row"].dataType
    b = right.select(*keys, at, F.lit(None).cast(kind).alias("__row"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    both = a.unionByName(b)
    last = F.last(F.when(F.col("__side") == 0, F.struct(F.col(at).alias("t"), F.col("__value").alias("v"))), ignorenulls=True).over(order)
    out = both.withColumn("__last", last).filter("__side = 1")
    found = F.col("__last.v") if tolerance is None else F.when(F.col("__last.t") + F.expr(f"interval {tolerance}") >= F.col(at), F.col("__last.v"))
    return out.select(*keys, at, *(F.col(f"__row.`{c}`").alias(c) for c in rest), found.alias(value))


def grouped(df: DataFrame, columns: list[str], aggregates: list[Column], how: str = "rollup", sets: list[list[str]] | None = None) -> DataFrame:
    """Aggregates by rollup, cube, or the given sets, with the column `level`: the bits of the columns that a row is summed over."""
    if how not in ("rollup", "cube", "sets"):
        raise ValueError(how)
    if how == "sets":
        g = df.groupingSets([[F.col(c) for c in s] for s in sets or []], *columns)
    else:
        g = df.rollup(*columns) if how == "rollup" else df.cube(*columns)
    return g.agg(F.grouping_id().alias("level"), *aggregates)


def estimates(df: DataFrame, keys: list[str], counted: str, measured: str, shares: tuple[float, ...] = (0.5, 0.9), error: float = 0.02) -> DataFrame:
    """(keys..., distinct, quantiles) by HyperLogLog and quantile sketches: one pass with sketches of a fixed size, however many values."""
    return df.groupBy(*keys).agg(F.approx_count_distinct(counted, error).alias("distinct"), F.percentile_approx(measured, list(shares), int(1 / error**2)).alias("quantiles"))


def set_operation(a: DataFrame, b: DataFrame, kind: str, every: bool = False) -> DataFrame:
    """union, intersect or except of rows, by the names of a's columns; every keeps repeated rows as often as SQL's ALL does."""
    b = b.select(*a.columns)
    if kind == "union":
        return a.union(b) if every else a.union(b).distinct()
    if kind == "intersect":
        return a.intersectAll(b) if every else a.intersect(b)
    if kind == "except":
        return a.exceptAll(b) if every else a.subtract(b)
    raise ValueError(kind)


def find(g: Graph, where: dict[str, str], cls: str | None = None, fold: bool = False) -> DataFrame:
    """The nodes that have these values of attributes; fold compares as identities are."""
    from ..functions.text import fold_id

    out = g.nodes if cls is None else g.nodes.filter(F.col("class") == cls)
    for k, v in where.items():
        value = F.col("attrs")[k]
        out = out.filter(fold_id(value) == fold_id(F.lit(v)) if fold else value == v)
    return out


def batch_summary(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, nodes, classes, edges, labels) of each document of a batch, documents without edges too. nodes: (key, node_id, class), edges: (key, src, dst, label)."""
    n = nodes.groupBy(key).agg(F.count("*").alias("nodes"), F.count_distinct("class").alias("classes"))
    e = edges.groupBy(key).agg(F.count("*").alias("edges"), F.count_distinct("label").alias("labels"))
    return n.join(e, key, "left").na.fill(0, ["edges", "labels"])
