"""Extraction held against truth: precision, recall, F1, completeness, grounding, and figures over many runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digit_signature, fold_id
from .build import Graph
from .clean import content


def prf(tp: Column | str = "tp", fp: Column | str = "fp", fn: Column | str = "fn") -> list[Column]:
    """precision, recall and f1, rounded to 3 places; 0 where undefined."""
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f1")]


def strict(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1) of sets of (class, key)."""
    a = truth.select("class", "key").distinct().withColumn("t", F.lit(1))
    b = got.select("class", "key").distinct().withColumn("g", F.lit(1))
    j = a.join(b, ["class", "key"], "full")
    n = j.groupBy("class").agg(F.count(F.when(F.col("t").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fn"))
    return n.select("*", *prf())


def micro(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select("*", *prf())


def edge_prf(truth: DataFrame, got: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """As strict, by label, of edges (label, src, dst), after got's ends are folded onto the truth's by aliases (key, truth_key)."""
    if aliases is not None:
        for end in ("src", "dst"):
            m = aliases.select(F.col("key").alias(end), F.col("truth_key").alias("__to"))
            got = got.join(m, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    shape = lambda e: e.select(F.col("label").alias("class"), F.concat_ws("\x1f", "src", "dst").alias("key"))
    return strict(shape(truth), shape(got)).withColumnRenamed("class", "label")


def relaxed_pairs(truth: DataFrame, got: DataFrame) -> DataFrame:
    """(class, truth_key, key): of what isn't equal, pairs of which one folded text contains the other, with the same runs of digits, each key in one pair at most: greedily by class in the order of the truth's keys, where exactly one is left that fits. truth and got: (class, key, text).

    Who contains whom is found by joins; only the pairs that fit go to a class's task.
    """
    from .alias import contained
    from .stats import written

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for k, fits in pdf.sort_values(["truth_key", "key"]).groupby("truth_key", sort=True)["key"]:
            free = [g for g in fits if g not in taken]
            if len(free) == 1:
                taken.add(free[0])
                out.append((pdf["class"].iloc[0], k, free[0]))
        return pd.DataFrame(out, columns=["class", "truth_key", "key"])

    shape = lambda d: d.select("class", F.col("key").alias("id"), fold_id("text").alias("text"), F.array_join(digit_signature("text"), ",").alias("d"))
    a = written(shape(truth.join(got.select("class", "key"), ["class", "key"], "left_anti")))
    b = written(shape(got.join(truth.select("class", "key"), ["class", "key"], "left_anti")))
    inside = contained(a, b, ["class", "d"]).select("class", F.col("inner").alias("truth_key"), F.col("outer").alias("key"))
    around = contained(b, a, ["class", "d"]).select("class", F.col("outer").alias("truth_key"), F.col("inner").alias("key"))
    return inside.unionByName(around).distinct().groupBy("class").applyInPandas(greedy, "class string, truth_key string, key string")


def similarity(a: dict, b: dict) -> float:
    """Overlap of attributes: 1 for each equal one, 1/2 for each of which one contains the other."""
    total = 0.0
    for k in a.keys() & b.keys():
        x, y = (str(v).strip().lower() for v in (a[k], b[k]))
        total += 1.0 if x == y else 0.5 if x and y and (x in y or y in x) else 0.0
    return total


def aligned_pairs(truth: DataFrame, got: DataFrame, least: float = 1.0) -> DataFrame:
    """(class, truth_key, key, score): one-to-one by the overlap of attributes, the best first, then by keys. truth and got: (class, key, attrs)."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        pairs = [(-s, a, b) for a, p in zip(x["key"], x["attrs"]) for b, q in zip(y["key"], y["attrs"]) if (s := similarity(dict(p), dict(q))) >= least]
        left, right, out = set(), set(), []
        for s, a, b in sorted(pairs):
            if a not in left and b not in right:
                left.add(a), right.add(b)
                out.append((x["class"].iloc[0], a, b, -s))
        return pd.DataFrame(out, columns=["class", "truth_key", "key", "score"])

    kind = "class string, truth_key string, key string, score double"
    return truth.select("class", "key", "attrs").groupBy("class").cogroup(got.select("class", "key", "attrs").groupBy("class")).applyInPandas(run, kind)


def fill_rates(g: Graph, fields: dict[str, list[str]]) -> DataFrame:
    """(class, nodes, mean_fill, filled map) of the declared fields of each class."""
    out = None
    for cls, names in fields.items():
        if not names:
            continue
        full = [F.coalesce(F.trim(F.col("attrs")[n]) != "", F.lit(False)).cast("int") for n in names]
        one = g.nodes.filter(F.col("class") == cls).agg(F.count("*").alias("nodes"), F.avg(sum(full[1:], full[0]) / len(names)).alias("mean_fill"), F.create_map(*(x for n, f in zip(names, full) for x in (F.lit(n), F.coalesce(F.sum(f), F.lit(0))))).alias("filled"))
        one = one.select(F.lit(cls).alias("class"), "nodes", "mean_fill", "filled")
        out = one if out is None else out.unionByName(one)
    return out


def grounding(values: DataFrame, chunks: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., checked, found, share): of the values of a scope those that a chunk of it has word by word, white space joined, case ignored."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    v = values.select(*scope, norm("value").alias("v")).filter("v <> ''")
    t = chunks.groupBy(*scope).agg(F.collect_list(norm("text")).alias("t"))
    j = v.join(t, scope, "left").withColumn("ok", F.coalesce(F.exists("t", lambda x: F.contains(x, F.col("v"))), F.lit(False)))
    return j.groupBy(*scope).agg(F.count("*").alias("checked"), F.count(F.when(F.col("ok"), 1)).alias("found"), F.avg(F.col("ok").cast("double")).alias("share"))


def synthetic_classes(found: DataFrame) -> DataFrame:
    """Classes of which fewer than half of the identifiers are found in the source. found: (class, found)."""
    return found.groupBy("class").agg(F.avg(F.col("found").cast("double")).alias("share")).filter("share < 0.5")


def cell_summary(runs: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """The means of the figures and the number of runs for each cell."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *(F.avg(f).alias(f"mean_{f}") for f in figures))


def completeness_rate(c: Column | str) -> Column:
    """filled / expected over a map class -> map field -> struct(filled, expected)."""
    c = F.col(c) if isinstance(c, str) else c
    cells = F.flatten(F.transform(F.map_values(c), F.map_values))
    total = lambda f: F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x[f])
    return F.when(total("expected") > 0, total("filled") / total("expected")).otherwise(0.0)


def over_discovered(counts: DataFrame, factor: float = 5.0, least: int = 3) -> DataFrame:
    """Paths with more than factor times the upper median of the counts, if there are `least` paths without the root. counts: (path, n); a row for each path of a template, so one task sorts them."""
    c = counts.filter("path <> ''")
    m = c.agg(F.array_sort(F.collect_list("n")).alias("a")).filter(F.size("a") >= least).select(F.expr("element_at(a, int(size(a) / 2) + 1)").alias("median"))
    return c.crossJoin(F.broadcast(m)).filter(F.col("n") > factor * F.col("median"))


def audit(findings: DataFrame) -> DataFrame:
    """(kind, n) of findings (kind)."""
    return findings.groupBy("kind").agg(F.count("*").alias("n"))


def report(per_document: DataFrame) -> DataFrame:
    """(class, documents, nodes, mean_fill) over documents' rows (document, class, nodes, mean_fill)."""
    return per_document.groupBy("class").agg(F.count_distinct("document").alias("documents"), F.sum("nodes").alias("nodes"), F.avg("mean_fill").alias("mean_fill"))


def integrity(g: Graph) -> DataFrame:
    """One row: dangling ends, phantom nodes, self loops."""
    from .clean import dangling, phantoms

    d = dangling(g).agg(F.count("*").alias("dangling"))
    p = phantoms(g).agg(F.count("*").alias("phantoms"))
    s = g.edges.agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"))
    return d.crossJoin(p).crossJoin(s)


def attribute_texts(g: Graph) -> DataFrame:
    """(node_id, class, key, value) of the content attributes."""
    return g.nodes.select("node_id", "class", F.explode(content()).alias("key", "value"))
