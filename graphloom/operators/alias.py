"""Aliases: proposed by containment, applied only when confirmed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import digit_signature, fuzzy_similarity
from .build import Graph
from .clean import content
from .stats import written

MIN_LENGTH = 4


def contained(inner: DataFrame, outer: DataFrame, on: list[str]) -> DataFrame:
    """(on..., inner, outer): ids of texts of which the one is a substring of the other, equal ones too. inner and outer: (on..., id, text); empty and null texts are in none.

    An equality join: outer texts are looked up by their substrings of up to MIN_LENGTH characters, an inner one by that of its own substrings which the fewest outer texts have, so no common one brings all pairs.
    """
    grams = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, n)))
    every = F.flatten(F.array(*(F.when(F.length("text") >= n, grams(F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, MIN_LENGTH + 1))))
    o = outer.filter("text <> ''").select(*on, F.col("id").alias("outer"), F.col("text").alias("whole"), F.explode(every).alias("gram"))
    many = o.groupBy(*on, "gram").agg(F.count("*").alias("many"))
    own = inner.filter("text <> ''").select(*on, F.col("id").alias("inner"), F.col("text").alias("part"), F.explode(grams(F.least(F.length("text"), F.lit(MIN_LENGTH)))).alias("gram"))
    # a substring that no outer text has rules the inner text out
    found = own.join(many, [*on, "gram"], "left").groupBy(*on, "inner", "part").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram")).alias("least")).filter("least.many > 0")
    rare = found.select(*on, "inner", "part", F.col("least.gram").alias("gram"))
    return o.join(rare, [*on, "gram"]).filter(F.contains(F.col("whole"), F.col("part"))).select(*on, "inner", "outer")


def containment(texts: DataFrame, group: list[str]) -> DataFrame:
    """(group..., superset, base): in each group the texts that contain exactly one other, shorter one of at least four characters with the same runs of digits. texts: (group..., id, text), text folded."""
    t = texts.filter(F.length("text") >= MIN_LENGTH).select(*group, "id", "text", F.array_join(digit_signature("text"), ",").alias("digits"))
    size = t.select(*group, "id", F.length("text").alias("n")).distinct()
    pair = contained(t, t, [*group, "digits"]).filter("inner <> outer").select(*group, F.col("outer").alias("superset"), F.col("inner").alias("base")).distinct()
    # of equal length are equal texts only
    pair = pair.join(size.withColumnsRenamed({"id": "superset", "n": "a"}), [*group, "superset"]).join(size.withColumnsRenamed({"id": "base", "n": "b"}), [*group, "base"]).filter("b < a")
    return pair.select(*group, "superset", "base").distinct().withColumn("n", F.count("*").over(Window.partitionBy(*group, "superset"))).filter("n = 1").drop("n")


def propose(g: Graph, identities: dict[str, list[str]]) -> DataFrame:
    """(class, superset, base, similarity) among the nodes of one class by their folded identities."""
    from ..functions.text import canonical_id

    parts = None
    for cls, fields in identities.items():
        if fields:
            text = F.concat_ws("", *(canonical_id(f, F.col("attrs")[f]) for f in fields))
            shown = F.concat_ws(" / ", *(F.col("attrs")[f] for f in fields))
            one = g.nodes.filter(F.col("class") == cls).select("class", F.col("node_id").alias("id"), F.lower(text).alias("text"), shown.alias("shown"))
            parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return g.nodes.sparkSession.createDataFrame([], "class string, superset string, base string, similarity double")
    parts = written(parts)  # read several times
    c = written(containment(parts.drop("shown"), ["class"]))
    s = parts.select("id", "shown")
    return c.join(s.select(F.col("id").alias("superset"), F.col("shown").alias("a")), "superset").join(s.select(F.col("id").alias("base"), F.col("shown").alias("b")), "base").select("class", "superset", "base", fuzzy_similarity("a", "b").alias("similarity"))


def siblings(g: Graph, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a neighbour under one label, in one direction: they stand side by side, so they aren't the same."""
    out = pairs.join(g.edges.select(F.col("dst").alias("a"), F.col("src").alias("near"), "label"), "a").join(g.edges.select(F.col("dst").alias("b"), F.col("src").alias("near"), "label"), ["b", "near", "label"]).select("a", "b")
    back = pairs.join(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("near"), "label"), "a").join(g.edges.select(F.col("src").alias("b"), F.col("dst").alias("near"), "label"), ["b", "near", "label"]).select("a", "b")
    return out.unionByName(back).distinct()


def applied(g: Graph, proposals: DataFrame, confirmed: DataFrame) -> tuple[Graph, DataFrame]:
    """Merges the confirmed (a, b) that were proposed, in either order, and that no sibling vetoes: the richer node survives, of equal ones the first. A node that is merged into several goes to the least pair's. Second: (a, b, outcome) of every confirmation."""
    from .clean import redirect

    either = proposals.select(F.col("superset").alias("a"), F.col("base").alias("b")).unionByName(proposals.select(F.col("base").alias("a"), F.col("superset").alias("b")))
    c = confirmed.select("a", "b").distinct()
    known = c.join(either.distinct().withColumn("proposed", F.lit(True)), ["a", "b"], "left")
    known = known.join(siblings(g, c).withColumn("sibling", F.lit(True)), ["a", "b"], "left")
    outcome = F.when(F.col("proposed").isNull(), "not proposed").when(F.col("sibling").isNotNull(), "sibling veto").otherwise("merged")
    report = known.select("a", "b", outcome.alias("outcome"))
    rich = g.nodes.select("node_id", F.size(content()).alias("rich"), "pos")
    m = report.filter("outcome = 'merged'").join(rich.select(F.col("node_id").alias("a"), F.col("rich").alias("ra"), F.col("pos").alias("pa")), "a").join(rich.select(F.col("node_id").alias("b"), F.col("rich").alias("rb"), F.col("pos").alias("pb")), "b")
    first = (F.col("ra") > F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("pa") <= F.col("pb")))
    ids = m.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("node_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("survivor")).groupBy("node_id").agg(F.min("survivor").alias("survivor"))
    # a survivor that is merged itself passes its own on; a superset has one base only, so chains have two links at most
    ids = ids.alias("x").join(ids.alias("y"), F.col("x.survivor") == F.col("y.node_id"), "left").select("x.node_id", F.coalesce("y.survivor", "x.survivor").alias("survivor"))
    n = g.nodes.join(ids, "node_id", "left").withColumn("own", F.col("survivor").isNull()).withColumn("to", F.coalesce("survivor", "node_id"))
    order = F.struct((~F.col("own")).alias("o"), "pos")
    one = n.groupBy("to").agg(F.min_by("class", order).alias("class"), F.min_by("pos", order).alias("pos"), F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("node_id")))).alias("merged"))
    values = n.select("to", order.alias("o"), F.explode(content()).alias("key", "value")).groupBy("to", "key").agg(F.min_by("value", "o").alias("value"))
    attrs = values.groupBy("to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    nodes = one.join(attrs, "to", "left").select(F.col("to").alias("node_id"), "class", "pos", F.when(F.size("merged") > 0, F.map_concat(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.create_map(F.lit("aliases"), F.to_json("merged")))).otherwise(F.col("attrs")).alias("attrs"))
    return Graph(nodes, redirect(g.edges, ids)), report


def fuzzy_merge(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(path, id, survivor): greedy in order, within a path; a row joins the first kept one that is similar enough and has the same runs of digits. rows: (path, id, pos, text)."""
    import difflib
    import re

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, str, tuple]] = []
        out = []
        for r in pdf.sort_values("pos").itertuples():
            text = " ".join(sorted((r.text or "").lower().split()))
            digits = tuple(re.findall(r"\d+", text))
            to = next((i for i, t, d in kept if d == digits and difflib.SequenceMatcher(None, t, text, autojunk=False).ratio() >= threshold), None)
            if to is None:
                kept.append((r.id, text, digits))
            out.append((r.path, r.id, to or r.id))
        return pd.DataFrame(out, columns=["path", "id", "survivor"])

    return rows.select("path", "id", "pos", "text").groupBy("path").applyInPandas(run, "path string, id string, survivor string")
