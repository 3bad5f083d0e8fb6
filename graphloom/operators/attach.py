"""Skeleton rows of batches to one tree of instances: handles, merging, and the ladder that finds parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .provenance import unique_containment

CARRY = 12


def resolve_handles(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (document, batch, i, path, ids, p) with parent_path and parent_ids: p is the handle i of a row of the same batch, or a negative one of known (document, handle, path, ids)."""
    own = rows.select("document", "batch", F.col("i").alias("p"), F.col("path").alias("parent_path"), F.col("ids").alias("parent_ids"))
    out = rows.join(own, ["document", "batch", "p"], "left")
    if known is not None:
        k = known.select("document", F.col("handle").alias("p"), F.col("path").alias("__kp"), F.col("ids").alias("__ki"))
        out = out.join(k, ["document", "p"], "left").withColumn("parent_path", F.coalesce("parent_path", "__kp")).withColumn("parent_ids", F.coalesce("parent_ids", "__ki")).drop("__kp", "__ki")
    return out


def merge_batches(rows: DataFrame, scope: list[str], key: str = "key") -> DataFrame:
    """One row an identity key: its first emission by (batch, pos) with all columns, all its batches, and the chunks of its first batch. rows: (scope..., key, batch, pos, chunk_id, ...)."""
    first = F.struct("batch", "pos")
    w = Window.partitionBy(*scope, key)
    low = rows.withColumn("__b", F.min("batch").over(w))
    rest = [c for c in rows.columns if c not in (*scope, key, "batch", "pos", "chunk_id")]
    return low.groupBy(*scope, key).agg(*(F.min_by(c, first).alias(c) for c in rest), F.array_sort(F.collect_set("batch")).alias("batches"), F.array_sort(F.collect_set(F.when(F.col("batch") == F.col("__b"), F.col("chunk_id")))).alias("chunk_ids"))


def by_path(skeleton: DataFrame) -> DataFrame:
    """(path, items): the rows of a path as structs in their order."""
    rest = [c for c in skeleton.columns if c not in ("path", "pos")]
    return skeleton.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *rest))), lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias("items"))


def adjacent(rows: DataFrame, partition: list[str], order: str, is_parent: Column, value: Column | str) -> Column:
    """The value of the nearest row before, or at, each that is a parent: an as-of join as a window."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(is_parent, v), ignorenulls=True).over(w)


def chunk_owners(chunks: DataFrame, mentions: DataFrame, carry: int = CARRY) -> DataFrame:
    """(document, chunk_id, owner, how): the parent that alone is mentioned in the head of the chunk; else the one mentioned alone anywhere in it; else that of the last chunk before with a head owner, at most carry chunks back.

    chunks: (document, chunk_id); mentions: (document, chunk_id, owner, in_head).
    """
    alone = lambda c: F.when(F.size(c) == 1, c[0])
    m = mentions.groupBy("document", "chunk_id").agg(alone(F.collect_set(F.when(F.col("in_head"), F.col("owner")))).alias("head"), alone(F.collect_set("owner")).alias("any"))
    c = chunks.select("document", "chunk_id").distinct().join(m, ["document", "chunk_id"], "left")
    w = Window.partitionBy("document").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("head").isNotNull(), F.struct("chunk_id", "head")), ignorenulls=True).over(w)
    c = c.withColumn("l", last).withColumn("carried", F.when(F.col("chunk_id") - F.col("l.chunk_id") <= carry, F.col("l.head")))
    how = F.when(F.col("head").isNotNull(), "head").when(F.col("any").isNotNull(), "mention").when(F.col("carried").isNotNull(), "carried")
    return c.select("document", "chunk_id", F.coalesce("head", "any", "carried").alias("owner"), how.alias("how")).filter("owner is not null")


def attach(children: DataFrame, parents: DataFrame, owners: DataFrame | None = None, required: bool = False) -> tuple[DataFrame, DataFrame]:
    """Children (document, child, parent_path, parent_key, parent_text, chunk_ids, batch, pos, single) with (parent, rung), and the placeholders (document, path, parent) made for them.

    The first rung that holds: the root path; the parent of that key; the only instance of the path; the one whose text contains or lies in parent_text; the one that shares a chunk, then a batch; the one owner of its chunks; for single children without parent_text the nearest parent before it in its batch; a placeholder from parent_text, or one for all without. With required, children that would need a placeholder are dropped: their parent is null and the rung 'dropped'.

    parents: (document, path, parent, key, text, chunk_ids, batch, pos).
    """
    p = parents.withColumnRenamed("path", "parent_path")
    on = ["document", "parent_path"]
    one = lambda d, name: d.groupBy("document", "child").agg(F.collect_set("parent").alias("s")).filter(F.size("s") == 1).select("document", "child", F.col("s")[0].alias(name))
    c = children
    exact = c.join(p.select(*on, F.col("key").alias("parent_key"), F.col("parent").alias("exact")), [*on, "parent_key"], "left").groupBy("document", "child").agg(F.min("exact").alias("exact"))
    only = p.groupBy(*on).agg(F.collect_set("parent").alias("s")).filter(F.size("s") == 1).select(*on, F.col("s")[0].alias("only"))
    fuzzy = unique_containment(c.filter("parent_text is not null").select(*on, F.col("child").alias("left"), F.col("parent_text").alias("text")), p.select(*on, F.col("parent").alias("right"), "text"), on).select("document", F.col("left").alias("child"), F.col("right").alias("fuzzy")).distinct()
    cc = c.select("document", "child", "parent_path", F.explode("chunk_ids").alias("chunk"))
    pc = p.select(*on, "parent", F.explode("chunk_ids").alias("chunk"))
    chunk = one(cc.join(pc, [*on, "chunk"]), "chunk_parent")
    batch = one(c.select(*on, "child", "batch").join(p.select(*on, "parent", "batch"), [*on, "batch"]), "batch_parent")
    both = c.select("document", "parent_path", "batch", "pos", "child", F.lit(None).cast("string").alias("parent")).unionByName(p.select("document", "parent_path", "batch", "pos", F.lit(None).cast(dict(c.dtypes)["child"]).alias("child"), F.col("parent").cast("string")))
    near = both.withColumn("near", adjacent(both, ["document", "parent_path", "batch"], "pos", F.col("parent").isNotNull(), "parent")).filter("child is not null").select("document", "child", "near")
    out = c.join(exact, ["document", "child"], "left").join(only, on, "left").join(fuzzy, ["document", "child"], "left").join(chunk, ["document", "child"], "left").join(batch, ["document", "child"], "left").join(near, ["document", "child"], "left")
    if owners is not None:
        o = one(cc.join(owners.select("document", F.col("chunk_id").alias("chunk"), F.col("owner").alias("parent")), ["document", "chunk"]), "anchored")
        out = out.join(o, ["document", "child"], "left")
    else:
        out = out.withColumn("anchored", F.lit(None).cast("string"))
    out = out.withColumn("near", F.when(F.col("single") & F.col("parent_text").isNull(), F.col("near")))
    made = F.concat(F.lit("placeholder|"), "parent_path", F.lit("|"), F.coalesce("parent_text", F.lit("")))
    rungs = [("exact", "exact"), ("only", "single"), ("fuzzy", "fuzzy"), ("chunk_parent", "chunk"), ("batch_parent", "batch"), ("anchored", "anchor"), ("near", "adjacent")]
    parent = F.when(F.col("parent_path") == "", F.lit(""))
    rung = F.when(F.col("parent_path") == "", F.lit("root"))
    for name, label in rungs:
        parent = parent.when(F.col(name).isNotNull(), F.col(name).cast("string"))
        rung = rung.when(F.col(name).isNotNull(), F.lit(label))
    last = F.lit(None).cast("string") if required else made
    out = out.select(*c.columns, parent.otherwise(last).alias("parent"), rung.otherwise(F.lit("dropped") if required else F.when(F.col("parent_text").isNotNull(), "placeholder").otherwise("bucket")).alias("rung"))
    return out, out.filter("rung in ('placeholder', 'bucket')").select("document", F.col("parent_path").alias("path"), "parent").distinct()


def reference_handles(entities: DataFrame, partition: list[str], order: str, most: int = 50) -> DataFrame:
    """The newest entities, numbered -1, -2, ... from the newest."""
    w = Window.partitionBy(*partition).orderBy(F.desc(order))
    return entities.withColumn("handle", -F.row_number().over(w)).filter(F.col("handle") >= -most)


def uncovered(chunks: DataFrame, anchored: DataFrame, share: float = 0.1) -> DataFrame:
    """(document, chunk_id, token_count) of chunks that nothing came from, of documents where they have the share of the tokens at least."""
    none = chunks.join(anchored.select("document", "chunk_id"), ["document", "chunk_id"], "left_anti").select("document", "chunk_id", "token_count")
    total = chunks.groupBy("document").agg(F.sum("token_count").alias("t"))
    w = Window.partitionBy("document")
    return none.withColumn("u", F.sum("token_count").over(w)).join(total, "document").filter(F.col("u") >= share * F.col("t")).select("document", "chunk_id", "token_count")


def growth_cap(new: DataFrame, before: DataFrame, factor: int = 2) -> DataFrame:
    """Of new rows (path, pos, ...) as many of each path, in order, as let it grow to factor times what before (path) has."""
    n = before.groupBy("path").agg(F.count("*").alias("had"))
    w = Window.partitionBy("path").orderBy("pos")
    return new.join(n, "path", "left").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.coalesce(F.col("had"), F.lit(0)) * (factor - 1)).drop("k", "had")


def reconcile(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (document, path, id, parent, chunk_ids) after merging ids of groups (document, id, survivor); a pair with a common chunk is vetoed. Parents follow. Second: (document, id, survivor, outcome)."""
    a = rows.select("document", "id", F.col("path").alias("pa"), F.col("chunk_ids").alias("ca"))
    b = rows.select("document", F.col("id").alias("survivor"), F.col("path").alias("pb"), F.col("chunk_ids").alias("cb"))
    g = groups.join(a, ["document", "id"]).join(b, ["document", "survivor"])
    outcome = F.when(F.col("pa") != F.col("pb"), "other path").when(F.arrays_overlap("ca", "cb"), "co-occurrence veto").otherwise("merged")
    report = g.select("document", "id", "survivor", outcome.alias("outcome"))
    m = report.filter("outcome = 'merged'")
    kept = rows.join(m.select("document", "id"), ["document", "id"], "left_anti")
    to = m.select("document", F.col("id").alias("parent"), F.col("survivor").alias("__s"))
    return kept.join(to, ["document", "parent"], "left").withColumn("parent", F.coalesce("__s", "parent")).select(*rows.columns), report
