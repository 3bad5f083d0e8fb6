"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, fill blocks of `block_bytes`. Block i
of a source with weight w is released in slot floor(i / w) and due by slot
ceil((i + 1) / w). Each slot takes the released block with the earliest deadline (PD2's
order among equal ones), so that after every slot each source has had its weight of
them, less than one block away. Weights are multiples of 1 / period, so the schedule
repeats after `period` slots: one period is laid out on the driver, and a block's slot
follows from its number. Nothing on the driver grows with the documents.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._stage import fresh, sized, staged

BLOCK_BYTES = 1 << 16
PERIOD = 1000
#: Buckets of a source by hash, in which its bytes are summed up apart.
BUCKETS = 4096


def apportion(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source, in proportion to its weight by largest remainders, at least one each for a positive weight."""
    some = {s: Fraction(w) for s, w in weights.items() if w and w > 0}
    if not some:
        return {}
    if len(some) > period:
        raise ValueError(f"{len(some)} sources need a period of as many slots")
    total = sum(some.values())
    share = {s: max(Fraction(1), w * period / total) for s, w in some.items()}
    out = {s: floor(x) for s, x in share.items()}
    order = sorted(some, key=lambda s: (out[s] - share[s], s))
    while sum(out.values()) < period:
        for s in order[: period - sum(out.values())]:
            out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) for one period. Ties of deadlines: first the block whose window overlaps the next one's (PD2's b-bit), then the later group deadline (of heavy sources), then the source's name."""
    period = sum(slots.values())
    done = dict.fromkeys(slots, 0)
    out = []

    def group_deadline(s: str, i: int) -> int:
        if 2 * slots[s] < period or slots[s] == period:
            return 0
        return ceil(Fraction(ceil(Fraction(ceil(Fraction((i + 1) * period, slots[s])) * (period - slots[s]), period)) * period, period - slots[s]))

    for t in range(period):
        ready = []
        for s, w in slots.items():
            i = done[s]
            if i < w and i * period // w <= t:
                due = ceil(Fraction((i + 1) * period, w))
                overlap = (i + 1) * period % w != 0
                ready.append((due, not overlap, -group_deadline(s, i), s))
        if not ready:
            raise AssertionError("weights sum to 1, so a block is always released")
        s = min(ready)[-1]
        out.append((s, done[s], t))
        done[s] += 1
    return out


def slots_for(weights: dict[str, float], period: int) -> int:
    """The period, or as many slots as there are sources with a weight, if those are more."""
    return max(period, sum(1 for w in weights.values() if w and w > 0))


def _source(c: str = "source") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, source, key, block): documents of a source by the hash of their id fill block after block; a document belongs to the block in which its first byte lies. Null sources are the source ''."""
    key = F.md5(F.col("doc_id").cast("string"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).filter("doc_id is not null")
    d = d.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("bytes").alias("bytes")).withColumn("key", key)
    d = d.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    # bytes before a bucket from sums by bucket, of which there are a fixed number; within a bucket by a window over its rows alone
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "bucket").agg(F.sum("bytes").alias("sum")).select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(sums, ["source", "bucket"])
    return d.select("doc_id", "source", "key", F.expr(f"(before + within) div {block_bytes}").alias("block"))


def sources(docs: DataFrame) -> list[str]:
    """The sources, '' for null; a row for each comes to the driver."""
    return sorted(r.source for r in docs.filter("doc_id is not null").select(_source().alias("source")).distinct().collect())


def source_bytes(docs: DataFrame) -> dict[str, int]:
    """Bytes of each source; a row for each source comes to the driver."""
    d = docs.filter("doc_id is not null").groupBy(_source().alias("source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"))
    return {r.source: r.b for r in d.collect()}


def target_weights(docs: DataFrame, exponent: float) -> dict[str, float]:
    """Weights in proportion to the sources' bytes to the power exponent: 1 keeps the proportions, 0 makes sources equal."""
    return {s: float(max(b, 1)) ** exponent for s, b in source_bytes(docs).items()}


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, period: int = PERIOD) -> DataFrame:
    """(doc_id, source, block, slot) of all documents whose source has a weight: sorted by slot, documents come in proportion to the weights.

    weights: by source, all equal if None. Documents of sources without a weight and rows without doc_id are left out. All blocks have slots: sources that are longer than their weight asks go on after others have ended. See horizon for where the first ends. Rows that repeat a doc_id count once.
    """
    spark = docs.sparkSession
    if weights is None:
        weights = dict.fromkeys(source_bytes(docs), 1.0)
    period = slots_for(weights, period)
    slots = apportion(weights, period)
    rows = [(s, slots[s], i, t) for s, i, t in schedule(slots)] if slots else []
    plan = F.broadcast(spark.createDataFrame(rows, "source string, per int, nth int, at int"))  # one row a slot of the period, whatever the documents
    b = blocks(docs, block_bytes)
    per = F.broadcast(spark.createDataFrame(list(slots.items()), "source string, per int"))
    b = b.join(per, "source").withColumn("nth", (F.col("block") % F.col("per")).cast("int"))
    return b.join(plan, ["source", "per", "nth"]).select("doc_id", "source", "block", F.expr(f"(block div per) * {period} + at").alias("slot"))


def horizon(docs: DataFrame, weights: dict[str, float], block_bytes: int = BLOCK_BYTES, period: int = PERIOD) -> dict[str, int]:
    """Blocks of each source that come before the first slot for which its source has no full block left."""
    period = slots_for(weights, period)
    slots = apportion(weights, period)
    full = {s: b // block_bytes for s, b in source_bytes(docs).items() if s in slots}
    if not full:
        return {}
    at = {(s, i): t for s, i, t in schedule(slots)}
    end = min((full.get(s, 0) // n) * period + at[s, full.get(s, 0) % n] for s, n in slots.items())
    return {s: (end // period) * n + sum(at[s, i] < end % period for i in range(n)) for s, n in slots.items()}


def to_weights(docs: DataFrame, weights: dict[str, float], block_bytes: int = BLOCK_BYTES, period: int = PERIOD) -> DataFrame:
    """The documents whose blocks are scheduled before any source runs out: their sources' bytes are in proportion to the weights, less than a block away. Columns stay. Rows without doc_id or of sources without weight go."""
    ends = horizon(docs, weights, block_bytes, period)
    b = blocks(docs, block_bytes)
    limit = F.broadcast(docs.sparkSession.createDataFrame(list(ends.items()), "source string, blocks long"))
    name, end = fresh(docs, "__source"), fresh(docs, "__last")
    # the last document of each source, a row for each; documents are told by it without a shuffle of their texts
    last = b.join(limit, "source").filter("block < blocks").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias(end)).withColumnRenamed("source", name)
    rows = last.collect()
    last = F.broadcast(docs.sparkSession.createDataFrame(rows, last.schema))
    own = F.struct(F.md5(F.col("doc_id").cast("string")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    return docs.filter("doc_id is not null").join(last, (_source() == F.col(name)) & (own <= F.col(end)), "left_semi")


def scheduled(docs: DataFrame, weights: dict[str, float], block_bytes: int = BLOCK_BYTES, period: int = PERIOD) -> DataFrame:
    """All rows of docs in the order of the schedule: as long as sources last, every beginning of it is in proportion to the weights. Columns stay. A source that ends, however small, takes no other source's documents along. Rows without doc_id or of sources without weight come last."""
    doc, slot = fresh(docs, "__doc"), fresh(docs, "__slot")
    slots = staged(mixed(docs, weights, block_bytes, period).select(F.col("doc_id").alias(doc), F.col("slot").alias(slot)))
    d = docs.join(sized(slots, slots.count(), 40), docs["doc_id"].cast("long") == F.col(doc), "left")
    return d.orderBy(F.col(slot).asc_nulls_last(), F.md5(F.col("doc_id").cast("string"))).select(*(docs[f"`{c}`"] for c in docs.columns))
