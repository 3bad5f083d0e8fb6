"""Chunks, batches and windows of texts.

A token is a word between white space unless a counter is given. Splitting is greedy,
so where a cut falls depends on the cut before it; it runs over Arrow batches of whole
documents, each for itself, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS = 512
#: Characters of chunks that a worker holds until it hands them on.
_HELD = 1 << 20
_ENDS = re.compile(r"(?<=[.!?])\s+|\n\n|\n")

Counter = Callable[[str], int]


def word_count(text: str) -> int:
    return max(1, len(text.split()))


def split_chars(text: str, limit: int, count: Counter) -> list[str]:
    """Halves until every piece is within the limit, or one character long."""
    if count(text) <= limit or len(text) < 2:
        return [text]
    return split_chars(text[: len(text) // 2], limit, count) + split_chars(text[len(text) // 2 :], limit, count)


def pack(parts: list[str], limit: int, count: Counter) -> list[str]:
    """Greedily joins parts by a space while they are within the limit."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    additive = count is word_count
    for p in parts:
        n = count(p) if additive else count(" ".join([*held, p]))
        if held and (total + n if additive else n) > limit:
            out.append(" ".join(held))
            held, total = [p], count(p)
        else:
            held.append(p)
            total = total + n if additive else n
    return [*out, " ".join(held)] if held else out


def split_text(text: str | None, limit: int = CHUNK_TOKENS, count: Counter = word_count) -> list[str]:
    """The whole text if it is within the limit; else sentences and lines packed greedily, those that are too long split by words, then by characters. Null and blank texts have no chunk."""
    if not text or not text.strip():
        return []
    if count(text) <= limit:
        return [text]
    parts: list[str] = []
    for s in _ENDS.split(text):
        if not s.strip():
            continue
        if count(s) <= limit:
            parts.append(s.strip())
        else:
            for w in pack(s.split(), limit, count):
                parts += [w] if count(w) <= limit else split_chars(w, limit, count)
    return pack(parts, limit, count)


def chunks(docs: DataFrame, key: str, text: str = "text", limit: int = CHUNK_TOKENS, count: Counter = word_count) -> DataFrame:
    """(key, chunk_id, text, token_count, char_length, text_hash) of every document's chunks."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (of, pa.int32(), pa.string(), pa.int32(), pa.int32()))], [key, "chunk_id", "text", "token_count", "char_length"])

        for frame in frames:
            keys, texts = frame.columns
            rows, held = [], 0
            for k, t in zip(keys, texts):  # one text at a time, whatever a frame holds
                k = k.as_py()
                for i, c in enumerate(split_text(t.as_py(), limit, count)):
                    rows.append((k, i, c, count(c), len(c)))
                    held += len(c)
                    if held > _HELD:
                        yield made(rows, keys.type)
                        rows, held = [], 0
            if rows:
                yield made(rows, keys.type)

    out = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).filter("__k is not null").mapInArrow(run, f"`{key}` {kind}, chunk_id int, text string, token_count int, char_length int")
    return out.withColumn("text_hash", F.hex(F.xxhash64("text")))


def chunk_stats(chunked: DataFrame, key: str) -> DataFrame:
    """(key, chunks, tokens, average, largest) a document."""
    return chunked.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("average"), F.max("token_count").alias("largest"))


def batch_numbers(sizes: Column, limit: int) -> Column:
    """Of an array of token counts the array of batch numbers: a chunk opens a batch where the budget would be exceeded. In the JVM, as a fold."""
    n = lambda x: F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["batch"] < 0) | (acc["used"] + n(x) > limit)
        b = F.when(opens, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(F.when(opens, n(x)).otherwise(acc["used"] + n(x)).alias("used"), b.alias("batch"), F.concat(acc["out"], F.array(b)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def batches(chunked: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, chunk_id, batch): consecutive chunks of a document under a budget of tokens."""
    g = chunked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "token_count"))).alias("c"))
    g = g.withColumn("b", batch_numbers(F.transform("c", lambda x: x["token_count"]), limit))
    return g.select(key, F.inline(F.arrays_zip(F.transform("c", lambda x: x["chunk_id"]).alias("chunk_id"), F.col("b").alias("batch"))))


def window_starts(total: Column | str, budget: int, most: int | None = None) -> Column:
    """Starts of evenly spaced windows of budget characters, as few as cover the text, at most so many if most is given; one at 0 if the text is within the budget."""
    t = F.col(total) if isinstance(total, str) else total
    n = F.ceil(t / F.lit(float(budget)))
    n = F.greatest(F.lit(1), n if most is None else F.least(F.lit(most), n)).cast("int")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * (t - budget) / F.greatest(n - 1, F.lit(1))).cast("int"))
    return F.when(n <= 1, F.array(F.lit(0))).otherwise(even)


def windows(docs: DataFrame, key: str, budget: int, most: int | None = None, text: str = "text") -> DataFrame:
    """(key, window, start, text) of each document."""
    w = docs.select(key, F.col(text).alias("__t"), F.posexplode(window_starts(F.length(text), budget, most)).alias("window", "start"))
    return w.select(key, "window", "start", F.substring(F.col("__t"), F.col("start") + 1, F.lit(budget)).alias("text"))


def sample_text(text: str, budget: int) -> str:
    """Within the budget: 60 % of it from the head, 20 % from the tail, and of the middle its headings and table rows as far as the rest goes."""
    if len(text) <= budget:
        return text
    head, tail = text[: budget * 6 // 10], text[len(text) - budget * 2 // 10 :]
    room, lines = budget - len(head) - len(tail), []
    for line in text[len(head) : len(text) - len(tail)].splitlines():
        if re.match(r"\s*(#|\||<h\d)", line) and len(line) + 1 <= room:
            lines.append(line)
            room -= len(line) + 1
    return "\n".join([head, *lines, tail])


def sampled(docs: DataFrame, key: str, budget: int, text: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else sample_text(t, budget))

    return docs.select(key, cut(F.col(text)).alias("text"))


def document_ledger(docs: DataFrame, key: str, pages: Column | None = None) -> DataFrame:
    """One chunk 0 that covers each document."""
    return docs.select(key, F.lit(0).alias("chunk_id"), "text", (pages if pages is not None else F.array(F.lit(0))).alias("pages"), F.lit("document").alias("resolution"))


def parse_geometry(c: Column | str) -> Column:
    """JSON entries [{ref, page, box}] as structs; those without a page or with a box that isn't four numbers go."""
    parsed = F.from_json(c, "array<struct<ref:string,page:int,box:array<double>>>")
    return F.coalesce(F.filter(parsed, lambda g: g["page"].isNotNull() & (F.size(g["box"]) == 4) & ~F.exists(g["box"], lambda x: x.isNull())), F.array().cast("array<struct<ref:string,page:int,box:array<double>>>"))
