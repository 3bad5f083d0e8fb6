"""Joins of documents by their sets of word n-grams.

Documents with equal sets form a class, for which its lowest id stands. Each class then
gets K keys from its grams; classes that agree in a key meet in that key's room. First
only marks go to the rooms: the keys of earlier slots, which tell who has met before, and
a parity bitmap, which bounds from above how many grams two sets share. Both are exact:
who has no partner left there that could be similar enough needn't come. The texts of the
others go to these rooms alone, where a function of the operator finds the pairs.

A room isn't one task: its classes are dealt into as many blocks of BLOCK_GRAMS grams as
it has, and a task holds two blocks. No pair leaves a task. What leaves it is, for every
class, the number of its links there and the lowest id that it is connected with there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._prefixes import candidates, levels, prefixes, whole_rooms
from ._stage import BROADCAST_BYTES, importable, sized, split, staged
from ._text import give_back, gram_sets, slices

#: keys(sets) -> uint64 array of K keys, a row for each set.
Keys = Callable[[list[np.ndarray]], np.ndarray]
#: others(i) -> places of sets that i is to be compared with.
Others = Callable[[int], np.ndarray]
#: pairs(sets, others, t) -> (i, found), i ascending: found are those of others(i), all below i, whose Jaccard similarity with i is t at least. No i without any.
Pairs = Callable[[list[np.ndarray], Others, float], Iterator[tuple[int, np.ndarray]]]

#: A block of a room has about so many grams; a task holds two blocks at a time.
BLOCK_GRAMS = 2_000_000
#: In rooms of up to so many classes all marks are compared in one array operation, many rooms at a time.
SMALL = 24
#: What a row of numbers weighs in a broadcast.
ROW_BYTES = 40

_MARK = "room long, part long, slot int, rep long, one long, side boolean, size int, keys array<long>"


def parity(sets: list[np.ndarray]) -> list[bytes]:
    """For each set the parities of the numbers of its grams in w cells, w the least power of two of 64 and three times the size at least.

    Two bitmaps differ in at most as many bits as the sets differ in grams. Halves laid over each other by XOR give the bitmap of half the width.
    """
    width = np.array([max(64, 1 << (3 * len(s) - 1).bit_length()) for s in sets], np.int64)
    begin = np.cumsum(width) - width
    size = np.array([len(s) for s in sets])
    cell = (np.concatenate(sets) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(begin, size)
    packed = np.packbits((np.bincount(cell, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little")
    return [packed[a : a + w].tobytes() for a, w in zip((begin // 8).tolist(), (width // 8).tolist())]


class Marks:
    """Sizes and parity bitmaps of sets, and what they say of pairs."""

    def __init__(self, size: np.ndarray, bits: list[bytes], t: float):
        self.size, self.t = size.astype(np.int64), t
        words = np.array([len(b) // 8 for b in bits], np.int64)
        self.kind = np.log2(np.maximum(words, 1)).astype(np.int64)
        self.row = np.zeros(len(bits), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for k in np.unique(self.kind).tolist():
            at = np.flatnonzero(self.kind == k)
            self.row[at] = np.arange(len(at))
            self.of[k] = np.frombuffer(b"".join(bits[i] for i in at.tolist()), np.uint64).reshape(len(at), 1 << k)

    def able(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (a, b) may be similar enough; the others surely aren't."""
        x, y = self.size[a], self.size[b]
        out = np.minimum(x, y) >= self.t * np.maximum(x, y) - 1e-9
        need = np.ceil(self.t / (1 + self.t) * (x + y) - 1e-9)
        a, b = np.where(self.kind[a] >= self.kind[b], a, b), np.where(self.kind[a] >= self.kind[b], b, a)
        of = self.kind[a] * 64 + self.kind[b]
        for kinds in np.unique(of[out]).tolist():
            k, l = divmod(kinds, 64)
            at = np.flatnonzero(out & (of == kinds))
            for c in range(0, len(at), 4096):
                p = at[c : c + 4096]
                wide = self.of[k][self.row[a[p]]]
                if k > l:
                    wide = np.bitwise_xor.reduce(wide.reshape(len(p), 1 << (k - l), 1 << l), axis=1)
                apart = np.bitwise_count(wide ^ self.of[l][self.row[b[p]]]).sum(axis=1, dtype=np.int64)
                out[p] = (x[p] + y[p] - apart) // 2 >= need[p]
        return out


def unmet(keys: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of others that agree with i in none of the keys; keys has a row for each earlier slot."""
    for k in keys:
        if not len(others):
            break
        others = others[k[others] != k[i]]
    return others


def needed(marks: Marks, at: int, keys: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Of the len(keys[0]) rows from `at` on, a room, those that have any partner which is new to them and may be similar enough. side: if given, partners are of different sides."""
    m = keys.shape[1]
    size = marks.size[at : at + m]
    order = np.argsort(size, kind="stable")
    in_order = size[order]
    low = np.searchsorted(in_order, marks.t * in_order - 1e-9)
    out = np.zeros(m, bool)
    for k in range(1, m):
        i = int(order[k])
        others = order[low[k] : k]
        if side is not None:
            others = others[side[others] != side[i]]
        for c in range(0, len(others), 2048):
            part = others[c : c + 2048]
            if out[i]:  # then only those matter that have no partner yet
                part = part[~out[part]]
            part = unmet(keys, i, part)
            if len(part):
                part = part[marks.able(np.full(len(part), at + i), at + part)]
            if len(part):
                out[i] = True
                out[part] = True
    return out


def _runs(*columns: np.ndarray) -> list[int]:
    if not len(columns[0]):
        return [0]
    edge = np.zeros(len(columns[0]) - 1, bool)
    for x in columns:
        edge |= x[1:] != x[:-1]
    return [0, *(np.flatnonzero(edge) + 1).tolist(), len(columns[0])]


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by the column; a group may lie in several batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = b[column].to_numpy(zero_copy_only=False)
        if held and held[-1][column][0].as_py() != x[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = _runs(x)
        for a, c in zip(at[:-2], at[1:-1]):
            yield pa.Table.from_batches([*held, b.slice(a, c - a)])
            held = []
        held.append(b.slice(at[-2]))
    if held:
        yield pa.Table.from_batches(held)


def classes(docs: DataFrame, n: int, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, copies), a row for each document and its set, rep the lowest id that has the set, copies whether another has it; and (rep, one, size, keys, bits), a row for each set, with a sum of its hashes. Documents without a word have no set and no row."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = gram_sets(b["text"], n)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                sets = [sets[i] for i in some]
                k = keys(sets)
                two = np.array([int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7))) ^ len(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].take(pa.array(some)),
                        pa.array(_sums(sets)),
                        pa.array(two.view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.view(np.int64).ravel())),
                        pa.array(parity(sets), pa.binary()),
                    ],
                    ["doc_id", "one", "two", "size", "keys", "bits"],
                )
        give_back()

    profiled = docs.mapInArrow(profile, "doc_id long, one long, two long, size int, keys array<long>, bits binary")
    found = staged(profiled.withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct("doc_id", "row"))
    own = found.groupBy("one", "two").agg(first.alias("first"), (F.max("doc_id") > F.min("doc_id")).alias("copies"))
    of = staged(found.select("doc_id", "one", "two", "row").join(own, ["one", "two"]).select("doc_id", F.col("first.doc_id").alias("rep"), "copies", "row", (F.col("row") == F.col("first.row")).alias("own")))
    gone = of.filter("not own").select("row")
    number = gone.count()
    reps = found.join(sized(gone, number, ROW_BYTES), "row", "left_anti").select(F.col("doc_id").alias("rep"), "one", "size", "keys", "bits")
    if number * ROW_BYTES > BROADCAST_BYTES:
        reps = staged(reps)  # else it is a scan
    return of.select("doc_id", "rep", "copies").distinct(), reps


def _sums(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)


def similar(docs: DataFrame, n: int, t: float, keys: Keys, pairs: Pairs, block_grams: int = BLOCK_GRAMS, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Staged (rep, root, links): in some room, rep has so many links and is connected with root; and the members (doc_id, rep, copies) of classes. A pair of classes has its link in one room, the first in which it meets. whole: pairs that agree in no key are found too, see _rest."""
    importable(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    members, reps = classes(own, n, keys)

    opened = reps.select("rep", "size", F.posexplode("keys").alias("slot", "key")).select("rep", "size", "slot", F.xxhash64("slot", "key").alias("room"))
    rooms = opened.groupBy("room").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).filter("m > 1")
    rooms = rooms.select("room", F.ceil(F.col("grams") / block_grams).cast("int").alias("blocks"))
    shared = opened.select("rep", "slot", "room").join(rooms, "room")
    seated = staged(shared.groupBy("rep").agg(F.collect_list(F.struct("room", "slot", "blocks")).alias("at")))  # of one id, K for each of its sets at most
    some = split(reps, F.col("rep"), seated.select("rep"), seated.count())[0]
    at = seated.join(some, "rep").select("rep", "one", "size", "keys", "bits", F.inline("at"))
    at = at.filter(F.xxhash64("slot", F.col("keys")[F.col("slot")]) == F.col("room"))  # where an id has several sets, each to its own rooms
    block = F.pmod(F.xxhash64("rep", "one"), F.col("blocks"))
    dealt = at.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    entered = dealt.select("room", (low * F.lit(1 << 32) + high).alias("part"), "slot", "rep", "one", (F.col("block") == low).alias("side"), "size", F.expr("slice(keys, 1, slot)").alias("keys"), "bits")

    met = _met(entered, own, n, t, pairs)
    return (met.unionByName(_rest(met, members, reps, own, n, t, pairs, block_grams)) if whole else met), members


def _rest(met: DataFrame, members: DataFrame, reps: DataFrame, own: DataFrame, n: int, t: float, pairs: Pairs, block_grams: int) -> DataFrame:
    """Staged (rep, root, links) of all similar pairs that agree in no key, whatever the keys. Who is connected by met has a room in common, where those meet that agree in none of all keys. Others are candidates of the prefix filter, each in a room of its lower id, on the one side, with its partners on the other."""
    parts = staged(components(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep"))
    inside = reps.join(parts, "rep")
    blocks = inside.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).filter("m > 2").select("root", F.ceil(F.col("grams") / block_grams).cast("int").alias("blocks"))
    dealt = inside.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("rep", "one"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    within = dealt.select(F.col("root").alias("room"), (low * F.lit(1 << 32) + high).alias("part"), F.lit(0).alias("slot"), "rep", "one", (F.col("block") == low).alias("side"), "size", "keys", "bits")

    gone = staged(members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own")).filter("not own").select("doc_id"))
    texts = split(own, F.col("doc_id"), gone, gone.count())[1]
    found = staged(prefixes(texts, n, t, levels(texts, n)))
    found = found.join(parts, "rep", "left").withColumn("part", F.coalesce("root", "rep"))
    asked = staged(candidates(found, t).select(F.col("a").alias("room"), F.col("b").alias("rep")))
    partner = asked.join(reps, "rep")
    blocks = partner.groupBy("room").agg(F.ceil(F.sum("size") / block_grams).cast("int").alias("blocks"))
    none = F.array().cast("array<long>").alias("keys")
    one = blocks.withColumn("part", F.explode(F.expr("sequence(1L, blocks)"))).withColumn("rep", F.col("room")).join(reps, "rep")
    one = one.select("room", "part", F.lit(1).alias("slot"), "rep", "one", F.lit(True).alias("side"), "size", none, "bits")
    partner = partner.join(blocks, "room").select("room", (F.pmod(F.xxhash64("rep", "one"), F.col("blocks")) + 1).alias("part"), F.lit(1).alias("slot"), "rep", "one", F.lit(False).alias("side"), "size", none, "bits")
    return _met(within.unionByName(one).unionByName(partner), own, n, t, pairs)


def _met(entered: DataFrame, own: DataFrame, n: int, t: float, pairs: Pairs) -> DataFrame:
    """Staged (rep, root, links) of the rooms that are entered."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_rooms(batches):
            keep = _kept(g, t)
            if keep.any():
                yield from g.drop_columns(["bits"]).filter(pa.array(keep)).combine_chunks().to_batches()
        give_back()

    seats = staged(entered.repartition("room", "part").sortWithinPartitions("room", "part", "slot").mapInArrow(assign, _MARK))
    taken = seats.count()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seated_here: dict[tuple, tuple] = {}  # by id and set
        held: dict[tuple, tuple] = {}  # rows may repeat
        out: list[tuple] = []
        now = None

        def close() -> None:
            if len(held) > 1:
                out.extend(_linked(list(held.values()), now[1] >> 32 != now[1] & 0xFFFFFFFF, pairs, t))
            held.clear()
            seated_here.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["rep", "root", "links"])

        for batch in batches:
            for b in slices(batch):
                sets = gram_sets(b["text"], n)
                sums, one, sides = _sums(sets).tolist(), b["one"].to_pylist(), b["side"].to_pylist()
                rows = zip(b["room"].to_pylist(), b["part"].to_pylist(), b["slot"].to_pylist())
                for i, (rep, row, row_keys) in enumerate(zip(b["rep"].to_pylist(), rows, _lists(b["keys"]))):
                    if row != now:
                        close()
                        now = row
                        if len(out) > 50_000:
                            yield flush()
                    if one[i] is not None:  # a seat; a room's seats come before its texts
                        seated_here[rep, one[i]] = (rep, sides[i], row_keys.copy())
                    elif (rep, sums[i]) in seated_here:  # else another text of the same id
                        held.setdefault((rep, sums[i]), (*seated_here[rep, sums[i]], sets[i]))
        close()
        if out:
            yield flush()
        give_back()

    going = seats.select("room", "part", "slot", "rep").distinct()
    texts = own.select(F.col("doc_id").alias("rep"), "text")
    if taken * ROW_BYTES > BROADCAST_BYTES:  # then texts are joined by a shuffle, but no others than those
        who = staged(seats.select("rep").distinct())
        texts = split(texts, F.col("rep"), who, who.count())[0]
    sent = texts.join(sized(going, taken, ROW_BYTES), "rep").unionByName(seats.drop("size"), allowMissingColumns=True)
    met = sent.repartition("room", "part").sortWithinPartitions("room", "part", "slot", F.col("text").isNotNull()).mapInArrow(meet, "rep long, root long, links long")
    return staged(met)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, without a copy; none where it is null."""
    length = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(length)])
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _kept(g: pa.Table, t: float) -> np.ndarray:
    """Which rows of whole rooms have a partner there."""
    marks = Marks(g["size"].to_numpy(), g["bits"].to_pylist(), t)
    side, part = np.asarray(g["side"].to_numpy(), bool), g["part"].to_numpy()
    across = (part >> 32) != (part & 0xFFFFFFFF)
    column = g["keys"].chunk(0)
    flat, length = column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)
    begin = np.cumsum(length) - length
    at = np.asarray(_runs(g["room"].to_numpy(), part, g["slot"].to_numpy()))
    first, m = at[:-1], np.diff(at)
    keep = np.zeros(g.num_rows, bool)
    for size in np.unique(m[(m > 1) & (m <= SMALL)]).tolist():
        x, y = np.triu_indices(size, 1)
        starts = first[m == size]
        for c in range(0, len(starts), max(1, 100_000 // len(x))):
            some = starts[c : c + max(1, 100_000 // len(x))]
            a, b = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
            ok = ~across[a] | (side[a] != side[b])
            a, b = a[ok], b[ok]
            for k in range(int(length[a].max(initial=0))):
                has = length[a] > k
                same = np.zeros(len(a), bool)
                same[has] = flat[begin[a[has]] + k] == flat[begin[b[has]] + k]
                a, b = a[~same], b[~same]
            if len(a):
                ok = marks.able(a, b)
                keep[a[ok]] = keep[b[ok]] = True
    for a, k in zip(first[m > SMALL].tolist(), m[m > SMALL].tolist()):
        keys = flat[begin[a] : begin[a] + k * length[a]].reshape(k, length[a]).T.copy()
        keep[a : a + k] = needed(marks, a, keys, side[a : a + k] if across[a] else None)
    return keep


def _linked(rows: list[tuple], across: bool, pairs: Pairs, t: float) -> Iterator[tuple[int, int, int]]:
    """(rep, root, links) of a room's rows (rep, side, keys, set); across: pairs are of different sides only."""
    rows = sorted(rows, key=lambda r: (not r[1], r[0]) if across else r[0])
    ids = np.array([r[0] for r in rows])
    keys = np.stack([r[2] for r in rows]).T.copy()
    m = len(rows)
    fore = sum(r[1] for r in rows) if across else 0

    def others(i: int) -> np.ndarray:
        below = np.arange(min(i, fore) if across and i >= fore else 0 if across else i)
        below = below[ids[below] != ids[i]]
        return unmet(keys, i, below)

    links, group = np.zeros(m, np.int64), np.arange(m)
    for i, found in pairs([r[3] for r in rows], others, t):
        links[i] += len(found)
        links[found] += 1
        roots = np.unique(group[found])
        group[i] = roots[0]
        if len(roots) > 1:
            group[np.isin(group, roots[1:])] = roots[0]
    at = np.flatnonzero(links)
    lowest = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group[at], ids[at])
    return zip(ids[at].tolist(), lowest[group[at]].tolist(), links[at].tolist())


def groups(met: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, class_id, group_id, links) of all documents that are similar to another, one row for each.

    class_id is the lowest id of a document with the same set of n-grams, group_id the lowest that a chain of links leads to, links the number of other classes that the document's class is linked with. A doc_id with several texts has the lowest ids of all and the sum of the links.
    """
    total = met.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = total.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    rows = members.join(linked, "rep", "left").filter("copies or links is not null")
    return rows.groupBy("doc_id").agg(F.min("rep").alias("class_id"), F.min(F.coalesce("root", "rep")).alias("group_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): root is the lowest id that it is connected with. By alternating large and small stars, each round written. A star's centre is joined with its rays, so no task holds all of them."""

    def marks(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        rays = both.join(low, "u")
        if large:
            return rays.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        out = rays.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()

    e = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    before = None
    while (now := marks(e)) != before:
        before = now
        e = staged(star(star(e, True), False))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
