"""Byte-level BPE with a vocabulary given as ranks, encoding and decoding.

Pre-tokens are split off by the pattern of the vocabulary. A pre-token's bytes are the
leaves of a segment tree whose nodes hold the leftmost of the least pair ranks below; a
merge takes the root's pair, writes the new rank of the live neighbours and updates
their paths to the root. Pre-tokens of up to 64 bytes are merged many at a time, the
trees side by side in numpy arrays; longer ones have a tree of their own.

Python workers remember words that they met, as many as CACHE at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import importable
from ._text import give_back, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s++"
CACHE = 500_000
#: Bytes of text, and pre-tokens, that are worked on at a time: what a worker holds beside its cache follows from them.
SLICE, TOGETHER = 1 << 18, 4096
_NONE = np.int64(2**31 - 1)
_OTHER_SPACE = re.compile(r"[^\S \n]").search


class Bpe:
    """The ranks of a file of lines "base64 rank"; a token's id is its rank."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile(pattern).findall
        self.spaced = pattern == PATTERN
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.cache = CACHE

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        asked = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where((self.keys[at] == asked) & (left >= 0) & (right >= 0), self.values[at], _NONE)

    def one(self, raw: bytes) -> list[int]:
        """A pre-token of any length: its tree holds rank * size + place, so that the least is the leftmost of the least ranks."""
        n = len(raw)
        ids = self.single[list(raw)].tolist()
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        big = int(_NONE) * size
        tree = [big] * (2 * size)
        get = self.pairs.get
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int) -> None:
            j = after[i]
            r = get(ids[i] << 32 | ids[j]) if j < n else None
            k = size + i
            tree[k] = big if r is None else r * size + i
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] < big:
            rank, i = divmod(tree[1], size)
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            after[j] = n
            put(j), put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in ids if x >= 0]

    def many(self, raws: list[bytes], size: int) -> list[np.ndarray]:
        """Pre-tokens of up to `size` bytes, a power of two, their trees side by side."""
        m = len(raws)
        length = np.array([len(r) for r in raws])
        text = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(m, size)
        ids = np.where(np.arange(size)[None, :] < length[:, None], self.single[text], -1)
        big = _NONE * size
        tree = np.full((m, 2 * size), big, np.int64)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        tree[:, size : 2 * size - 1] = np.where(ranks < _NONE, ranks * size + np.arange(size - 1), big)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        # a place on either side stands for the end
        after = np.broadcast_to(np.arange(1, size + 1), (m, size)).copy()
        before = np.broadcast_to(np.arange(-1, size - 1), (m, size)).copy()

        def put(rows: np.ndarray, i: np.ndarray, r: np.ndarray) -> None:
            k = size + i
            tree[rows, k] = np.where(r < _NONE, r * size + i, big)
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        live = np.flatnonzero(tree[:, 1] < big)
        while len(live):
            rank, i = np.divmod(tree[live, 1], size)
            j = after[live, i]
            ids[live, i], ids[live, j] = rank, -1
            then = after[live, j]
            after[live, i] = then
            inner = then < size
            before[live[inner], then[inner]] = i[inner]
            put(live, j, np.full(len(live), _NONE))
            right = np.where(inner, ids[live, np.minimum(then, size - 1)], -1)
            put(live, i, self.pair_ranks(rank, right))
            p = before[live, i]
            has = p >= 0
            if has.any():
                put(live[has], p[has], self.pair_ranks(ids[live[has], p[has]], rank[has]))
            live = live[tree[live, 1] < big]
        return [row[row >= 0] for row in ids]

    def pieces(self, raws: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(raws)
        classes: dict[int, list[int]] = {}
        for i, r in enumerate(raws):
            if len(r) > 64:
                out[i] = np.array(self.one(r), np.int64)
            elif len(r) < 2:
                out[i] = self.single[list(r)]
            else:
                classes.setdefault(max(4, 1 << (len(r) - 1).bit_length()), []).append(i)
        for size, at in classes.items():
            for a in range(0, len(at), TOGETHER):
                part = at[a : a + TOGETHER]
                for i, ids in zip(part, self.many([raws[i] for i in part], size)):
                    out[i] = ids
        return out

    def chunks(self, text: str) -> list[str]:
        """Cuts a text where pre-tokens begin, at most of them.

        With PATTERN a pre-token begins at a space or a line end between two characters that aren't white space, and after the latter. Texts with other white space, which are few, are split by the pattern.
        """
        if not self.spaced or "\0" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace() or _OTHER_SPACE(text):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if text else []

    def _learn(self, pieces: list[str], ids: list[np.ndarray]) -> None:
        known = len(self.number)
        self.number.update(zip(pieces, range(known, known + len(pieces))))
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin. A null has none."""
        tokens = [self.chunks(t) if t else [] for t in texts]
        if len(self.number) > self.cache:
            self.number, self.flat, self.at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        number = self.number
        fresh = list(set().union(*tokens).difference(number))
        if fresh:
            parts = [self.split(p) for p in fresh]
            self._learn(single := list(set().union(*parts).difference(number)), self.pieces([p.encode("utf-8") for p in single]))
            several = [(p, x) for p, x in zip(fresh, parts) if len(x) > 1]
            self._learn([p for p, _ in several], [np.concatenate([self.flat[self.at[k] : self.at[k + 1]] for k in map(number.__getitem__, x)]) for _, x in several])
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(tokens)), np.int64, sum(map(len, tokens)))
        begin, length = self.at[which], self.at[which + 1] - self.at[which]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in tokens], dtype=np.int64)])]
        return flat, upto.astype(np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids; an id that isn't in the vocabulary raises KeyError."""
        of = self.bytes_of.__getitem__
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            # a long text in parts, so that its ids aren't Python numbers all at once
            out.append(b"".join([b"".join(map(of, ids[k : min(b, k + 65536)].tolist())) for k in range(a, b, 65536)]))
        return out


_HELD: dict[tuple[str, str], Bpe] = {}


def held(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    """The vocabulary, read once in a process."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = Bpe(path, pattern)
    return _HELD[path, pattern]


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, cache: int = CACHE, place: str | None = None) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) for every row, in the order of the rows: round_trip tells whether decoding the ids gives the text's bytes. A null text has null in all three; an empty one has no tokens. Rows without doc_id and repeated rows stay. cache: words that a worker remembers, about 350 bytes each; fewer take more time. place: a column of longs that goes along."""
    importable(docs.sparkSession)
    along = [place] if place else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(path, pattern)
        bpe.cache = cache
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                texts = b["text"].to_pylist()
                ids, at = bpe.encode(texts)
                same = [None if t is None else raw == t.encode("utf-8") for t, raw in zip(texts, bpe.decode(ids, at))]
                null = pa.array([t is None for t in texts])
                offsets = pa.array(at.astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                n = pa.array(np.diff(at).astype(np.int32), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b["doc_id"], lists, n, pa.array(same, pa.bool_()), *(b[c] for c in along)], ["doc_id", "token_ids", "n_tokens", "round_trip", *along])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text", *along).mapInArrow(run, "".join(["doc_id long, token_ids array<int>, n_tokens int, round_trip boolean", *(f", {c} long" for c in along)]))


_UNKNOWN = "\ufffd".encode()


def decoded(tokens: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids). Bytes that aren't UTF-8 become U+FFFD, and so do a null among the ids and an id that the vocabulary lacks; a null list gives a null text, an empty one ''."""
    importable(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(path, pattern).bytes_of
        for b in batches:
            texts = [None if ids is None else b"".join([known.get(i, _UNKNOWN) for i in ids]).decode("utf-8", "replace") for ids in b["token_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")
