"""Token counts that follow edits.

A document is held as its pre-tokens, the leaves of a segment tree whose nodes sum
characters and tokens. An edit finds its first and last leaf by descending along the
character sums, splits the edited region anew from two pre-tokens before it up to where
the pieces fall in step with the old ones, encodes those alone, and updates the sums
above. A leaf holds one or a few pre-tokens, as byte_bpe's chunks have them, which are
told apart when an edit reaches it; after an edit it may hold any number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import importable
from ._text import slices
from .byte_bpe import PATTERN, VOCABULARY, held

CACHE = 2_000_000


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.encode = tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks=held(path, pattern).ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(pattern)
        self.chunks = held(path, pattern).chunks
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            # a long piece goes through the tree of byte_bpe, whose time is no square of its length
            n = self.known[piece] = len(self.encode(piece)) if len(piece) < 512 else len(held().one(piece.encode("utf-8")))
        return n

    def of_chunk(self, chunk: str) -> int:
        """Tokens of a piece that has whole pre-tokens."""
        if len(pieces := self.split.findall(chunk)) == 1:
            return self.tokens(chunk)
        n = self.known[chunk] = sum(map(self.tokens, pieces))
        return n


@lru_cache(4)
def counter(path: str = VOCABULARY, pattern: str = PATTERN) -> Counter:
    return Counter(path, pattern)


class TokenTree:
    """The pre-tokens of a text with sums of characters and tokens over them."""

    #: How many pre-tokens before an edit may change with it: a contraction or a run of spaces looks two characters ahead.
    CONTEXT = 3

    def __init__(self, text: str, count: Counter):
        self.count = count
        pieces = count.chunks(text)
        self.leaves: list[list[str] | str] = pieces
        self.size = 1 << (max(1, len(pieces)) - 1).bit_length()
        tokens = list(map(count.known.get, pieces))
        if None in tokens:
            tokens = [n or count.of_chunk(p) for n, p in zip(tokens, pieces)]
        self.tokens = self._levels(tokens)
        self.chars = None
        self.encoded = 0

    def _levels(self, leaves: list[int]) -> np.ndarray:
        tree = np.zeros(2 * self.size, np.int64)
        tree[self.size : self.size + len(leaves)] = leaves
        k = self.size
        while k > 1:
            np.add(tree[k : 2 * k : 2], tree[k + 1 : 2 * k : 2], out=tree[k // 2 : k])
            k //= 2
        return tree

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else "".join(x) for x in self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that has the character at place `at`, or the last one, and where it begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if at - begin >= self.chars[k] and k + 1 < 2 * self.size:
                begin += int(self.chars[k])
                k += 1
        i, last = k - self.size, len(self.leaves) - 1
        if i > last:
            return last, int(self.chars[1] - self.chars[self.size + last])
        return i, begin

    def _put(self, i: int, pieces: list[str]) -> None:
        self.leaves[i] = pieces
        k = self.size + i
        dt = sum(map(self.count.tokens, pieces)) - int(self.tokens[k])
        dc = sum(map(len, pieces)) - int(self.chars[k])
        while k and (dt or dc):
            self.tokens[k] += dt
            self.chars[k] += dc
            k >>= 1

    def _list(self, x: list[str] | str) -> list[str]:
        return self.count.split.findall(x) if isinstance(x, str) else x

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to before end. Places past the end stand for the end."""
        if self.chars is None:
            self.chars = self._levels([len(x) for x in self.leaves])
        length = int(self.chars[1])
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        if not self.leaves:
            self.leaves = [[]]
        i, begin = self._find(start)
        # back by CONTEXT pre-tokens, leaves that hold none not counted
        back = self.CONTEXT
        while i and back:
            i -= 1
            x = self._list(self.leaves[i])
            begin -= sum(map(len, x))
            back -= min(back, len([p for p in x if p]))
        j, at = i, begin
        old: list[str] = []
        bounds: set[int] = set()  # where old pieces begin behind the edit, in the new text
        delta = len(new) - (end - start)
        n = len(self.leaves)
        while True:
            # takes in leaves until the new pieces meet an old boundary behind the edit
            reach = max(64, 2 * (end - begin)) if not old else 2 * (at - begin)
            while j < n and (at < end or at - begin < reach):
                for p in self._list(self.leaves[j]):
                    if at >= end:
                        bounds.add(at + delta - begin)
                    old.append(p)
                    at += len(p)
                j += 1
            region = "".join(old)
            region = region[: start - begin] + new + region[end - begin :]
            pieces, pos, met = [], 0, None
            for m in self.count.split.finditer(region):
                # the last piece may go on in the text that isn't taken in yet
                if m.end() + 2 >= len(region) and j < n:
                    break
                if m.start() in bounds and m.start() >= start - begin + len(new):
                    met = m.start()
                    break
                pieces.append(m.group())
                pos = m.end()
            if met is not None or j >= n:
                break
        if met is None:
            tail: list[str] = []
        else:
            # old pieces from the meeting point on stay as they are
            tail, place = [], 0
            for p in old:
                if place + delta >= met and place + begin >= end:
                    tail.append(p)
                place += len(p)
        self.encoded += sum(map(len, pieces))
        whole = pieces + tail
        slots = j - i
        if not slots:
            return
        for k in range(slots):
            self._put(i + k, whole[k : k + 1] if k < slots - 1 else whole[k:])


#: Spans that are masked: e-mail addresses, telephone numbers, IP addresses, and long keys.
MASKS: tuple[tuple[str, str], ...] = (
    (r"[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+", "<EMAIL>"),
    (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", "<IP>"),
    (r"\+?(?<!\w)\d[\d ()-]{7,20}\d(?!\w)", "<PHONE>"),
    (r"(?<!\w)(?=[A-Za-z0-9_/+-]*\d)[A-Za-z0-9_/+-]{24,200}(?!\w)", "<KEY>"),
)


def masking(masks: tuple[tuple[str, str], ...] = MASKS) -> Callable[[str], list[tuple[int, int, str]]]:
    """Edits of a text by rules; of overlapping spans the first stays. Places are those after the edits before."""
    compiled = [(regex.compile(p), r) for p, r in masks]
    digits = regex.compile(r"\d")

    def of(text: str) -> list[tuple[int, int, str]]:
        if "@" not in text and not digits.search(text):
            return []
        spans = sorted((m.start(), m.end(), k) for k, (p, _) in enumerate(compiled) for m in p.finditer(text))
        out, last, shift = [], 0, 0
        for s, e, k in spans:
            if s >= last:
                new = compiled[k][1]
                out.append((s + shift, e + shift, new))
                shift += len(new) - (e - s)
                last = e
        return out

    return of


def token_counts(docs: DataFrame, edits: str | None = None, masks: tuple[tuple[str, str], ...] = MASKS, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, reencoded_chars) for every row: tokens of the text, and of the text after its edits.

    edits: a column array<struct<start int, end int, new string>> of characters to replace, one edit after another, each in the text that the ones before left; null is none. If edits is None, spans that the masks match are replaced. A null text has nulls; an empty one has no tokens. Rows without doc_id and repeated rows stay.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rules = counter(path, pattern), masking(masks)
        for batch in batches:
            for b in slices(batch):
                given = b["edits"].to_pylist() if edits else [None] * len(b)
                rows = []
                for text, own in zip(b["text"].to_pylist(), given):
                    if text is None:
                        rows.append((None,) * 4)
                        continue
                    tree = TokenTree(text, count)
                    before = tree.total
                    todo = [(e["start"], e["end"], e["new"] or "") for e in own or [] if e and e["start"] is not None and e["end"] is not None] if edits else rules(text)
                    for e in todo:
                        tree.edit(*e)
                    rows.append((before, len(todo), tree.total, tree.encoded))
                cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "reencoded_chars"])

    columns = [F.col("doc_id").cast("long"), "text"] + ([F.col(edits).cast("array<struct<start:int,end:int,new:string>>").alias("edits")] if edits else [])
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, reencoded_chars long")
