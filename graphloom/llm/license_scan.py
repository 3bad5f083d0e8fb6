"""License scans by ordered signature rules.

An Aho-Corasick automaton over the rules' keywords tells which rules can match a text;
only their regular expressions are run. Detections are then taken from
the highest priority to the lowest. One that overlaps a taken one of a higher priority is
suppressed, and so is one that lies within another of its own priority; of equal
intervals the earlier rule's stays.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import importable
from ._text import slices
from .license_rules import RULES

_GAP = r"(?:[\s*#/;%]*\s[\s*#/;%]*)"


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    priority: int
    keyword: str
    pattern: regex.Pattern


def parse(lines: str = RULES) -> tuple[Rule, ...]:
    out = []
    for line in lines.splitlines():
        if line.strip():
            name, priority, keyword, pattern = line.split("|", 3)
            spaced = regex.sub(r"(?<!\\) ", lambda _: _GAP, _outside_classes(pattern))
            out.append(Rule(len(out), name, int(priority), keyword, regex.compile(spaced.replace("\0", " "), regex.IGNORECASE)))
    return tuple(out)


def _outside_classes(pattern: str) -> str:
    """Spaces within [...] become NUL, to be put back."""
    return regex.sub(r"\[[^\]]*\]", lambda m: m.group().replace(" ", "\0"), pattern)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.by_keyword: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_keyword.setdefault(" ".join(r.keyword.split()), []).append(r)
        self.automaton = ahocorasick.Automaton()
        #: The automaton looks for a keyword's longest word; for the rest of it spaces may be any gap.
        self.words: dict[str, list[str]] = {}
        for k in self.by_keyword:
            self.words.setdefault(max(k.split(), key=len), []).append(k)
        for w, ks in self.words.items():
            self.automaton.add_word(w, w)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[Rule]:
        """The rules whose keyword's words are all in the text, in their order."""
        lower = text.lower()
        seen = {w for _, w in self.automaton.iter(lower)}
        if not seen:
            return []
        out = [r for w in seen for k in self.words[w] if all(x in lower for x in k.split()) for r in self.by_keyword[k]]
        return sorted(out, key=lambda r: r.number)

    def scan(self, text: str) -> list[tuple[int, int, Rule]]:
        found = [(m.start(), m.end(), r) for r in self.candidates(text) for m in r.pattern.finditer(text)]
        return resolve(found)


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Which detections stay, by place."""
    taken: list[tuple[int, int, Rule]] = []
    level: list[tuple[int, int, Rule]] = []
    # intervals taken at higher priorities, merged; and those of this one, sorted by start
    covered_s: list[int] = []
    covered_e: list[int] = []
    for priority in sorted({r.priority for _, _, r in found}, reverse=True):
        own = sorted((x for x in found if x[2].priority == priority), key=lambda x: (x[0], -x[1], x[2].number))
        level = []
        reach = -1
        for s, e, r in own:
            k = bisect.bisect_right(covered_s, s) - 1
            over = (k >= 0 and covered_e[k] > s) or (k + 1 < len(covered_s) and covered_s[k + 1] < e)
            # sorted by start, then longest first: contained in an earlier one if that reaches as far
            if not over and e > reach:
                level.append((s, e, r))
                reach = e
        taken += level
        merged: list[list[int]] = []
        for s, e in sorted([*zip(covered_s, covered_e), *((s, e) for s, e, _ in level)]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        covered_s, covered_e = [m[0] for m in merged], [m[1] for m in merged]
    return sorted(taken, key=lambda x: (x[0], x[1], x[2].number))


@lru_cache(4)
def scanner(lines: str = RULES) -> Scanner:
    return Scanner(parse(lines))


def license_scan(docs: DataFrame, rules: str = RULES) -> DataFrame:
    """(doc_id, license, rule, start_char, end_char) for each detection that stays.

    Texts are searched whole; places count characters from 0, the end not included. Rows with a null or empty text have no detection. Rows without doc_id are searched too; repeated rows are searched each.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            for b in slices(batch):
                at, found = [], []
                for i, text in enumerate(b["text"].to_pylist()):
                    if text:
                        hits = s.scan(text)
                        at += [i] * len(hits)
                        found += hits
                if found:
                    yield pa.RecordBatch.from_arrays([pc.take(b["doc_id"], pa.array(at)), pa.array([r.license for _, _, r in found]), pa.array([r.number for _, _, r in found], pa.int32()), pa.array([x for x, _, _ in found], pa.int32()), pa.array([x for _, x, _ in found], pa.int32())], ["doc_id", "license", "rule", "start_char", "end_char"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, rule int, start_char int, end_char int")
