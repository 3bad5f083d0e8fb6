"""The prefilter lets through every rule that a text matches: strings of all alternatives of all rules."""

from __future__ import annotations

import random
from re import _constants as C
from re import _parser

import pytest

from graphloom.llm import license_scan
from graphloom.llm.license_rules import RULES

LINES = [x.split("|", 3)[3] for x in RULES.splitlines() if x.strip()]
SCANNER = license_scan.scanner()


def spelled(parts, rng: random.Random) -> str:
    """One string of a parsed pattern, its choices made at random; what is looked ahead or back for is left out."""
    out = ""
    for op, arg in parts:
        if op is C.LITERAL:
            out += chr(arg)
        elif op in (C.NOT_LITERAL, C.ANY):
            out += "x"
        elif op is C.IN:
            kind, of = rng.choice(arg)
            out += chr(of) if kind is C.LITERAL and arg[0][0] is not C.NEGATE else chr(rng.randint(*of)) if kind is C.RANGE and arg[0][0] is not C.NEGATE else {C.CATEGORY_DIGIT: "7", C.CATEGORY_SPACE: " "}.get(of, "x")
        elif op is C.BRANCH:
            out += spelled(rng.choice(arg[1]), rng)
        elif op is C.SUBPATTERN:
            out += spelled(arg[3], rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, of = arg
            out += "".join(spelled(of, rng) for _ in range(rng.choice((low, min(high, low + 1)))))
        elif op not in (C.ASSERT, C.ASSERT_NOT, C.AT):
            raise ValueError(op)
    return out


@pytest.mark.parametrize("rule", SCANNER.rules, ids=lambda r: f"{r.number}-{r.license}")
def test_prefilter_loses_no_alternative(rule):
    rng, parts = random.Random(rule.number), _parser.parse(LINES[rule.number])
    texts = {spelled(parts, rng) for _ in range(300)}
    matched = [t for t in texts if rule.pattern.search(t)]
    assert matched
    for t in matched:
        assert rule in SCANNER.candidates(t)


@pytest.mark.parametrize(
    "text, license",
    [
        ("see https://opensource.org/license/mit", "MIT"),
        ("see https://opensource.org/license/bsd-2-clause", "BSD-2-Clause"),
        ("see https://opensource.org/license/bsd-3-clause", "BSD-3-Clause"),
        ("see https://opensource.org/license/isc", "ISC"),
        ("CreativeML Open RAIL++-M", "OpenRAIL-M"),
        ("under the Expat licence", "MIT"),
        ("the PostgreSQL licence", "PostgreSQL"),
        ("Released under the MIT licence", "MIT"),
    ],
)
def test_alternatives_are_found(text, license):
    assert license in {r.license for _, _, r in SCANNER.scan(text)}
