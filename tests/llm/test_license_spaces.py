"""Optional spaces of license rules, with and without the space; expected licenses written by hand."""

from __future__ import annotations

import pytest

from graphloom.llm import license_scan
from graphloom.llm.license_rules import RULES

#: For each rule with an optional space: a spelling in which {} is where the space may be, and its license.
SPELLINGS = [
    ("Apache License v{}2.0", "Apache-2.0"),
    ("GNU General Public License v{}1", "GPL-1.0"),
    ("GNU General Public License, v.{}2 or later", "GPL-2.0-or-later"),
    ("GNU General Public License v{}2", "GPL-2.0"),
    ("GNU General Public Licence v{}2", "GPL-2.0"),
    ("GNU GPL v{}2", "GPL-2.0"),
    ("GNU GPL,{}v2", "GPL-2.0"),
    ("GNU General Public License v{}3 or later", "GPL-3.0-or-later"),
    ("GNU General Public License v{}3", "GPL-3.0"),
    ("GNU General Public Licence v{}3", "GPL-3.0"),
    ("GNU GPL v{}3", "GPL-3.0"),
    ("GNU Library General Public License v{}2", "LGPL-2.0"),
    ("GNU Lesser General Public License v{}2.1", "LGPL-2.1"),
    ("GNU Lesser General Public License v{}3", "LGPL-3.0"),
    ("GNU Affero General Public License v{}3", "AGPL-3.0"),
    ("Mozilla Public License v{}1.0", "MPL-1.0"),
    ("Mozilla Public License v{}1.1", "MPL-1.1"),
    ("Mozilla Public License v{}2.0", "MPL-2.0"),
    ("Eclipse Public License v{}1.0", "EPL-1.0"),
    ("Eclipse Public License -v{}2.0", "EPL-2.0"),
    ("Eclipse Distribution License v{}1.0", "EDL-1.0"),
    ("Common Development and Distribution License (CDDL) v{}1.0", "CDDL-1.0"),
    ("Common Development and Distribution License v{}1.1", "CDDL-1.1"),
    ("Common Public License v{}1.0", "CPL-1.0"),
    ("IBM Public License v{}1.0", "IPL-1.0"),
    ("Common Public Attribution License v{}1.0", "CPAL-1.0"),
    ("European Union Public Licence v{}1.1", "EUPL-1.1"),
    ("European Union Public License v.{}1.2", "EUPL-1.2"),
    ("SIL Open Font License v{}1.1", "OFL-1.1"),
    ("Open Software License v{}3.0", "OSL-3.0"),
    ("Open Software License v{}2.1", "OSL-2.1"),
    ("Academic Free License v{}3.0", "AFL-3.0"),
    ("Academic Free License v{}2.1", "AFL-2.1"),
    ("Universal Permissive License v{}1.0", "UPL-1.0"),
    ("Open Database License v{}1.0", "ODbL-1.0"),
    ("Server Side Public License v{}1", "SSPL-1.0"),
    ("CreativeML Open{}RAIL-M license", "OpenRAIL-M"),
    ("LaTeX Project Public License v{}1.3c", "LPPL-1.3c"),
    ("neither the name of X nor the names of its{}contributors may be used to endorse or promote products", "BSD-3-Clause"),
]


@pytest.mark.parametrize("spelling, license", SPELLINGS)
@pytest.mark.parametrize("space", ["", " ", "\n# "])
def test_optional_space(spelling, license, space):
    text = spelling.format(space)
    found = [(r.license, text[a:b]) for r in license_scan.parse() for m in r.pattern.finditer(text) for a, b in [m.span()]]
    assert (license, text) in found


def test_every_rule_with_an_optional_space_is_tried():
    rules = license_scan.parse()
    lines = [x.split("|", 3)[3] for x in RULES.splitlines() if x.strip()]
    hit = {r.number for s, _ in SPELLINGS for r in rules if any(r.pattern.fullmatch(s.format(g)) for g in ("", " "))}
    assert {r.number for r, p in zip(rules, lines) if " ?" in p} <= hit
