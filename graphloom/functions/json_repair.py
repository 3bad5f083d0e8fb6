"""JSON that models return, read in the JVM where it is sound and repaired in Arrow batches where it isn't."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"


def fenced(c: Column | str) -> Column:
    """The body of the first fenced block, or the text itself."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.trim(F.regexp_extract(c, _FENCE, 1))
    return F.when(body != "", body).otherwise(F.trim(c))


def sound(c: Column | str) -> Column:
    """Whether the text is a JSON object or array."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull()


def _strings(text: str) -> list[tuple[int, int]]:
    """Spans of complete string literals, quotes included; an open one ends at the text's end."""
    out, start, i = [], None, 0
    while i < len(text):
        ch = text[i]
        if start is None:
            if ch == '"':
                start = i
        elif ch == "\\":
            i += 1
        elif ch == '"':
            out.append((start, i + 1))
            start = None
        i += 1
    if start is not None:
        out.append((start, len(text)))
    return out


def _outside(text: str, change: Callable[[str], str]) -> str:
    parts, at = [], 0
    for a, b in _strings(text):
        parts += [change(text[at:a]), text[a:b]]
        at = b
    return "".join([*parts, change(text[at:])])


def escape_strings(text: str) -> str:
    """Raw line ends and tabs within strings, and escapes that aren't JSON's, become proper escapes."""

    def fix(s: str) -> str:
        s = s.replace("\r", "\\r").replace("\n", "\\n").replace("\t", "\\t")
        return re.sub(r'\\(?:u(?![0-9a-fA-F]{4})|(?!["\\/bfnrtu]))', r"\\\\", s) if "\\" in s else s

    parts, at = [], 0
    for a, b in _strings(text):
        parts += [text[at:a], fix(text[a:b])]
        at = b
    return "".join([*parts, text[at:]])


def missing_commas(text: str) -> str:
    """A comma between two values, or a value and a key, that only white space parts."""
    spans = _strings(text)
    out, at = [], 0
    for (_, b), (c, _) in zip(spans, spans[1:]):
        out.append(text[at:b])
        at = b
        if b < c and not text[b:c].strip():
            out.append(",")
    text = "".join([*out, text[at:]])
    text = _outside(text, lambda s: re.sub(r"([}\]])(\s*)(?=[{\[])", r"\1,\2", s))
    spans = _strings(text)
    out, at = [], 0
    for a, _ in spans:
        before = text[at:a]
        if re.search(r"(?:[}\]\d]|true|false|null)\s+$", before):
            before = before.rstrip() + ", "
        out.append(before)
        out.append(text[a : dict(spans)[a]])
        at = dict(spans)[a]
    return "".join([*out, text[at:]])


def null_values(text: str) -> str:
    """A key without a value gets null; commas before a closing bracket go."""
    text = _outside(text, lambda s: re.sub(r":\s*(?=[,}\]])", ": null", s))
    return _outside(text, lambda s: re.sub(r",\s*(?=[}\]])", "", s))


def close_brackets(text: str) -> str:
    """Ends an open string and closes what is open, in order; closings without an opening go."""
    stack, out, inside, skip = [], [], False, False
    for ch in text:
        if inside:
            out.append(ch)
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                inside = False
            continue
        if ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack:
                continue
            while stack and stack[-1] != ch:
                out.append(stack.pop())
            if stack:
                stack.pop()
        out.append(ch)
    s = "".join(out) + ('"' if inside else "")
    s = re.sub(r"[,\s]+$", "", s)
    if re.search(r":\s*$", s):
        s += " null"
    return s + "".join(reversed(stack))


def _drop_tail(text: str) -> str:
    """Without a last key that has no whole value."""
    return re.sub(r',?\s*"(?:[^"\\]|\\.)*"?\s*:?\s*(?:"(?:[^"\\]|\\.)*|[\w.+-]*)$', "", text)


def longest_prefix(text: str) -> str | None:
    """The longest start of the text, cut behind a value, that closing brackets makes whole."""
    for i in range(len(text), 0, -1):
        if text[i - 1] in '}]"' or text[i - 1].isalnum():
            try:
                got = close_brackets(text[:i])
                json.loads(got)
                return got
            except ValueError:
                continue
    return None


def last_element(text: str) -> str | None:
    """Cut behind the last complete element of an array of objects."""
    i = text.rfind("},")
    return close_brackets(text[: i + 1]) if i > 0 else None


def repair(text: str | None, truncated: bool = False) -> str | None:
    """The text as JSON after the first repair that makes it an object or array; null if none does.

    In order: as it is; its fenced block, or from its first bracket to its last; keys whose quotes don't match; escapes; cut at the last `},`; commas between `}{`; nulls for absent values; absent commas; an open tail dropped and closed; closed; for a truncated text its longest sound start; its last complete element.
    """
    if text is None or not text.strip():
        return None
    m = re.search(_FENCE, text)
    body = (m.group(1) if m and m.group(1).strip() else text).strip().removeprefix("```json").removeprefix("```").strip()
    i = min((k for k in (body.find("{"), body.find("[")) if k >= 0), default=-1)
    if i < 0:
        return None
    rest = body[i:]
    j = max(rest.rfind("}"), rest.rfind("]"))
    clean = rest[: j + 1] if j > 0 else rest
    quoted = re.sub(r"'([A-Za-z_]\w*)\"\s*:|\"([A-Za-z_]\w*)'\s*:|'([A-Za-z_]\w*)'\s*:", lambda k: f'"{k.group(1) or k.group(2) or k.group(3)}":', rest)
    escaped = escape_strings(quoted)
    steps: list[Callable[[], str | None]] = [
        lambda: text,
        lambda: clean,
        lambda: quoted,
        lambda: escaped,
        lambda: escape_strings(clean),
        lambda: close_brackets(escaped[: escaped.rfind("},") + 1]) if len(_strings(escaped)) and escaped.count('"') % 2 and "}," in escaped else None,
        lambda: _outside(escaped, lambda s: re.sub(r"}\s*{", "},{", s)),
        lambda: null_values(escaped),
        lambda: missing_commas(null_values(escaped)),
        lambda: close_brackets(null_values(missing_commas(escaped))),
        lambda: close_brackets(null_values(_drop_tail(escaped))),
        lambda: longest_prefix(escaped) if truncated else None,
        lambda: last_element(escaped),
    ]
    for step in steps:
        try:
            got = step()
            if got is not None and isinstance(value := json.loads(got), (dict, list)):
                return json.dumps(value, ensure_ascii=False)
        except ValueError:
            continue
    return None


def parsed(text: str | None, truncated: bool = False) -> dict | list | None:
    """The value that repair makes of the text; sound texts, which most are, are read once and not repaired."""
    try:
        if isinstance(value := json.loads(text or ""), (dict, list)):
            return value
    except ValueError:
        pass
    return None if (r := repair(text, truncated)) is None else json.loads(r)


def repaired(c: Column | str, truncated: bool = False) -> Column:
    """Sound texts stay as they are, in the JVM; only the others reach Python. Null where no repair helps."""
    c = F.col(c) if isinstance(c, str) else c

    @F.pandas_udf("string")
    def mend(s: pd.Series) -> pd.Series:
        return s.map(lambda t: repair(t, truncated))

    ok = F.coalesce(sound(c), F.lit(False))
    return F.when(ok, c).otherwise(mend(F.when(~ok, c)))


def leaves_filled(value) -> int:
    """Filled leaves of a parsed JSON value: no null, no blank string, nothing in empty collections."""
    if value is None or value == "":
        return 0
    if isinstance(value, dict):
        return sum(map(leaves_filled, value.values()))
    if isinstance(value, list):
        return sum(map(leaves_filled, value))
    return int(bool(str(value).strip()))


@F.pandas_udf(T.IntegerType())
def count_filled(s: pd.Series) -> pd.Series:
    """Filled leaves of JSON texts; 0 for null and unsound ones."""

    def of(t: str | None) -> int:
        try:
            return 0 if t is None else leaves_filled(json.loads(t))
        except ValueError:
            return 0

    return s.map(of).astype("int32")


def is_sparse(filled: Column, leaves: int, chars: Column) -> Column:
    """A text of 400 characters or more of which a schema of ten leaves or more got less than 40 % filled."""
    return (chars >= 400) & F.lit(leaves >= 10) & (filled / F.lit(float(max(leaves, 1))) < 0.4)
