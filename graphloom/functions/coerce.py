"""Validation and salvage: JSON records read by a template, with wrong types coerced and instances without identity dropped."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.template import Field, Model, Template
from .text import is_class_echo

_NUMBER = re.compile(r"[-+]?\d[\d  .,']*")


def _number(v: Any) -> float | None:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    m = _NUMBER.search(str(v))
    if not m:
        return None
    s = re.sub(r"[\s  ']", "", m.group()).rstrip(".,")
    if re.fullmatch(r"[-+]?\d{1,3}(\.\d{3})*,\d+|[-+]?\d+,\d{1,2}", s):
        s = s.replace(".", "").replace(",", ".")
    try:
        return float(s.replace(",", ""))
    except ValueError:
        return None


def _scalar(f: Field, v: Any, t: Template) -> tuple[Any, str | None]:
    """The value in the field's type, and what was done."""
    if v is None:
        return None, None
    if (e := t.enum(f.type)) is not None:
        fold = lambda s: re.sub(r"[^a-z0-9]", "", str(s).lower())
        table = {fold(m): m for m in e.members} | {fold(k): m for k, m in e.synonyms.items()}
        got = table.get(fold(v), e.other)
        return got, None if got == v else "enum"
    if f.type == "str":
        if isinstance(v, str):
            return v, None
        return (json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)), "to string"
    if f.type in ("int", "float"):
        n = _number(v) if not isinstance(v, (dict, list)) else None
        if n is None:
            return None, "pruned"
        out = int(n) if f.type == "int" and n == int(n) else n if f.type == "float" else None
        return out, None if out == v and not isinstance(v, str) else "to number" if out is not None else "pruned"
    if f.type == "bool":
        if isinstance(v, bool):
            return v, None
        s = str(v).strip().lower()
        return (True, "to bool") if s in ("true", "yes", "1") else (False, "to bool") if s in ("false", "no", "0") else (None, "pruned")
    return (v, None) if isinstance(v, str) else (None, "pruned")


def salvage(value: Any, t: Template, model: str | None = None, where: str = "") -> tuple[dict | None, list[str]]:
    """The record in the model's shape, and what was mended: wrong scalars coerced or pruned, single values made lists, bare strings made instances with that identity, scalars given for a quantity put in its value, required enums and fields filled with defaults. None if an entity's identity is wholly absent."""
    m = t.model(model or t.root)
    notes: list[str] = []
    if not isinstance(value, dict):
        ids = m.identity or [f.name for f in m.fields if f.name == "value"] or [f.name for f in m.fields[:1]]
        if value is None or isinstance(value, list) or not ids:
            return None, [f"{where}: dropped"]
        value, notes = {ids[0]: value}, [f"{where}: to instance"]
    out: dict[str, Any] = {}
    for f in m.fields:
        at = f"{where}.{f.name}" if where else f.name
        v = value.get(f.name)
        target = t.model(f.type)
        if f.is_list:
            if v is None:
                out[f.name] = []
                continue
            if not isinstance(v, list):
                v = [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) and target is None else [v]
                notes.append(f"{at}: to list")
            items = []
            for i, x in enumerate(v):
                if target is not None:
                    got, more = salvage(x, t, target.name, f"{at}[{i}]")
                    notes += more
                else:
                    got, what = _scalar(f, x, t)
                    notes += [f"{at}[{i}]: {what}"] if what else []
                if got is not None:
                    items.append(got)
            out[f.name] = items
        elif target is not None:
            out[f.name], more = (None, []) if v is None else salvage(v, t, target.name, at)
            notes += more
        else:
            out[f.name], what = _scalar(f, v, t)
            notes += [f"{at}: {what}"] if what else []
            if out[f.name] is None and f.required and f.role != "identity":
                e = t.enum(f.type)
                out[f.name] = e.other if e else {"int": 0, "float": 0.0, "bool": False}.get(f.type, "Unknown")
                notes.append(f"{at}: default")
    if m.entity and m.identity and where and all(out.get(i) in (None, "") for i in m.identity):
        return None, [*notes, f"{where}: no identity"]
    return out, notes


def salvaged(df: DataFrame, column: str, t: Template, keep: list[str]) -> DataFrame:
    """(keep..., record, notes): JSON texts as records of the template's type; unreadable ones are null with the note 'unreadable'."""

    def of(text: str | None) -> tuple[str | None, list[str]]:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            value = None
        if isinstance(value, list):
            value = value[0] if value else None
        if not isinstance(value, dict):
            return None, ["unreadable"]
        out, notes = salvage(value, t)
        return None if out is None else json.dumps(out, ensure_ascii=False), notes

    @F.pandas_udf("json string, notes array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [of(x) for x in s]
        return pd.DataFrame({"json": [a for a, _ in rows], "notes": [b for _, b in rows]})

    out = df.select(*keep, run(F.col(column)).alias("__r"))
    return out.select(*keep, F.from_json("__r.json", t.schema()).alias("record"), F.col("__r.notes").alias("notes"))


def root_identity(value: Column | str, cls: str, stem: Column | str) -> Column:
    """The root's identity without an echo of its class; the source's stem where nothing is left."""
    v = F.col(value) if isinstance(value, str) else value
    s = F.col(stem) if isinstance(stem, str) else stem
    own = F.when(~is_class_echo(v, cls) & (F.trim(v) != ""), v)
    return F.coalesce(own, s)


def with_identity(items: Column | str, fields: list[str]) -> Column:
    """The structs of an array that have some identity field filled."""
    some = lambda x: F.exists(F.array(*(F.coalesce(F.trim(x[f].cast("string")) != "", F.lit(False)) for f in fields)), lambda b: b)
    return F.filter(items, some)


def leaves(t: Template, model: str | None = None, above: tuple[str, ...] = ()) -> int:
    """Scalar leaves of a model, each nested model once on a way."""
    m: Model = t.model(model or t.root)
    return sum(1 if (x := t.model(f.type)) is None else 0 if x.name in (*above, m.name) else leaves(t, x.name, (*above, m.name)) for f in m.fields)


def plain_json(value: Any) -> Any:
    """Python values as JSON has them: dates in ISO form, decimals as floats, sets sorted, bytes as text, anything else as a string."""
    import datetime
    import decimal
    import enum

    if isinstance(value, enum.Enum):
        return plain_json(value.value)
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dict):
        return {str(k): plain_json(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((plain_json(v) for v in value), key=str)
    if isinstance(value, (list, tuple)):
        return [plain_json(v) for v in value]
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
