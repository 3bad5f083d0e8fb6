"""Checks that a template works before data meets it: structure, type, catalog, and a sample record that becomes a graph."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .lint import Finding, lint
from .template import Template, from_struct


def sample(t: Template, model: str | None = None, above: tuple[str, ...] = (), number: int = 1) -> dict[str, Any]:
    """A record with every field filled, the same each time; lists have two items."""
    import datetime

    m = t.model(model or t.root)
    out: dict[str, Any] = {}
    for f in m.fields:
        target = t.model(f.type)
        if target is not None and not f.reference and target.name not in (*above, m.name):
            one = lambda k, target=target: sample(t, target.name, (*above, m.name), k)
        elif target is not None:
            one = lambda k, target=target: {i.name: _value(t, i, k) for i in target.fields if i.role == "identity"}
        else:
            one = lambda k, f=f: _value(t, f, k)
        out[f.name] = [one(number), one(number + 1)] if f.is_list else one(number)
    _ = datetime
    return out


def _value(t: Template, f, number: int) -> Any:
    import datetime

    if (e := t.enum(f.type)) is not None:
        return e.members[(number - 1) % len(e.members)]
    if f.type == "str" and f.examples:
        return f.examples[(number - 1) % len(f.examples)]
    return {"int": number, "float": number + 0.5, "bool": True, "date": datetime.date(2024, 1, number), "datetime": datetime.datetime(2024, 1, number)}.get(f.type, f"{f.name} {number}")


def verify(spark: SparkSession, t: Template) -> list[Finding]:
    """What fails, gate by gate; empty if nothing does."""
    from ..operators.build import build
    from ..operators.clean import dangling

    out: list[Finding] = []
    if t.model(t.root) is None:
        return [Finding("structure", t.root, "no such root", level="error")]
    out += [f for f in lint(t, repair=False)[1] if f.level == "error"]
    schema = t.schema()
    if not schema.fields:
        out.append(Finding("schema", t.root, "no field", level="error"))
    if Template.from_dict(t.to_dict()) != t:
        out.append(Finding("round trip", t.root, "doesn't survive being written", level="error"))
    df = spark.createDataFrame([(1, sample(t))], T.StructType([T.StructField("__n", T.LongType()), T.StructField("r", schema)])).select("__n", "r.*")
    g = build(df, t, "__n")
    classes = {r[0] for r in g.nodes.select("class").distinct().collect()}
    out += [Finding("graph", p.model, "no node comes of the sample", level="error") for p in t.places() if p.model not in classes]
    if (n := dangling(g).count()) > 0:
        out.append(Finding("graph", t.root, f"{n} edges without ends", level="error"))
    return out


def reverse(root: str, schema: T.StructType, strict: bool = False) -> tuple[Template, list[Finding]]:
    """A linted template from a Spark type."""
    return lint(from_struct(root, schema), strict=strict)
