"""Extraction: texts to records by a pluggable client, one call an Arrow row, retried, split and salvaged where answers fall short."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import leaves, salvage
from ..functions.json_repair import leaves_filled, parsed, repair
from ..plans.template import Template
from .chunk import word_count
from .merge import deep_merge

SPLIT_DEPTH, PER_FILL = 4, 5


class Truncated(Exception):
    """An answer that ended at the token limit; text is what there was."""

    def __init__(self, text: str = ""):
        super().__init__("truncated")
        self.text = text


class Client(Protocol):
    """Answers a prompt with JSON text; made in each worker by a factory. schema is null in retries that have it in the prompt."""

    def __call__(self, prompt: str, schema: dict | None) -> str: ...


ClientFactory = Callable[[], Client]


def contract(chars: Column, output_tokens: int, context_tokens: int | None, chunking: bool = True) -> Column:
    """direct if input and output fit the context and the text is within what the output can hold, four characters a token; or if there is no chunking. Else dense."""
    fits = F.greatest(F.lit(1), F.floor(chars / 4)) + output_tokens <= context_tokens if context_tokens else F.lit(True)
    return F.when(fits & (chars <= output_tokens * 4), "direct").otherwise("dense") if chunking else F.lit("direct")


def fits_context(chars: Column, output_tokens: int, context_tokens: int | None) -> Column:
    return F.lit(True) if context_tokens is None else F.greatest(F.lit(1), F.floor(chars / 4)) + output_tokens <= context_tokens


def guide(t: Template, per_field: int = 120, total: int = 4000, depth: int = 4) -> str:
    """Fields with types and short descriptions, model by model, within budgets."""
    out, size = [], 0
    for p in t.places():
        if p.path.count(".") + 1 > depth:
            continue
        for f in t.model(p.model).fields:
            line = f"{p.model}.{f.name}: {'list of ' if f.is_list else ''}{f.type}" + (f" - {f.description}"[:per_field] if f.description else "")
            if size + len(line) > total:
                return "\n".join(out)
            out.append(line)
            size += len(line) + 1
    return "\n".join(out)


def prompt(text: str, t: Template, with_schema: bool = False, part: bool = False) -> str:
    head = "Extract what the text says, as JSON." if not part else "Extract what this part of a text says, as JSON."
    return "\n\n".join([head, guide(t), *([json.dumps(json_schema(t), ensure_ascii=False)] if with_schema else []), text])


def json_schema(t: Template, model: str | None = None, above: tuple[str, ...] = ()) -> dict:
    """The template as a JSON Schema, closed, all properties required, as strict interfaces want it."""
    m = t.model(model or t.root)
    props = {}
    for f in m.fields:
        target = t.model(f.type)
        if target is not None:
            s = {"type": "object", "properties": {i: {"type": "string"} for i in target.identity}, "required": target.identity, "additionalProperties": False} if f.reference or target.name in (*above, m.name) else json_schema(t, target.name, (*above, m.name))
        elif (e := t.enum(f.type)) is not None:
            s = {"type": "string", "enum": list(e.members)}
        else:
            s = {"type": {"int": "integer", "float": "number", "bool": "boolean"}.get(f.type, "string")}
        props[f.name] = {"type": "array", "items": s} if f.is_list else s
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}


def ask(client: Client, text: str, t: Template, sparse_check: bool = True, gleaning: int = 0, part: bool = False) -> dict | None:
    """A validated record, or none. The call is made again with the schema in the prompt if it fails, or if it leaves most of a large schema empty; further passes add what they find."""

    def once(schema: dict | None, p: str) -> dict | None:
        try:
            raw, cut = client(p, schema), False
        except Truncated as e:
            raw, cut = e.text, True
        value = json.loads(r) if (r := repair(raw, cut)) else None
        if isinstance(value, list):
            value = next((x for x in value if isinstance(x, dict)), None)
        return value if value else None

    try:
        got = once(json_schema(t), prompt(text, t, part=part))
    except Exception as e:  # noqa: BLE001 - any failure of a client asks again once
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        got = None
    n = leaves(t)
    if got is None or (sparse_check and len(text) >= 400 and n >= 10 and leaves_filled(got) / n < 0.4):
        got = once(None, prompt(text, t, with_schema=True, part=part)) or got
    if got is None:
        return None
    for _ in range(gleaning):
        more = once(None, prompt(f"{text}\n\nAlready found:\n{json.dumps(got, ensure_ascii=False)}", t, part=part))
        if more:
            got = deep_merge(more, got, t.identities())
    return salvage(got, t)[0]


def direct(docs: DataFrame, key: str, t: Template, factory: ClientFactory, **options) -> DataFrame:
    """(key, record): one record a document. The client is made once for each worker."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            rows = [(k, None if not x else ask(client, x, t, **options)) for k, x in zip(pdf["__k"], pdf["__t"])]
            yield pd.DataFrame({key: [k for k, _ in rows], "json": [None if r is None else json.dumps(r, ensure_ascii=False) for _, r in rows]})

    out = docs.select(F.col(key).alias("__k"), F.col("text").alias("__t")).mapInPandas(run, f"`{key}` {kind}, json string")
    return out.select(key, F.from_json("json", t.schema()).alias("record"))


def per_page(pages: DataFrame, key: str, t: Template, factory: ClientFactory, **options) -> DataFrame:
    """(key, page_no, record): one record a page."""
    p = pages.withColumn("__p", F.struct(key, "page_no"))
    return direct(p.select("__p", "text"), "__p", t, factory, **options).select(F.col(f"__p.{key}").alias(key), "__p.page_no", "record")


def many_to_one(parts: DataFrame, key: str, order: str, t: Template, factory: ClientFactory, **options) -> DataFrame:
    """(key, record): the parts' records deep-merged in order, a document a group."""
    kinds = dict(parts.dtypes)
    ids = t.identities()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            rows = [ask(client, x, t, part=True, **options) if x else None for x in pdf["__t"]]
            yield pd.DataFrame({key: pdf["__k"], order: pdf["__o"], "json": [None if r is None else json.dumps(r, ensure_ascii=False) for r in rows]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for x in pdf.sort_values(order)["json"]:
            if x:
                out = deep_merge(out, json.loads(x), ids)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "json": [json.dumps(salvage(out, t)[0], ensure_ascii=False) if out else None]})

    asked = parts.select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.col("text").alias("__t")).mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, json string")
    return asked.groupBy(key).applyInPandas(merge, f"`{key}` {kinds[key]}, json string").select(key, F.from_json("json", t.schema()).alias("record"))


_KEPT: dict[tuple[int, str], tuple] = {}


def kept(t: Template, what: str, make: Callable[[], tuple]) -> tuple:
    """What make gives for a template, made once in a worker; templates may hold dicts, so they are told by identity."""
    got = _KEPT.get((id(t), what))
    if got is None or got[0] is not t:
        got = _KEPT[id(t), what] = (t, make())
    return got[1]


def _catalog(t: Template) -> tuple[dict[str, str], str]:
    """Places by their paths without brackets, and what a client is told of them."""
    return {p.path.replace("[]", ""): p.path for p in t.places()}, "\n".join(f"{p.path or '(root)'}: {p.model} by {', '.join(p.identity)}" for p in t.places())


def named_in(client: Client, chunks: list[dict], t: Template) -> list[dict]:
    """Rows (pos, path, ids, p, i, chunk_id): the instances that the client names in a batch of chunks (chunk_id, text); a truncated batch is halved, at most SPLIT_DEPTH times, and a single chunk that stays truncated gives what there was.

    The client answers {"nodes": [{"i", "path", "ids", "p"}]}.
    """
    paths, catalog = kept(t, "catalog", lambda: _catalog(t))

    def call(chunks: list[dict], depth: int = 0) -> list[tuple[dict, int]]:
        text = "\n\n".join(c["text"] for c in chunks)
        try:
            raw, cut = client(f"Name the instances, as JSON.\n\n{catalog}\n\n{text}", None), False
        except Truncated as e:
            raw, cut = e.text, True
        if cut and len(chunks) > 1 and depth < SPLIT_DEPTH:
            half = len(chunks) // 2
            return call(chunks[:half], depth + 1) + call(chunks[half:], depth + 1)
        value = parsed(raw, cut) or {}
        nodes = value.get("nodes", []) if isinstance(value, dict) else value
        return [(n, chunks[0]["chunk_id"]) for n in nodes if isinstance(n, dict) and str(n.get("path", "")).replace("[]", "") in paths]

    handle = lambda x: x if isinstance(x, int) else None
    out = []
    for pos, (n, c) in enumerate(call(chunks)):
        ids = {str(x): str(v) for x, v in (n.get("ids") or {}).items() if v not in (None, "")}
        out.append({"pos": pos, "path": paths[str(n.get("path", "")).replace("[]", "")], "ids": ids, "p": handle(n.get("p")), "i": handle(n.get("i", pos)), "chunk_id": c})
    return out


def skeleton(batches_: DataFrame, key: str, t: Template, factory: ClientFactory) -> DataFrame:
    """(key, batch, pos, path, ids, p, i, chunk_id): named_in for each of batches_ (key, batch, chunks array<struct<chunk_id, text>>)."""
    kind = dict(batches_.dtypes)[key]
    columns = ["pos", "path", "ids", "p", "i", "chunk_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in frames:
            rows = [(k, b, *(r[c] for c in columns)) for k, b, chunks in zip(pdf[key], pdf["batch"], pdf["chunks"]) for r in named_in(client, list(chunks), t)]
            yield pd.DataFrame(rows, columns=[key, "batch", *columns])

    return batches_.select(key, "batch", "chunks").mapInPandas(run, f"`{key}` {kind}, batch int, pos int, path string, ids map<string,string>, p int, i int, chunk_id int")


class Rules:
    """A client without a model: regular expressions for fields of the root, for tests and for sources with a fixed form."""

    def __init__(self, patterns: dict[str, str]):
        import re

        self.patterns = {k: re.compile(p) for k, p in patterns.items()}

    def __call__(self, prompt: str, schema: dict | None) -> str:
        out = {}
        for k, p in self.patterns.items():
            found = p.findall(prompt)
            if found:
                many = (schema or {}).get("properties", {}).get(k, {}).get("type") == "array"
                out[k] = found if many else found[0]
        return json.dumps(out, ensure_ascii=False)


__all__ = ["Client", "Rules", "Truncated", "ask", "contract", "direct", "many_to_one", "named_in", "per_page", "skeleton", "word_count"]
