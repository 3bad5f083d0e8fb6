"""Templates from ontologies: JSON Schema, class files in YAML, and triples; closures as iterative joins on written tables."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import components, reach, written
from .lint import repair_draft
from .template import Template

DEPTH, MAX_MODELS = 4, 40
_XSD = {"string": "str", "token": "str", "anyURI": "str", "integer": "int", "int": "int", "long": "int", "nonNegativeInteger": "int", "positiveInteger": "int", "decimal": "float", "double": "float", "float": "float", "number": "float", "boolean": "bool", "date": "date", "dateTime": "datetime"}
_NAMES = ("identifier", "id", "code", "number", "name", "title", "label")


def sniff(text: str) -> str:
    """owl, linkml or jsonschema by content."""
    s = text.lstrip()
    if s.startswith("{"):
        d = json.loads(s)
        if any(k in d for k in ("$schema", "properties", "$defs", "definitions")):
            return "jsonschema"
        if "classes" in d:
            return "linkml"
    elif "@prefix" in s or re.search(r"\ba\s+(owl|rdfs):Class", s) or s.startswith(("<?xml", "<rdf:")):
        return "owl"
    elif re.search(r"(?m)^classes:", s):
        return "linkml"
    raise ValueError("the format of the ontology isn't known")


# -- JSON Schema


def _pointer(doc: dict, ref: str) -> dict:
    at: Any = doc
    for part in ref.removeprefix("#/").split("/"):
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def merged_all_of(doc: dict, schema: dict, active: tuple[str, ...] = ()) -> dict:
    """The schema with $ref followed and allOf united; a reference that is being followed already gives nothing."""
    out: dict[str, Any] = {}
    if ref := schema.get("$ref"):
        if ref in active:
            return {}
        out = merged_all_of(doc, _pointer(doc, ref), (*active, ref)) | {"__ref": ref.rsplit("/", 1)[-1]}
    for part in schema.get("allOf", ()):
        p = merged_all_of(doc, part, active)
        ref = out.get("__ref")
        out = out | {k: v for k, v in p.items() if k not in ("properties", "required", "__ref")} | {"properties": out.get("properties", {}) | p.get("properties", {}), "required": [*out.get("required", []), *p.get("required", [])]}
        if ref:
            out["__ref"] = ref
    own = {k: v for k, v in schema.items() if k not in ("$ref", "allOf")}
    return out | own | {"properties": out.get("properties", {}) | own.get("properties", {}), "required": [*out.get("required", []), *own.get("required", [])]}


def from_json_schema(text: str, root: str | None = None, depth: int = DEPTH) -> dict:
    doc = json.loads(text)
    defs = doc.get("$defs") or doc.get("definitions") or {}
    models: dict[str, dict] = {}
    enums: dict[str, dict] = {}

    def add(name: str, schema: dict, level: int) -> str | None:
        if name in models:
            return name
        if level > depth:
            return None
        models[name] = m = {"name": name, "fields": [], "entity": True, "description": schema.get("description", "")}
        needed = set(schema.get("required", ()))
        for key, raw in schema.get("properties", {}).items():
            s = merged_all_of(doc, raw)
            s = next((merged_all_of(doc, x) for x in s.get("anyOf", s.get("oneOf", ())) if x.get("type") != "null"), s)
            many = s.get("type") == "array"
            item = merged_all_of(doc, s.get("items") or {}) if many else s
            kind = item.get("type")
            kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
            f: dict[str, Any] = {"name": key, "is_list": many, "required": key in needed, "description": raw.get("description", ""), "examples": [str(x) for x in raw.get("examples", ())]}
            if item.get("enum"):
                e = item.get("__ref") or f"{name}_{key}"
                enums[e] = {"name": e, "members": [str(x) for x in item["enum"]]}
                f["type"] = e
            elif item.get("properties"):
                target = add(item.get("__ref") or item.get("title") or key, item, level + 1)
                if target is None:
                    continue
                f |= {"type": target, "role": "edge", "label": key}
            else:
                f["type"] = {"date": "date", "date-time": "datetime"}.get(item.get("format", ""), _XSD.get(kind or "string", "str"))
            m["fields"].append(f)
        _name_identity(m)
        return name

    top = root or doc.get("title") or "Root"
    add(top, merged_all_of(doc, defs[root] if root in defs else doc if doc.get("properties") or doc.get("$ref") or doc.get("allOf") else next(iter(defs.values()))), 0)
    return {"root": top, "models": list(models.values()), "enums": list(enums.values())}


def _name_identity(m: dict) -> None:
    """Without a declared identity the first scalar by name: required ones first."""
    scalars = [f for f in m["fields"] if f.get("role") != "edge" and not f.get("is_list")]
    if any(f.get("role") == "identity" for f in m["fields"]):
        return
    ladder = sorted((f for f in scalars if any(f["name"].lower() == n or f["name"].lower().endswith(("_" + n, n.capitalize())) for n in _NAMES)), key=lambda f: (not f.get("required"), next(i for i, n in enumerate(_NAMES) if n in f["name"].lower())))
    if ladder:
        ladder[0] |= {"role": "identity", "required": True}


# -- classes and slots in YAML


def from_linkml(text: str, root: str | None = None, depth: int = DEPTH) -> dict:
    import yaml

    doc = yaml.safe_load(text)
    classes, slots = doc.get("classes") or {}, doc.get("slots") or {}
    enums = {k: {"name": k, "members": list((v or {}).get("permissible_values") or {})} for k, v in (doc.get("enums") or {}).items()}

    def own(name: str, seen: tuple[str, ...] = ()) -> dict[str, dict]:
        c = classes.get(name) or {}
        out: dict[str, dict] = {}
        for up in [*([c["is_a"]] if c.get("is_a") else []), *(c.get("mixins") or [])]:
            if up not in seen:
                out |= own(up, (*seen, name))
        for s in c.get("slots") or []:
            out[s] = dict(slots.get(s) or {})
        for s, v in (c.get("attributes") or {}).items():
            out[s] = dict(v or {})
        for s, v in (c.get("slot_usage") or {}).items():
            out[s] = out.get(s, {}) | (v or {})
        return out

    tops = [k for k, v in classes.items() if (v or {}).get("tree_root")]
    first = root or (tops[0] if tops else next(iter(classes)))
    level, todo, models = {first: 0}, [first], []
    while todo:
        name = todo.pop(0)
        m = {"name": name, "fields": [], "entity": True, "description": (classes[name] or {}).get("description") or ""}
        for s, v in own(name).items():
            kind = v.get("range") or doc.get("default_range") or "string"
            f = {"name": s, "is_list": bool(v.get("multivalued")), "required": bool(v.get("required") or v.get("identifier")), "description": v.get("description") or ""}
            if kind in classes:
                if kind not in level:
                    if level[name] + 1 > depth:
                        continue
                    level[kind] = level[name] + 1
                    todo.append(kind)
                f |= {"type": kind, "role": "edge", "label": s, "reference": v.get("inlined") is False}
            else:
                f["type"] = kind if kind in enums else _XSD.get(kind, "str")
                if v.get("identifier") or v.get("key"):
                    f["role"] = "identity"
            m["fields"].append(f)
        _name_identity(m)
        models.append(m)
    return {"root": first, "models": models, "enums": [e for e in enums.values() if any(f["type"] == e["name"] for m in models for f in m["fields"])]}


# -- triples


_TOKEN = re.compile(r'\s*(?:#[^\n]*\n|("""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*")(?:@[\w-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?|(<[^>]*>)|(@prefix|@base|[\w.-]*:[\w.-]*(?<!\.)|_:[\w-]+|\[|\]|\(|\)|[;,.]|\ba\b|true|false|[-+]?\d+(?:\.\d+)?))')


def turtle(text: str) -> list[tuple[str, str, str]]:
    """The triples of a Turtle text, names kept as prefix:local where they are written so. Blank nodes are numbered; lists become rdf:first and rdf:rest."""
    tokens, at = [], 0
    text += "\n"
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if not text[at:].strip():
                break
            raise ValueError(f"not Turtle at {text[at : at + 30]!r}")
        at = m.end()
        if tok := m.group(1) or m.group(2) or m.group(3):
            tokens.append(tok.strip('"') if tok.startswith('"') else tok)
    out: list[tuple[str, str, str]] = []
    count = iter(range(10**9))
    i = 0

    def node() -> str:
        nonlocal i
        tok = tokens[i]
        i += 1
        if tok == "[":
            b = f"_:b{next(count)}"
            if tokens[i] != "]":
                properties(b)
            i += 1
            return b
        if tok == "(":
            items = []
            while tokens[i] != ")":
                items.append(node())
            i += 1
            head = "rdf:nil"
            for x in reversed(items):
                b = f"_:b{next(count)}"
                out.extend([(b, "rdf:first", x), (b, "rdf:rest", head)])
                head = b
            return head
        return tok

    def properties(s: str) -> None:
        nonlocal i
        while True:
            p = node()
            p = "rdf:type" if p == "a" else p
            while True:
                out.append((s, p, node()))
                if i < len(tokens) and tokens[i] == ",":
                    i += 1
                else:
                    break
            while i < len(tokens) and tokens[i] == ";":
                i += 1
            if i >= len(tokens) or tokens[i] in (".", "]"):
                return

    while i < len(tokens):
        if tokens[i] == "@prefix":
            i += 4
        elif tokens[i] == "@base":
            i += 3
        else:
            s = node()
            if i < len(tokens) and tokens[i] != ".":
                properties(s)
            i += 1
    return out


def triples(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(turtle(text), "s string, p string, o string")


def ancestors(t: DataFrame) -> DataFrame:
    """(class, ancestor, depth): all classes above each by rdfs:subClassOf, with the fewest steps; a class isn't above itself, in a ring either."""
    up = written(t.filter("p = 'rdfs:subClassOf' and not o like '\\_:%'").select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct())
    return reach(up, up.select(F.col("src").alias("node_id")).distinct()).filter("hops > 0").select(F.col("start").alias("class"), F.col("node_id").alias("ancestor"), F.col("hops").alias("depth"))


def equivalents(t: DataFrame) -> DataFrame:
    """(class, representative): the least of the classes that owl:equivalentClass connects."""
    from ..operators.build import Graph

    e = t.filter("p = 'owl:equivalentClass' and not o like '\\_:%'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    n = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return components(Graph(n, e)).select(F.col("node_id").alias("class"), F.col("component").alias("representative"))


def effective_properties(t: DataFrame) -> DataFrame:
    """(class, property, from_class, depth, range): properties of a class and of those above it; the nearest declaration stands."""
    dom = t.filter("p = 'rdfs:domain'").select(F.col("s").alias("property"), F.col("o").alias("from_class"))
    rng = t.filter("p = 'rdfs:range'").groupBy(F.col("s").alias("property")).agg(F.min("o").alias("range"))
    own = dom.select(F.col("from_class").alias("class"), "property", "from_class", F.lit(0).alias("depth"))
    up = ancestors(t).join(dom, F.col("ancestor") == F.col("from_class")).select("class", "property", "from_class", "depth")
    near = own.unionByName(up).groupBy("class", "property").agg(F.min(F.struct("depth", "from_class")).alias("d"))
    return near.join(rng, "property", "left").select("class", "property", "d.from_class", "d.depth", "range")


def closure(t: DataFrame, root: str, depth: int = DEPTH) -> DataFrame:
    """(class, depth): classes from the root: subclasses at the same depth, ranges of object properties one deeper, up to depth."""
    obj = effective_properties(t).join(t.filter("p = 'rdf:type' and o = 'owl:ObjectProperty'").select(F.col("s").alias("property")), "property", "left_semi")
    steps = written(obj.select(F.col("class").alias("src"), F.col("range").alias("dst"), F.lit(1).alias("w")).unionByName(t.filter("p = 'rdfs:subClassOf'").select(F.col("o").alias("src"), F.col("s").alias("dst"), F.lit(0).alias("w"))).filter("dst is not null").distinct())
    seen = written(t.sparkSession.createDataFrame([(root, 0)], "class string, depth int"))
    while True:
        new = seen.join(steps, seen["class"] == steps.src).select(F.col("dst").alias("class"), (F.col("depth") + F.col("w")).alias("depth")).filter(F.col("depth") <= depth)
        nxt = written(seen.unionByName(new).groupBy("class").agg(F.min("depth").alias("depth")))
        if nxt.exceptAll(seen).isEmpty():
            return nxt
        seen = nxt


def multiply_referenced(edges: DataFrame) -> DataFrame:
    """(target, home, n): targets of two edges (src, label, dst) or more, from several sources, and the first source as their home."""
    return edges.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.min("src").alias("home")).filter("n >= 2 and sources > 1").select("target", "home", "n")


def from_owl(text: str, root: str | None = None, depth: int = DEPTH) -> dict:
    """A draft from the Turtle text of one ontology, which is small: on the driver, by the rules of the functions above."""
    rows = turtle(text)
    by: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o in rows:
        by[s][p].append(o)
    local = lambda x: re.split(r"[/#:]", x.strip("<>"))[-1]
    is_a = lambda s, *kinds: any(k in by[s]["rdf:type"] for k in kinds)
    known = [s for s in list(by) if is_a(s, "owl:Class", "rdfs:Class") and not s.startswith("_:")]
    same = {s: min([s, *(o for o in by[s]["owl:equivalentClass"] if not o.startswith("_:"))]) for s in known}

    def above(c: str) -> list[str]:
        out, todo = [], [c]
        while todo:
            for o in by[todo.pop(0)]["rdfs:subClassOf"]:
                if o in by and not o.startswith("_:") and o not in out and o != c:
                    out.append(o)
                    todo.append(o)
        return out

    props = [s for s in list(by) if is_a(s, "owl:DatatypeProperty", "owl:ObjectProperty", "rdf:Property")]
    targets = {same.get(o, o) for p in props for o in by[p]["rdfs:range"]}
    first = next((c for c in known if root in (c, local(c))), None) if root else next((c for c in known if same[c] not in targets), known[0])
    if first is None:
        raise ValueError(f"no class {root}")
    level, todo, models = {same[first]: 0}, [same[first]], []
    while todo:
        c = todo.pop(0)
        for sub in known:
            if c in by[sub]["rdfs:subClassOf"] and same[sub] not in level:
                level[same[sub]] = level[c]
                todo.append(same[sub])
        lineage = [*reversed(above(c)), c]
        fields: dict[str, dict] = {}
        keys = [k for s in lineage for o in by[s]["owl:hasKey"] for k in _items(by, o)][:2]
        for s in lineage:
            for p in (p for p in props if s in by[p]["rdfs:domain"]):
                rng = next(iter(by[p]["rdfs:range"]), "xsd:string")
                functional = is_a(p, "owl:FunctionalProperty", "owl:InverseFunctionalProperty")
                f: dict[str, Any] = {"name": local(p), "is_list": False, "description": " ".join(by[p]["rdfs:comment"][:1])}
                if is_a(p, "owl:ObjectProperty"):
                    to = same.get(rng, rng)
                    if to not in by or level[c] + 1 > depth and to not in level:
                        continue
                    if to not in level:
                        level[to] = level[c] + 1
                        todo.append(to)
                    f |= {"type": local(to), "role": "edge", "label": local(p), "is_list": not functional}
                else:
                    f["type"] = _XSD.get(local(rng), "str")
                    if p in keys or (not keys and is_a(p, "owl:InverseFunctionalProperty")):
                        f |= {"role": "identity", "required": True}
                fields[f["name"]] = f
        m = {"name": local(c), "fields": list(fields.values()), "entity": True, "description": " ".join(by[c]["rdfs:comment"][:1])}
        _name_identity(m)
        models.append(m)
    inbound: dict[str, list[tuple[str, dict]]] = defaultdict(list)
    for m in models:
        for f in m["fields"]:
            if f.get("role") == "edge":
                inbound[f["type"]].append((m["name"], f))
    for uses in inbound.values():
        if len({a for a, _ in uses}) > 1:
            for _, f in uses[1:]:
                f["reference"] = True
    return {"root": local(same[first]), "models": models, "enums": []}


def _items(by: dict, head: str) -> list[str]:
    out = []
    while head in by and head != "rdf:nil":
        out += by[head]["rdf:first"]
        head = next(iter(by[head]["rdf:rest"]), "rdf:nil")
    return out


def compile_ontology(text: str, kind: str | None = None, root: str | None = None, depth: int = DEPTH, include: list[str] | None = None, exclude: list[str] | None = None, most: int = MAX_MODELS) -> tuple[Template, list]:
    """A linted template from an ontology's text; refuses more than `most` classes."""
    kind = kind or sniff(text)
    draft = {"jsonschema": from_json_schema, "linkml": from_linkml, "owl": from_owl}[kind](text, root, depth)
    gone = {m["name"] for m in draft["models"] if m["name"] != draft["root"] and ((include and m["name"] not in include) or (exclude and m["name"] in exclude))}
    draft["models"] = [m | {"fields": [f for f in m["fields"] if f["type"] not in gone]} for m in draft["models"] if m["name"] not in gone]
    if len(draft["models"]) > most:
        raise ValueError(f"{len(draft['models'])} classes are more than {most}; choose a root, a depth or classes to include")
    return repair_draft(draft)
