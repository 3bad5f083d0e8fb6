"""Templates: which parts of a nested record are nodes, what identifies them, and which edges join them."""

from __future__ import annotations

import hashlib
import json
import keyword
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

SCALARS = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}
RANK = {"bool": 0, "int": 1, "float": 2, "str": 3}


@dataclass(frozen=True)
class Enum:
    name: str
    members: tuple[str, ...]
    synonyms: dict[str, str] = field(default_factory=dict)
    other: str = "OTHER"


@dataclass(frozen=True)
class Field:
    """type: a scalar's name, an enum or a model. role: identity, property or edge."""

    name: str
    type: str = "str"
    role: str = "property"
    is_list: bool = False
    required: bool = False
    label: str | None = None
    reference: bool = False
    closed_catalog: bool = False
    description: str = ""
    examples: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    """entity: its rows are nodes; else a component, which stays inside the node above it. induced: its fields were read from documents, so they ought to have evidence."""

    name: str
    fields: tuple[Field, ...] = ()
    entity: bool = True
    max_instances: int | None = None
    description: str = ""
    induced: bool = False

    @property
    def identity(self) -> list[str]:
        return [f.name for f in self.fields if f.role == "identity"]


@dataclass(frozen=True)
class Place:
    """A node class at a path of the record: path like a.b[].c, parents by path, '' for the root."""

    path: str
    model: str
    identity: tuple[str, ...]
    parent: str | None
    field: str
    is_list: bool
    label: str
    reference: bool = False
    closed_catalog: bool = False


@dataclass(frozen=True)
class Template:
    root: str
    models: tuple[Model, ...]
    enums: tuple[Enum, ...] = ()

    def model(self, name: str) -> Model | None:
        return next((m for m in self.models if m.name == name), None)

    def enum(self, name: str) -> Enum | None:
        return next((e for e in self.enums if e.name == name), None)

    def places(self, references: bool = True) -> list[Place]:
        """The catalog of node classes by path, parents first. Components are passed through; a class that is already above ends its branch."""
        root = self.model(self.root)
        out = [Place("", root.name, tuple(root.identity), None, "", False, "")]

        def walk(m: Model, path: str, parent: str, above: tuple[str, ...]) -> None:
            for f in m.fields:
                target = self.model(f.type)
                if target is None or (f.reference and not references):
                    continue
                at = f"{path}.{f.name}" if path else f.name
                at += "[]" if f.is_list else ""
                if target.entity:
                    if target.name in above:
                        continue
                    out.append(Place(at, target.name, tuple(target.identity), parent, f.name, f.is_list, f.label or f.name, f.reference, f.closed_catalog))
                    if not f.reference:
                        walk(target, at, at, (*above, target.name))
                elif target.name not in above:
                    walk(target, at, parent, (*above, target.name))

        walk(root, "", "", (root.name,))
        return out

    def bottom_up(self) -> list[Place]:
        return sorted(self.places(), key=lambda p: (-p.path.count(".") - (p.path != ""), p.path))

    def identities(self) -> dict[str, list[str]]:
        return {m.name: m.identity for m in self.models if m.entity}

    def bounds(self) -> dict[str, int]:
        return {m.name: m.max_instances for m in self.models if m.max_instances and m.max_instances >= 1}

    def schema(self, model: str | None = None, above: tuple[str, ...] = ()) -> T.StructType:
        """The Spark type of a record; references have their identity fields only, and a cycle ends with them."""
        m = self.model(model or self.root)
        fields = []
        for f in m.fields:
            target = self.model(f.type)
            if target is None:
                kind: T.DataType = SCALARS.get(f.type, T.StringType())
            elif f.reference or target.name in (*above, m.name):
                kind = T.StructType([T.StructField(i.name, SCALARS.get(i.type, T.StringType())) for i in target.fields if i.role == "identity"])
            else:
                kind = self.schema(target.name, (*above, m.name))
            meta = {k: v for k, v in {"role": f.role, "edge_label": f.label, "reference": f.reference, "closed_catalog": f.closed_catalog}.items() if v}
            fields.append(T.StructField(f.name, T.ArrayType(kind) if f.is_list else kind, True, meta))
        return T.StructType(fields)

    def projection(self, path: str) -> T.StructType:
        """What a place holds itself: its model's fields without nested nodes."""
        m = self.model(next(p.model for p in self.places() if p.path == path))
        keep = [f for f in m.fields if (t := self.model(f.type)) is None or not t.entity]
        return replace(self, models=tuple(replace(x, fields=tuple(keep)) if x is m else x for x in self.models)).schema(m.name)

    def schema_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Template:
        models = tuple(Model(m["name"], tuple(Field(**(f | {k: tuple(f.get(k, ())) for k in ("examples", "evidence")})) for f in m.get("fields", ())), m.get("entity", True), m.get("max_instances"), m.get("description", ""), m.get("induced", False)) for m in d["models"])
        enums = tuple(Enum(e["name"], tuple(e["members"]), dict(e.get("synonyms", {})), e.get("other", "OTHER")) for e in d.get("enums", ()))
        return Template(d["root"], models, enums)

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(json.loads(json.dumps(self.to_dict())), sort_keys=False, allow_unicode=True)

    @staticmethod
    def from_yaml(text: str) -> Template:
        import yaml

        return Template.from_dict(yaml.safe_load(text))


def relative(parent: str, child: str) -> str:
    return child[len(parent) :].lstrip(".") if child.startswith(parent) else child


def canonical_path(path: str, allowed: list[str]) -> str | None:
    """The allowed path that equals path when [] is left out."""
    return {a.replace("[]", ""): a for a in allowed}.get(path.replace("[]", ""))


def snake(name: str) -> str:
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"\W+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)).strip("_").lower()


def pascal(name: str) -> str:
    return "".join(w if w.isupper() and len(w) <= 4 else w[:1].upper() + w[1:] for w in re.split(r"[\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)) if w)


RESERVED = {"id", "label", "type", "source", "target", "model_config"}


def field_name(name: str) -> str:
    s = snake(name) or "field"
    s = f"f_{s}" if s[0].isdigit() else s
    return f"{s}_value" if keyword.iskeyword(s) or s in RESERVED else s


def class_name(name: str) -> str:
    s = pascal(name) or "Model"
    return f"M{s}" if s[0].isdigit() or keyword.iskeyword(s) else s


def edge_label(label: str, target: str) -> str:
    """Capitals joined by _; a bare noun gets a verb."""
    s = re.sub(r"\W+", "_", snake(label)).upper().strip("_")
    if not s or s == snake(target).upper():
        return f"HAS_{snake(target).upper()}"
    return s


def label_from_field(name: str, target: str) -> str:
    s = snake(name).upper()
    return s if re.match(r"(HAS|IS|IN|ON|AT|BY|OF|CONTAINS|USES|LOCATED|ISSUED|PLACED|BELONGS|REFERS)(_|$)", s) else f"HAS_{snake(target).upper()}"


def render(t: Template) -> str:
    """A Python module that makes the template again."""
    lines = ["from graphloom.plans.template import Enum, Field, Model, Template", "", "TEMPLATE = Template(", f"    root={t.root!r},", "    models=("]
    for m in t.models:
        lines.append(f"        Model({m.name!r}, (")
        lines += [f"            {f!r}," for f in m.fields]
        lines.append(f"        ), entity={m.entity!r}, max_instances={m.max_instances!r}, description={m.description!r}, induced={m.induced!r}),")
    lines += ["    ),", f"    enums={t.enums!r},", ")", ""]
    return "\n".join(lines)


def from_struct(root: str, schema: T.StructType) -> Template:
    """A template from a Spark type: structs with a field that ends in id, key, number, name or title are nodes, others components."""
    models: dict[str, Model] = {}

    def name_of(kind: T.DataType) -> str:
        return {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}.get(kind.simpleString(), "float" if kind.simpleString().startswith("decimal") else "str")

    def add(name: str, s: T.StructType) -> str:
        name = class_name(name)
        fields, found = [], False
        for x in s.fields:
            kind, many = (x.dataType.elementType, True) if isinstance(x.dataType, T.ArrayType) else (x.dataType, False)
            if isinstance(kind, T.StructType):
                target = add(x.name.rstrip("s") if many else x.name, kind)
                entity = models[target].entity
                fields.append(Field(x.name, target, "edge" if entity else "property", many, label=label_from_field(x.name, target) if entity else None))
            else:
                is_id = not many and not found and re.search(r"(?:^|_)(?:id|key|number|name|title|ref|code)$|key$", x.name) is not None
                found |= is_id
                fields.append(Field(x.name, name_of(kind), "identity" if is_id else "property", many, required=is_id))
        models[name] = Model(name, tuple(fields), entity=found or name == class_name(root))
        return name

    first = add(root, schema)
    return Template(first, tuple(models.values()))


def edge_depths(t: Template, references: bool = True) -> dict[str, int]:
    """The least number of edges from the root to each class."""
    depth, todo = {t.root: 0}, [t.root]
    while todo:
        name = todo.pop(0)
        for f in t.model(name).fields:
            if (m := t.model(f.type)) and (references or not f.reference) and m.name not in depth:
                depth[m.name] = depth[name] + m.entity
                todo.append(m.name)
    return depth


def edges_of(t: Template) -> Iterator[tuple[Model, Field, Model]]:
    for m in t.models:
        for f in m.fields:
            if target := t.model(f.type):
                yield m, f, target
