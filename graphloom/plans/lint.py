"""Rules that a template keeps, each reporting and, where it can, repairing; run until nothing changes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from .template import Enum, Field, Model, Template, class_name, edge_depths, edge_label, edges_of, field_name, label_from_field

MAX_DEPTH, DOC_BUDGET, MAX_PASSES, MAX_ENUM = 4, 240, 20, 24


@dataclass(frozen=True)
class Finding:
    rule: str
    where: str
    message: str
    repaired: bool = False
    level: str = "warning"


Rule = Callable[[Template], tuple[Template, list[Finding]]]


def _fields(t: Template, change: Callable[[Model, Field], Field | None]) -> Template:
    return replace(t, models=tuple(replace(m, fields=tuple(g for f in m.fields if (g := change(m, f)) is not None)) for m in t.models))


def names(t: Template) -> tuple[Template, list[Finding]]:
    """Classes in PascalCase, fields in snake_case, neither reserved, none twice."""
    out, to = [], {}
    for m in t.models:
        to[m.name] = n = class_name(m.name)
        if n != m.name:
            out.append(Finding("naming", m.name, f"class renamed to {n}", True))
    models = []
    for m in t.models:
        seen: set[str] = set()
        fields = []
        for f in m.fields:
            n = field_name(f.name)
            if n in seen:
                out.append(Finding("naming", f"{m.name}.{f.name}", "field dropped, its name is taken", True))
                continue
            seen.add(n)
            if n != f.name:
                out.append(Finding("naming", f"{m.name}.{f.name}", f"field renamed to {n}", True))
            fields.append(replace(f, name=n, type=to.get(f.type, f.type)))
        models.append(replace(m, name=to[m.name], fields=tuple(fields)))
    return replace(t, root=to.get(t.root, t.root), models=tuple(models)), out


def identity(t: Template) -> tuple[Template, list[Finding]]:
    """An entity has one or two scalar identity fields, required and no list; one without becomes a component unless it is the root."""
    out, models = [], []
    for m in t.models:
        ids = [f for f in m.fields if f.role == "identity"]
        fields = m.fields
        for f in ids:
            if f.is_list or t.model(f.type):
                fields = tuple(replace(g, role="edge" if t.model(g.type) else "property") if g is f else g for g in fields)
                out.append(Finding("identity", f"{m.name}.{f.name}", "lists and nested models identify nothing", True))
        ids = [f for f in fields if f.role == "identity"]
        if len(ids) > 2:
            keep = {f.name for f in ids[:2]}
            fields = tuple(replace(f, role="property") if f.role == "identity" and f.name not in keep else f for f in fields)
            out.append(Finding("identity", m.name, "more than two identity fields", True))
        if m.entity and not ids and m.name != t.root:
            out.append(Finding("identity", m.name, "an entity without identity becomes a component", True))
            m = replace(m, entity=False)
        models.append(replace(m, fields=tuple(replace(f, required=True) if f.role == "identity" else f for f in fields)))
    return replace(t, models=tuple(models)), out


def component_edges(t: Template) -> tuple[Template, list[Finding]]:
    """What leads to a component is a property without label; what leads to an entity is an edge."""
    out = []

    def change(m: Model, f: Field) -> Field:
        target = t.model(f.type)
        if target and not target.entity and (f.role != "property" or f.label):
            out.append(Finding("component_edges", f"{m.name}.{f.name}", "components have no edge", True))
            return replace(f, role="property", label=None)
        if target and target.entity and f.role != "edge":
            out.append(Finding("component_edges", f"{m.name}.{f.name}", "a nested entity is an edge", True))
            return replace(f, role="edge")
        return f

    return _fields(t, change), out


def labels(t: Template) -> tuple[Template, list[Finding]]:
    """Edges have labels in capitals."""
    out = []

    def change(m: Model, f: Field) -> Field:
        target = t.model(f.type)
        if not target or not target.entity:
            return f
        want = edge_label(f.label, target.name) if f.label else label_from_field(f.name, target.name)
        if want != f.label:
            out.append(Finding("edge_labels", f"{m.name}.{f.name}", f"label {f.label} becomes {want}", True))
        return replace(f, label=want)

    return _fields(t, change), out


def canonical_home(t: Template) -> tuple[Template, list[Finding]]:
    """A class that several fields lead to has one full home, the first by depth; others are references. One source with several single-valued fields to it stays full."""
    depth, out = edge_depths(t), []
    by: dict[str, list[tuple[Model, Field]]] = {}
    for m, f, target in edges_of(t):
        if target.entity and m.name != target.name:
            by.setdefault(target.name, []).append((m, f))
    refs = set()
    for inbound in by.values():
        full = [(m, f) for m, f in inbound if not f.reference]
        if len(full) < 2 or (len({m.name for m, _ in full}) == 1 and not any(f.is_list for _, f in full)):
            continue
        home = min(full, key=lambda x: (depth.get(x[0].name, 99), full.index(x)))
        for m, f in full:
            if (m, f) != home:
                refs.add((m.name, f.name))
                out.append(Finding("canonical_home", f"{m.name}.{f.name}", "becomes a reference", True))
    return _fields(t, lambda m, f: replace(f, reference=True) if (m.name, f.name) in refs else f), out


def references(t: Template) -> tuple[Template, list[Finding]]:
    """References lead to entities with identity; closed catalogs are on references."""
    out = []

    def change(m: Model, f: Field) -> Field:
        target = t.model(f.type)
        if f.reference and not (target and target.entity and target.identity):
            out.append(Finding("reference_targets", f"{m.name}.{f.name}", "a reference needs an identified entity", True))
            return replace(f, reference=False, closed_catalog=False)
        if f.closed_catalog and not f.reference:
            out.append(Finding("closed_catalog", f"{m.name}.{f.name}", "only references can be closed", True))
            return replace(f, closed_catalog=False)
        return f

    return _fields(t, change), out


def closed_homes(t: Template) -> tuple[Template, list[Finding]]:
    """A closed catalog's members have a home: an edge to their class that isn't a reference, or the class is the root."""
    homes = {f.type for m in t.models for f in m.fields if not f.reference} | {t.root}
    bad = {(m.name, f.name): f.type for m in t.models for f in m.fields if f.closed_catalog and f.type not in homes}
    return _fields(t, lambda m, f: replace(f, closed_catalog=False) if (m.name, f.name) in bad else f), [Finding("closed_catalog", f"{a}.{b}", f"{c} has no other home, so it can't be closed", True) for (a, b), c in bad.items()]


def sentence_order(t: Template) -> tuple[Template, list[Finding]]:
    """In descriptions too long to be read whole what a class is comes first, then what it isn't, then how many there are."""
    out = []

    def kind(s: str) -> int:
        if re.search(r"(?i)\bnot\b|n't\b|\bn['’]est\b", s):
            return 1
        return 2 if re.search(r"(?i)\d|\bat most\b|\bmaximum\b|\bup to\b", s) else 0

    def ordered(m: Model) -> Model:
        whole = " ".join(m.description.split())
        if len(whole) <= DOC_BUDGET:
            return m
        new = " ".join(sorted(re.split(r"(?<=[.!?]) ", whole), key=kind))
        if new != whole:
            out.append(Finding("sentence_order", m.name, "sentences put in order, as the last ones aren't read", True))
        return replace(m, description=new) if new != whole else m

    return replace(t, models=tuple(ordered(m) for m in t.models)), out


def evidence(t: Template) -> tuple[Template, list[Finding]]:
    """Fields that were read from documents have a quotation or an example, or are marked as rare."""
    return t, [Finding("evidence", f"{m.name}.{f.name}", "no quotation and no example", level="info") for m in t.models if m.induced for f in m.fields if not f.evidence and not f.examples and not f.description.startswith("Rare:")]


def reachable(t: Template) -> tuple[Template, list[Finding]]:
    depth = edge_depths(t)
    lost = [m.name for m in t.models if m.name not in depth]
    return replace(t, models=tuple(m for m in t.models if m.name in depth)), [Finding("reachability", n, "not reached from the root", True) for n in lost]


def nesting(t: Template) -> tuple[Template, list[Finding]]:
    deep = {n: d for n, d in edge_depths(t, references=False).items() if d > MAX_DEPTH}
    return t, [Finding("nesting_depth", n, f"{d} edges below the root") for n, d in deep.items()]


def cycles(t: Template) -> tuple[Template, list[Finding]]:
    """An edge back to a class above becomes a reference."""
    back = set()

    def walk(name: str, above: tuple[str, ...]) -> None:
        for f in t.model(name).fields:
            m = t.model(f.type)
            if m and not f.reference:
                if m.name in (*above, name):
                    back.add((name, f.name))
                else:
                    walk(m.name, (*above, name))

    if t.model(t.root):
        walk(t.root, ())
    ok = lambda m, f: (m.name, f.name) in back and t.model(f.type).entity and t.model(f.type).identity
    out = [Finding("cycles", f"{a}.{b}", "leads back to a class above", ok(t.model(a), next(f for f in t.model(a).fields if f.name == b))) for a, b in sorted(back)]
    return _fields(t, lambda m, f: replace(f, reference=True) if ok(m, f) else f), out


def digit_honesty(t: Template) -> tuple[Template, list[Finding]]:
    """A field named as a number has examples with digits."""
    out = [Finding("digit_honesty", f"{m.name}.{f.name}", "named as a number, examples without digits") for m in t.models for f in m.fields if f.role == "identity" and re.search(r"(number|no|num|code)$", f.name) and f.examples and not any(re.search(r"\d", x) for x in f.examples)]
    return t, out


def invented_ids(t: Template) -> tuple[Template, list[Finding]]:
    """Identity examples like id_1 or ent-001 are made up."""
    return t, [Finding("invented_ids", f"{m.name}.{f.name}", f"example {x}") for m in t.models for f in m.fields if f.role == "identity" for x in f.examples if re.fullmatch(r"(?i)(id|ent|entity|item|node|obj)[-_]?\d+", x)]


def cardinality(t: Template) -> tuple[Template, list[Finding]]:
    return t, [Finding("cardinality", m.name, "a bound of instances needs a sentence about how many there are") for m in t.models if m.max_instances and not re.search(r"(?i)\b(one|two|three|few|at most|up to|exactly|\d+)\b", m.description)]


def descriptions(t: Template) -> tuple[Template, list[Finding]]:
    """One line each, without mark-up, within the budget."""
    out = []

    def scrub(where: str, s: str) -> str:
        clean = re.sub(r"\s+", " ", re.sub(r"[`*#<>]", "", s)).strip()
        if len(clean) > DOC_BUDGET:
            clean = clean[:DOC_BUDGET].rsplit(" ", 1)[0]
        if clean != s:
            out.append(Finding("descriptions", where, "scrubbed", True))
        return clean

    models = tuple(replace(m, description=scrub(m.name, m.description), fields=tuple(replace(f, description=scrub(f"{m.name}.{f.name}", f.description)) for f in m.fields)) for m in t.models)
    return replace(t, models=models), out


def examples(t: Template) -> tuple[Template, list[Finding]]:
    return t, [Finding("identity_examples", f"{m.name}.{f.name}", "no example", level="info") for m in t.models if m.entity for f in m.fields if f.role == "identity" and not f.examples]


def role_data(t: Template) -> tuple[Template, list[Finding]]:
    """Data of a role, like a start date, belongs on a component between two entities."""
    return t, [Finding("role_data", f"{m.name}.{f.name}", "looks like data of a relation", level="info") for m in t.models if m.entity for f in m.fields if re.search(r"_(role|since|until|share)$", f.name)]


def root_lists(t: Template) -> tuple[Template, list[Finding]]:
    """No two list fields of the root hold the same class under one label."""
    root = t.model(t.root)
    seen = Counter((f.type, f.label) for f in root.fields if f.is_list and t.model(f.type)) if root else {}
    return t, [Finding("root_lists", t.root, f"{n} lists of {k[0]} under one label") for k, n in seen.items() if n > 1]


def enums(t: Template) -> tuple[Template, list[Finding]]:
    """Enums of more than 24 members become strings."""
    large = {e.name for e in t.enums if len(e.members) > MAX_ENUM}
    t2 = replace(t, enums=tuple(e for e in t.enums if e.name not in large))
    return _fields(t2, lambda m, f: replace(f, type="str") if f.type in large else f), [Finding("enums", n, "demoted to str", True) for n in sorted(large)]


def unknown_types(t: Template) -> tuple[Template, list[Finding]]:
    from .template import SCALARS

    known = set(SCALARS) | {m.name for m in t.models} | {e.name for e in t.enums}
    bad = [(m.name, f.name, f.type) for m in t.models for f in m.fields if f.type not in known]
    return _fields(t, lambda m, f: replace(f, type="str", role="property" if f.role == "edge" else f.role) if f.type not in known else f), [Finding("types", f"{a}.{b}", f"{c} isn't known", True) for a, b, c in bad]


RULES: tuple[Rule, ...] = (names, unknown_types, enums, identity, component_edges, labels, references, cycles, canonical_home, closed_homes, reachable, nesting, digit_honesty, invented_ids, cardinality, sentence_order, descriptions, root_lists, examples, role_data, evidence)


def lint(t: Template, repair: bool = True, strict: bool = False) -> tuple[Template, list[Finding]]:
    """The repaired template and all findings. strict: raises on any repair, or when not repairing on anything that isn't mere information."""
    if t.model(t.root) is None:
        raise ValueError(f"the root {t.root} isn't a model")
    found: list[Finding] = []
    for _ in range(MAX_PASSES):
        changed = False
        report = []
        for rule in RULES:
            new, some = rule(t)
            report += some
            if repair and new != t:
                t, changed = new, True
        found += [f for f in report if f not in found]
        if not changed:
            break
    else:
        raise RuntimeError("the rules don't come to an end")
    if strict and any(f.repaired if repair else f.level != "info" for f in found):
        raise ValueError("; ".join(f"{f.rule} {f.where}: {f.message}" for f in found))
    return t, found


def repair_draft(draft: dict, strict: bool = False) -> tuple[Template, list[Finding]]:
    """A valid template from a loose dict: unknown keys are dropped and absent ones have their defaults."""
    keys = Field.__dataclass_fields__
    models = [{"name": str(m.get("name", "Model")), "entity": bool(m.get("entity", True)), "max_instances": m.get("max_instances"), "description": str(m.get("description") or ""), "fields": [{k: v for k, v in f.items() if k in keys} for f in m.get("fields", ()) if f.get("name")]} for m in draft.get("models", ())]
    if not models:
        raise ValueError("a template needs a model")
    known = {m["name"] for m in models}
    root = draft.get("root") if draft.get("root") in known else models[0]["name"]
    return lint(Template.from_dict({"root": root, "models": models, "enums": [e for e in draft.get("enums", ()) if e.get("members")]}), strict=strict)


__all__ = ["RULES", "Enum", "Finding", "lint", "repair_draft"]
