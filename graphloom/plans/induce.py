"""Templates from what many documents show: votes by aggregation, assembled on the driver, which sees a row a class and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lint import repair_draft
from .template import RANK, Template

MAX_EXAMPLES, MAX_ENUM, RARE_OF = 5, 24, 3
_ROLE = {"property": 0, "edge": 1, "identity": 2}


def canonical(c: Column | str) -> Column:
    """The key under which names of several documents come together."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _rank(table: dict[str, int], c: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c))


def majority(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """(keys..., value): the most frequent value, of equal ones the first by pos."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def elected_root(rows: DataFrame) -> DataFrame:
    """(root): the name with the most votes is_root, of equal ones the first by pos."""
    n = rows.groupBy("name").agg(F.count_if("is_root").alias("votes"), F.min("pos").alias("first"))
    return n.agg(F.max_by("name", F.struct("votes", (-F.col("first")).alias("f"))).alias("root"))


def capped(rows: DataFrame, most: int, root: str | None = None) -> DataFrame:
    """(name, documents) of the names that the most documents have, ties by pos, the root always among them."""
    n = rows.groupBy("name").agg(F.count_distinct("document").alias("documents"), F.min("pos").alias("first"))
    first = [F.col("name") != F.lit(root)] if root is not None else []
    return n.orderBy(*first, F.desc("documents"), "first").limit(most).select("name", "documents")


def round_robin(rows: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(name, examples): examples by turns from each document, in the documents' first order, without repeats."""
    own = Window.partitionBy("name", "document")
    r = rows.withColumn("turn", F.row_number().over(own.orderBy("pos"))).withColumn("d", F.min("pos").over(own))
    first = r.groupBy("name", "example").agg(F.min(F.struct("turn", "d")).alias("at"))
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("at"))).filter(F.col("k") <= most)
    return top.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "example"))), lambda x: x["example"]).alias("examples"))


def widest(rows: DataFrame) -> DataFrame:
    """(name, type): the least type that holds all of them, in the order bool, int, float, str."""
    return rows.groupBy("name").agg(F.max_by("type", F.coalesce(_rank(RANK, "type"), F.lit(3))).alias("type"))


def enums(rows: DataFrame, most: int = MAX_ENUM) -> DataFrame:
    """(name, kind, members): the union of members; those of more than `most` are plain strings."""
    u = rows.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
    return u.withColumn("kind", F.when(F.size("members") > most, "str").otherwise("enum")).select("name", "kind", "members")


def merge_fields(fields: DataFrame) -> DataFrame:
    """One row a class and field of rows (document, cls, field, type, role, is_list, target, label, reference, description, example, pos): first name and description; role identity before edge before property; a list if any says so and it is no identity; the target by majority; a reference only if all agree; and rare if one of three documents or more has it."""
    f = fields.withColumn("ck", canonical("cls")).withColumn("fk", canonical("field"))
    docs = fields.select("document").distinct().agg(F.count("*").alias("all"))
    edge = F.when(F.col("role") == "edge", F.col("pos"))
    g = f.groupBy("ck", "fk").agg(
        F.min_by("cls", "pos").alias("cls"),
        F.min_by("field", "pos").alias("field"),
        F.min_by("description", F.when(F.trim("description") != "", F.col("pos"))).alias("description"),
        F.max_by("role", _rank(_ROLE, "role")).alias("role"),
        F.bool_or("is_list").alias("is_list"),
        F.max_by("type", F.coalesce(_rank(RANK, "type"), F.lit(3))).alias("type"),
        F.min_by("label", edge).alias("label"),
        F.bool_and("reference").alias("reference"),
        F.count_distinct("document").alias("seen"),
        F.min("pos").alias("pos"),
    )
    target = majority(f.filter("role = 'edge' and target is not null"), ["ck", "fk"], "target", "pos")
    examples = round_robin(f.filter("example is not null").select(F.concat_ws(".", "ck", "fk").alias("name"), "document", "example", "pos"))
    out = g.join(target, ["ck", "fk"], "left").join(examples.withColumnRenamed("name", "nk"), F.concat_ws(".", "ck", "fk") == F.col("nk"), "left").crossJoin(F.broadcast(docs))  # one row
    rare = (F.col("all") >= RARE_OF) & (F.col("seen") == 1)
    return out.select("cls", "field", "type", "role", (F.col("is_list") & (F.col("role") != "identity")).alias("is_list"), "target", "label", "reference", F.when(rare, F.concat(F.lit("Rare: "), F.coalesce("description", F.lit("")))).otherwise(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), "pos")


def merged_template(fields: DataFrame, classes: DataFrame, most: int = 24, root: str | None = None) -> tuple[Template, list]:
    """A linted template from fields as merge_fields takes them and classes (document, name, is_root, is_entity, pos)."""
    c = classes.withColumn("name", canonical("name"))
    top = elected_root(c).first().root
    kept = {r.name for r in capped(c, most, root=top).collect()}
    entity = {r.name: r.is_entity for r in majority(c, ["name"], "is_entity", "pos").collect()}
    shown = {r.k: r.name for r in classes.groupBy(canonical("name").alias("k")).agg(F.min_by("name", "pos").alias("name")).collect()}
    models: dict[str, dict] = {k: {"name": shown[k], "fields": [], "entity": bool(entity.get(k)) or k == top} for k in sorted(kept, key=lambda k: (k != top, k))}
    key = lambda s: "".join(x for x in (s or "").lower() if x.isascii() and x.isalnum())
    for r in sorted(merge_fields(fields).collect(), key=lambda r: r.pos):
        if key(r.cls) not in models:
            continue
        edge = r.role == "edge" and key(r.target) in models
        if r.role == "edge" and not edge:
            continue
        models[key(r.cls)]["fields"].append({"name": r.field, "type": models[key(r.target)]["name"] if edge else r.type, "role": r.role, "is_list": r.is_list, "required": r.role == "identity", "label": r.label, "reference": bool(r.reference) and edge, "description": r.description, "examples": list(r.examples)})
    return repair_draft({"root": root or models[top]["name"], "models": list(models.values()), "enums": []})


def grounded_identity(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (document, cls, field, examples) of which some example stands in the document's text."""
    j = candidates.join(texts.select("document", F.lower("text").alias("t")), "document")
    return j.filter(F.exists("examples", lambda e: F.contains(F.col("t"), F.lower(e)))).drop("t")


def novelty(units: DataFrame) -> DataFrame:
    """(unit, new_classes, new_fields): what each unit, in order, has that none before it had. units: (unit, cls, field)."""
    c = units.groupBy(canonical("cls").alias("k")).agg(F.min("unit").alias("unit")).groupBy("unit").agg(F.count("*").alias("new_classes"))
    f = units.groupBy(canonical("cls").alias("k"), canonical("field").alias("m")).agg(F.min("unit").alias("unit")).groupBy("unit").agg(F.count("*").alias("new_fields"))
    return units.select("unit").distinct().join(c, "unit", "left").join(f, "unit", "left").na.fill(0, ["new_classes", "new_fields"])


def saturated_at(units: DataFrame, streak: int = 3, few: int = 1) -> int | None:
    """The unit at which so many in a row had no new class and at most `few` new fields."""
    run = 0
    for r in sorted(novelty(units).collect(), key=lambda r: r.unit):
        run = run + 1 if r.new_classes == 0 and r.new_fields <= few else 0
        if run == streak:
            return r.unit
    return None


def fill_gaps(t: Template, gaps: list[tuple[str, str, str]], client) -> Template:
    """Descriptions and examples for gaps (class, field, kind) from one call of a client; what it leaves out stays as it was."""
    from dataclasses import replace

    answer = client([{"class": c, "field": f, "kind": k} for c, f, k in gaps]) or {}

    def change(m, f):
        got = answer.get(f"{m.name}.{f.name}") or {}
        return replace(f, description=f.description or str(got.get("description") or ""), examples=f.examples or tuple(map(str, got.get("examples") or ())))

    return replace(t, models=tuple(replace(m, fields=tuple(change(m, f) for f in m.fields)) for m in t.models))
