"""Operators and functions that SQL doesn't cover, against worked examples and plain versions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import coerce, json_repair, text
from graphloom.operators import alias, attach, chunk, clean, evaluate, extract, merge, provenance, stats
from graphloom.operators.build import Graph, build, with_reverse
from graphloom.pipeline import Config, merge_runs, run
from graphloom.plans import induce, ontology, verify
from graphloom.plans.lint import lint
from graphloom.plans.template import Enum, Field, Model, Template, render
from graphloom.sinks import cypher, files, report
from graphloom.sources import detect
from graphloom.sources import files as sources
from graphloom.streaming import incremental

INVOICE = Template(
    "Invoice",
    (
        Model("Invoice", (Field("number", "str", "identity", required=True), Field("total", "float"), Field("status", "Status"), Field("seller", "Party", "edge", label="ISSUED_BY"), Field("address", "Address"), Field("lines", "Line", "edge", True, label="CONTAINS_LINE"))),
        Model("Party", (Field("name", "str", "identity", required=True), Field("city"))),
        Model("Address", (Field("street"), Field("owner", "Party", "edge", label="OWNED_BY")), entity=False),
        Model("Line", (Field("item", "str", "identity", required=True), Field("quantity", "int"))),
    ),
    (Enum("Status", ("OPEN", "PAID", "OTHER"), {"settled": "PAID"}),),
)
RECORD = {"number": "A-1", "total": 10.5, "status": "PAID", "seller": {"name": "The Acme Co", "city": ""}, "address": {"street": "Main", "owner": {"name": "acme co", "city": "Paris"}}, "lines": [{"item": "bolt", "quantity": 2}, {"item": "Bolt!", "quantity": 3}, {"item": "nut", "quantity": None}]}


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("given", "want"),
    [("John Doe", "JOHN_DOE"), ("The Company", "COMPANY"), ("Company's Products", "COMPANY_PRODUCTS"), ("The ", ""), (None, ""), ("", ""), ("café-crème", "CAFE_CREME"), ("An apple_a  day", "APPLE_A_DAY"), ("ﬁne", "FINE")],
)
def test_normalize_name(spark, given, want):
    assert one(spark, text.normalize_name, given) == want


@pytest.mark.parametrize(("given", "want"), [("run_1", "run1"), ("Run-1", "run1"), ("  ", ""), (None, ""), ("Straße", "strasse"), ("É. Œ", "e"), ("日本", ""), ("½", "12")])
def test_fold_id(spark, given, want):
    assert one(spark, text.fold_id, given) == want


def test_text_functions(spark):
    assert one(spark, text.parse_number, "1 500,00") == 1500.0 and one(spark, text.parse_number, "$1,500.50") == 1500.5 and one(spark, text.parse_number, "none") is None
    assert one(spark, text.currency_code, "€") == "EUR" and one(spark, text.currency_code, "usd") == "USD" and one(spark, text.currency_code, "?") is None
    assert one(spark, lambda c: text.enum_member(c, ["OPEN", "PAID"], {"settled": "PAID"}), "Settled") == "PAID"
    assert one(spark, lambda c: text.enum_member(c, ["OPEN"]), "gone") == "OTHER"
    assert one(spark, text.string_list, " a, b ,,c") == ["a", "b", "c"]
    assert one(spark, text.snake_case, "HTTPServerName") == "http_server_name" and one(spark, text.title_key, "unit_priceTotal") == "Unit Price Total"
    assert one(spark, lambda c: text.merge_sentences(c, F.lit("One. Two. Three.")), "Two. Zero.") == "Two. Zero. One. Three."
    assert one(spark, text.page_furniture, "<page_header>A</page_header>x<page_footer>B</page_footer><page_header>A</page_header>") == "A\nB"
    assert one(spark, text.without_control, "a\x00b\x0bc\td") == "abc\td"
    assert one(spark, text.file_name, " a/b:c?.txt. ") == "a_b_c_.txt"
    assert spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>").select(text.jaccard("x", "y").alias("j")).collect()[0].j == pytest.approx(1 / 3)
    f = spark.createDataFrame([("b a", "a b"), (None, "x")], "x string, y string").select(text.fuzzy_similarity("x", "y").alias("s")).collect()
    assert f[0].s == 1.0 and f[1].s is None


def test_build_walks_components_and_folds_identities(spark):
    df = spark.createDataFrame([(1, RECORD)], "n long, r " + INVOICE.schema().simpleString()).select("n", "r.*")
    g = with_reverse(build(df, INVOICE, "n"), {"CONTAINS_LINE": "LINE_OF"})
    n = {(r["class"], r.attrs.get("name") or r.attrs.get("item") or r.attrs.get("number")): r for r in g.nodes.collect()}
    assert set(n) == {("Invoice", "A-1"), ("Party", "The Acme Co"), ("Line", "bolt"), ("Line", "nut")}
    assert n["Party", "The Acme Co"].attrs["city"] == "Paris"  # the first value that isn't empty
    assert n["Line", "bolt"].attrs["quantity"] == "2"
    labels = sorted(r.label for r in g.edges.collect())
    assert labels == ["CONTAINS_LINE"] * 2 + ["LINE_OF"] * 2 + ["OWNED_BY"]  # of two labels on one pair the last stands


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, c, p, a) for p, (i, c, a) in enumerate(nodes)], "node_id string, class string, pos long, attrs map<string,string>")
    e = spark.createDataFrame([(s, d, lab, p, closed) for p, (s, d, lab, closed) in enumerate(edges)], "src string, dst string, label string, pos long, closed boolean")
    return Graph(n, e)


def test_closed_catalog_and_bounds(spark):
    g = graph(spark, [("r", "Root", {"a": "1"}), ("p", "Pool", {"n": "1"}), ("q", "Pool", {"n": "2"})], [("r", "p", "COVERS", False), ("r", "q", "EXCLUDES", True), ("r", "p", "EXCLUDES", True)])
    kept, dropped = clean.closed_catalogs(g)
    assert {r.node_id for r in kept.nodes.collect()} == {"r", "p"} and [r.dst for r in dropped.collect()] == ["q"]
    s = graph(spark, [("r", "Report", {"t": "x"}), *((f"s{i}", "Segment", {k: "v" for k in "abc"[: i + 1]} | {"id": "1"}) for i in range(3)), ("s9", "Segment", {"a": "v"})], [("r", f"s{i}", "HAS", False) for i in (0, 1, 2, 9)])
    bounded, gone = clean.cardinality_bounds(s, {"Segment": 2}, ["Report"])
    assert {r.node_id for r in gone.collect()} == {"s0", "s9"} and bounded.edges.count() == 2
    assert {r.reason for r in gone.collect()} == {"cardinality_bound"}


def test_alias_proposals_need_a_confirmation(spark):
    t = spark.createDataFrame([("c", i, x) for i, x in enumerate(["attentat", "attentatetactesdeterrorisme", "article5", "article50", "alpha", "beta", "alphabeta"])], "class string, id int, text string")
    assert [(r.superset, r.base) for r in alias.containment(t, ["class"]).collect()] == [(1, 0)]
    g = graph(spark, [("a", "C", {"name": "acme"}), ("b", "C", {"name": "acme france", "city": "Paris"}), ("r", "R", {"x": "1"})], [("r", "a", "HAS", False), ("b", "r", "IN", False)])
    p = alias.propose(g, {"C": ["name"]})
    none, report_ = alias.applied(g, p, spark.createDataFrame([], "a string, b string"))
    assert none.nodes.count() == 3 and report_.count() == 0
    out, report_ = alias.applied(g, p, spark.createDataFrame([("a", "b"), ("a", "r")], "a string, b string"))
    assert {r.node_id for r in out.nodes.collect()} == {"b", "r"}
    assert {(r.a, r.b, r.outcome) for r in report_.collect()} == {("a", "b", "merged"), ("a", "r", "not proposed")}
    assert {(r.src, r.dst) for r in out.edges.collect()} == {("r", "b"), ("b", "r")}


def merged(spark, *graphs, **options):
    g, audit = merge.merge_graphs(list(graphs), **options)
    return {r.node_id: r.attrs for r in g.nodes.collect()}, g, audit


def test_merge_keeps_the_first_and_records_the_rest(spark):
    a = graph(spark, [("x", "P", {"role": "chief", "city": "", "description": "One. Two.", "tags": '["a"]'})], [])
    b = graph(spark, [("x", "P", {"role": "clerk", "city": "Rome", "description": "Two. Three.", "tags": '["b","a"]'})], [])
    attrs, _, audit = merged(spark, a, b, split=False)
    assert attrs["x"]["role"] == "chief" and attrs["x"]["city"] == "Rome" and attrs["x"]["description"] == "One. Two. Three."
    assert json.loads(attrs["x"]["tags"]) == ["a", "b"]
    assert [(r.key, r.kept, r.dropped) for r in audit["conflicts"].collect()] == [("role", "chief", "clerk")]
    again, _, audit2 = merged(spark, a, a, split=False)
    assert again["x"]["role"] == "chief" and audit2["conflicts"].count() == 0


def test_weak_identities_are_split_and_shared_ones_fold(spark):
    inv = lambda ref, q: graph(spark, [(f"i{ref}", "Invoice", {"ref": ref}), ("line1", "Line", {"quantity": q}), ("acme", "Party", {"name": "acme"})], [(f"i{ref}", "line1", "HAS", False), (f"i{ref}", "acme", "BY", False)])
    attrs, g, audit = merged(spark, inv("1", "5"), inv("2", "7"))
    assert set(attrs) == {"i1", "i2", "acme", "line1", "line1__src_1"} and audit["splits"].count() == 1
    assert ("i2", "line1__src_1") in {(r.src, r.dst) for r in g.edges.collect()}


def test_deep_merge():
    a = {"n": 1, "d": {"x": 1}, "items": [{"id": 1, "v": "a"}], "tags": ["p"], "description": "One."}
    b = {"n": 2, "d": {"y": 2}, "items": [{"id": 1, "w": "b"}, {"id": 2}], "tags": ["q", "p"], "description": "One. Two.", "e": None}
    assert merge.deep_merge(a, b) == {"n": 2, "d": {"x": 1, "y": 2}, "items": [{"id": 1, "v": "a", "w": "b"}, {"id": 2}], "tags": ["p", "q"], "description": "One. Two."}


@pytest.mark.parametrize("limit", [3, 8, 40])
def test_chunks_lose_no_word_and_keep_the_limit(limit):
    t = "One two three. Four five six seven eight nine ten! Eleven.\n\nTwelve thirteen " + "x" * 50
    parts = chunk.split_text(t, limit)
    assert all(chunk.word_count(p) <= limit for p in parts)
    assert "".join("".join(parts).split()) == "".join(t.split())
    assert chunk.split_text("  ") == [] == chunk.split_text(None) and chunk.split_text("a b", 5) == ["a b"]
    assert chunk.split_chars("abcdefgh", 3, len) == ["ab", "cd", "ef", "gh"]


def test_batches_are_greedy(spark):
    sizes = [40, 40, 5, 5, 60, 1]
    c = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k int, chunk_id int, token_count int")
    assert [r.batch for r in chunk.batches(c, "k", 50).orderBy("chunk_id").collect()] == [0, 1, 1, 1, 2, 3]
    assert [r.batch for r in chunk.batches(c.filter("token_count = 40"), "k", 50).orderBy("chunk_id").collect()] == [0, 1]


def test_chunk_queries_agree_with_the_plain_version(spark, small):
    from graphloom import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got: dict[int, list] = {}
    for r in queries.QUERIES["chunks"](spark, small).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {k: v for k, t in docs.items() if (v := chunk.split_text(t, 256))}
    rows = queries.QUERIES["chunk_batches"](spark, small).orderBy("doc_id", "chunk_id").collect()
    batch: dict[int, list] = {}
    for r in rows:
        batch.setdefault(r.doc_id, []).append(r.batch)
    for k, t in docs.items():
        want, used, b = [], 0, -1
        for p in chunk.split_text(t, 64):
            n = chunk.word_count(p)
            if b < 0 or used + n > 400:
                b, used = b + 1, 0
            used += n
            want.append(b)
        assert batch.get(k, []) == want
    assert all(json.loads(r.json) for r in queries.QUERIES["repaired_json"](spark, small).collect())


def test_anchors(spark):
    v = spark.createDataFrame([("Widget Pro",), ("big widget pro spec",), ("ab",), ("123",), ("1234",), ("often",)], "value string")
    c = spark.createDataFrame([(0, "nothing here 123 1234"), (1, "The BIG widget pro spec sheet."), *((10 + i, "often said") for i in range(7))], "chunk_id int, text string")
    got = {(r.value, r.chunk_id, r.start, r.end) for r in provenance.anchors(v, c, []).collect()}
    assert got == {("Widget Pro", 1, 8, 18), ("big widget pro spec", 1, 4, 23), ("1234", 0, 17, 21)}


def test_binding_ladder(spark):
    n = spark.createDataFrame([("a", "p", "k1", "one"), ("b", "p", "k9", "alpha beta"), ("c", "p", "k8", "zzz"), ("d", "p", "k7", "yyy")], "node_id string, path string, key string, text string")
    e = spark.createDataFrame([("p", "k1", "one", [1]), ("p", "k2", "alpha", [2])], "path string, key string, text string, chunk_ids array<int>")
    h = spark.createDataFrame([("c", 7), ("a", 9)], "node_id string, chunk_id int")
    assert {(r.node_id, r.kind, tuple(r.chunk_ids)) for r in provenance.bind(n, e, h).collect()} == {("a", "exact", (1,)), ("b", "fuzzy", (2,)), ("c", "verbatim", (7,)), ("d", "unresolved", ())}


def test_parent_ladder(spark):
    p = spark.createDataFrame([(1, "a", "a1", "ka", "alpha", [1], 0, 0), (1, "a", "a2", "kb", "beta", [2], 1, 0), (1, "s", "s1", "ks", "solo", [5], 0, 3)], "document int, path string, parent string, key string, text string, chunk_ids array<int>, batch int, pos int")
    rows = [(1, "c1", "", None, None, [1], 0, 1, False), (1, "c2", "a", "kb", "beta", [9], 0, 2, False), (1, "c3", "s", "no", "no", [9], 0, 2, False), (1, "c4", "a", None, "alpha one", [9], 9, 2, False), (1, "c5", "a", None, "none", [2], 9, 2, False), (1, "c6", "a", None, "none", [9], 1, 2, False), (1, "c7", "a", None, "none", [9], 9, 2, False)]
    c = spark.createDataFrame(rows, "document int, child string, parent_path string, parent_key string, parent_text string, chunk_ids array<int>, batch int, pos int, single boolean")
    out, made = attach.attach(c, p)
    got = {r.child: (r.parent, r.rung) for r in out.collect()}
    assert got == {"c1": ("", "root"), "c2": ("a2", "exact"), "c3": ("s1", "single"), "c4": ("a1", "fuzzy"), "c5": ("a2", "chunk"), "c6": ("a2", "batch"), "c7": ("placeholder|a|none", "placeholder")}
    assert made.count() == 1
    assert {r.rung for r in attach.attach(c, p, required=True)[0].filter("child = 'c7'").collect()} == {"dropped"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('Here:\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
        ('{"a": , "b": 2,}', {"a": None, "b": 2}),
        ('{"a": [{"b": 1} {"b": 2}]}', {"a": [{"b": 1}, {"b": 2}]}),
        ('{"a": [{"b": 1}, {"b": 2', {"a": [{"b": 1}, {"b": 2}]}),
        ('{"a": 1, "b": "open', {"a": 1}),
        ('{"a": "bad \\q escape"}', {"a": "bad \\q escape"}),
        ("no json", None),
        ("", None),
        (None, None),
    ],
)
def test_json_repair(raw, want):
    got = json_repair.repair(raw)
    assert (None if got is None else json.loads(got)) == want or (want == {"a": 1} and json.loads(got)["a"] == 1)


def test_salvage(spark):
    raw = {"number": 17, "total": "1 500,00", "status": "settled", "seller": "Acme", "lines": {"item": "bolt", "quantity": "3 pcs"}}
    out, notes = coerce.salvage(raw, INVOICE)
    assert out["number"] == "17" and out["total"] == 1500.0 and out["status"] == "PAID" and out["seller"]["name"] == "Acme" and out["lines"] == [{"item": "bolt", "quantity": 3}]
    assert any("to list" in n for n in notes)
    out, _ = coerce.salvage({"number": "1", "lines": [{"quantity": 1}, {"item": "x"}]}, INVOICE)
    assert [x["item"] for x in out["lines"]] == ["x"]
    df = spark.createDataFrame([(1, json.dumps(raw)), (2, "nope"), (3, None)], "k int, j string")
    rows = {r.k: r for r in coerce.salvaged(df, "j", INVOICE, ["k"]).collect()}
    assert rows[1].record.seller.name == "Acme" and rows[2].record is None and rows[3].notes == ["unreadable"]


def test_extraction_with_clients(spark):
    calls = []

    class Flaky:
        def __call__(self, prompt, schema):
            calls.append(schema is None)
            if schema is not None:
                raise extract.Truncated("")
            return '{"number": "9", "total": 3}'

    assert extract.ask(Flaky(), "text", INVOICE)["number"] == "9" and calls == [False, True]
    docs = spark.createDataFrame([(1, "Invoice no: A7"), (2, None), (3, "nothing")], "k long, text string")
    got = {r.k: r.record for r in extract.direct(docs, "k", INVOICE, lambda: extract.Rules({"number": r"no: (\w+)"})).collect()}
    assert got[1].number == "A7" and got[2] is None and got[3] is None
    parts = spark.createDataFrame([(1, 0, "no: A7"), (1, 1, "no: A7 item: nut"), (1, 2, None)], "k long, o int, text string")
    r = extract.many_to_one(parts, "k", "o", INVOICE, lambda: extract.Rules({"number": r"no: (\w+)"})).collect()
    assert len(r) == 1 and r[0].record.number == "A7"


def test_skeleton_halves_what_is_truncated(spark):
    class Short:
        def __call__(self, prompt, schema):
            text_ = prompt.rsplit("\n\n", 2)[-1]
            if "one" in prompt and "two" in prompt:
                raise extract.Truncated("")
            return json.dumps({"nodes": [{"i": 0, "path": "lines", "ids": {"item": text_}, "p": None}, {"path": "unknown"}]})

    b = spark.createDataFrame([(1, 0, [(0, "one"), (1, "two")])], "k long, batch int, chunks array<struct<chunk_id:int,text:string>>")
    rows = extract.skeleton(b, "k", INVOICE, Short).collect()
    assert [(r.path, r.ids["item"], r.chunk_id) for r in rows] == [("lines[]", "one", 0), ("lines[]", "two", 1)]


def test_evaluation(spark):
    t = spark.createDataFrame([("A", "k1", "acme france", {"x": "1"}), ("A", "k2", "beta", {"x": "2", "y": "3"})], "class string, key string, text string, attrs map<string,string>")
    g = spark.createDataFrame([("A", "g1", "acme", {"x": "1"}), ("A", "g2", "other", {"x": "2", "y": "3"})], "class string, key string, text string, attrs map<string,string>")
    assert [(r.truth_key, r.key) for r in evaluate.relaxed_pairs(t, g).collect()] == [("k1", "g1")]
    assert {(r.truth_key, r.key, r.score) for r in evaluate.aligned_pairs(t, g).collect()} == {("k2", "g2", 2.0), ("k1", "g1", 1.0)}
    r = evaluate.strict(t, g).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (0, 2, 2, 0.0)


def test_templates(spark):
    t, findings = lint(INVOICE)
    assert Template.from_yaml(t.to_yaml()) == t and verify.verify(spark, t) == []
    scope: dict = {}
    exec(render(t), scope)  # noqa: S102
    assert scope["TEMPLATE"] == t
    again, _ = verify.reverse("Invoice", t.schema())
    assert again.root == "Invoice" and {"Invoice", "Line"} <= {m.name for m in again.models}


OWL = """@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Library a owl:Class ; rdfs:comment "A library." . :Book a owl:Class ; owl:hasKey ( :isbn ) . :Novel a owl:Class ; rdfs:subClassOf :Book . :Saga a owl:Class ; rdfs:subClassOf :Novel .
:Author a owl:Class ; owl:equivalentClass :Writer . :Writer a owl:Class .
:name a owl:DatatypeProperty ; rdfs:domain :Library, :Author ; rdfs:range xsd:string . :isbn a owl:DatatypeProperty ; rdfs:domain :Book ; rdfs:range xsd:string . :pages a owl:DatatypeProperty ; rdfs:domain :Book ; rdfs:range xsd:integer .
:holds a owl:ObjectProperty ; rdfs:domain :Library ; rdfs:range :Book . :by a owl:ObjectProperty, owl:FunctionalProperty ; rdfs:domain :Book ; rdfs:range :Author .
"""
SCHEMA = {"title": "Order", "type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "state": {"enum": ["new", "done"]}, "buyer": {"$ref": "#/$defs/Person"}, "items": {"type": "array", "items": {"allOf": [{"$ref": "#/$defs/Base"}, {"properties": {"qty": {"type": "integer"}}}]}}}, "$defs": {"Person": {"type": "object", "properties": {"name": {"type": "string"}, "friend": {"$ref": "#/$defs/Person"}}}, "Base": {"type": "object", "properties": {"code": {"type": "string"}}}}}
LINKML = "classes:\n  Container:\n    tree_root: true\n    attributes:\n      name: {identifier: true}\n      things: {range: Thing, multivalued: true}\n  Named:\n    attributes:\n      id: {identifier: true}\n  Thing:\n    is_a: Named\n    attributes:\n      size: {range: integer}\n"


def test_ontologies(spark):
    assert [ontology.sniff(x) for x in (OWL, json.dumps(SCHEMA), LINKML)] == ["owl", "jsonschema", "linkml"]
    t, _ = ontology.compile_ontology(OWL)
    assert t.root == "Library" and t.model("Book").identity == ["isbn"] and t.model("Author").identity == ["name"]
    drafted = {m["name"]: [f["name"] for f in m["fields"]] for m in ontology.from_owl(OWL)["models"]}
    assert drafted["Saga"] == drafted["Novel"] == drafted["Book"]  # classes below inherit; lint drops those that no edge leads to
    t, _ = ontology.compile_ontology(json.dumps(SCHEMA))
    assert t.root == "Order" and t.model("Person").identity == ["name"] and len(t.enums) == 1
    t, _ = ontology.compile_ontology(LINKML)
    assert t.root == "Container" and t.model("Thing").identity == ["id_value"]  # id is a reserved name
    d = ontology.triples(spark, OWL)
    assert {(r["class"], r.ancestor, r.depth) for r in ontology.ancestors(d).collect()} == {(":Novel", ":Book", 1), (":Saga", ":Novel", 1), (":Saga", ":Book", 2)}
    assert {(r["class"], r.depth) for r in ontology.closure(d, ":Library").collect()} == {(":Library", 0), (":Book", 1), (":Novel", 1), (":Saga", 1), (":Author", 2)}
    assert {r["class"]: r.representative for r in ontology.equivalents(d).collect()} == {":Author": ":Author", ":Writer": ":Author"}
    p = {(r["class"], r.property): r.from_class for r in ontology.effective_properties(d).collect()}
    assert p[":Saga", ":isbn"] == ":Book"
    ring = spark.createDataFrame([("a", "rdfs:subClassOf", "b"), ("b", "rdfs:subClassOf", "a")], "s string, p string, o string")
    assert {(r["class"], r.ancestor) for r in ontology.ancestors(ring).collect()} == {("a", "b"), ("b", "a")}


def test_induction(spark):
    kind = "document string, cls string, field string, type string, role string, is_list boolean, target string, label string, reference boolean, description string, example string, pos long"
    rows = [(d, "Invoice", "number", "str", "identity", False, None, None, False, "The number", f"N{d}", i * 10) for i, d in enumerate("abc")]
    rows += [("a", "invoice", "Total", "int", "property", False, None, None, False, "", None, 1), ("b", "Invoice", "total", "float", "property", False, None, None, False, "Sum", None, 11), ("a", "Invoice", "seller", "str", "edge", False, "Party", "SOLD_BY", False, "", None, 2), ("a", "Party", "name", "str", "identity", False, None, None, False, "", "Acme", 3), ("b", "Invoice", "seller", "str", "edge", False, "Ghost", "SOLD_BY", False, "", None, 12), ("c", "Invoice", "seller", "str", "edge", False, "Party", "SOLD_BY", False, "", None, 22)]
    classes = spark.createDataFrame([(d, "Invoice", True, True, i * 10) for i, d in enumerate("abc")] + [("a", "Party", False, True, 3)], "document string, name string, is_root boolean, is_entity boolean, pos long")
    t, _ = induce.merged_template(spark.createDataFrame(rows, kind), classes)
    inv = {f.name: f for f in t.model("Invoice").fields}
    assert t.root == "Invoice" and inv["total"].type == "float" and inv["seller"].type == "Party" and inv["number"].role == "identity"
    u = spark.createDataFrame([(0, "A", "x"), (1, "a", "y"), (2, "A", "x"), (3, "A", "y")], "unit int, cls string, field string")
    assert induce.saturated_at(u, streak=2, few=0) == 3


def test_sources_and_sinks(spark, tmp_path):
    g = graph(spark, [("a", "Cl ass", {"name": "it's", "n": "1.5", "l": "[1, 2]"}), ("b", "B", {"x": "y"})], [("a", "b", "has part", False)])
    lines = [r.line for r in cypher.script(g).orderBy("section", "line").collect()]
    assert lines[0].startswith("CREATE CONSTRAINT") and "MERGE (n:`Cl ass` {id: 'a'}) SET n.l = [1, 2], n.n = 1.5, n.name = 'it\\'s';" in lines and lines[-1].endswith("MERGE (a)-[:HAS_PART]->(b);")
    p = f"file://{tmp_path}/g.json"
    files.write_json(g, p, {"template": "x"})
    back = sources.graph_json(spark, p)
    assert {(r.node_id, r["class"]) for r in back.nodes.collect()} == {("a", "Cl ass"), ("b", "B")} and back.edges.count() == 1
    files.write_csv(g, f"file://{tmp_path}/csv")
    n, e = sources.graph_csv(spark, f"file://{tmp_path}/csv")
    assert n.count() == 2 and e.first().source == "a"
    (tmp_path / "bad.json").write_text('{"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "zz", "label": "x"}]}')
    with pytest.raises(ValueError):
        sources.graph_json(spark, f"file://{tmp_path}/bad.json")
    with pytest.raises(ValueError):
        sources.resolve(spark, "x.csv")
    assert "| Cl ass | 1 |" in report.markdown(g) and "<svg" in report.page(files.wide_nodes(g), files.wide_edges(g))
    tr = report.Trace()
    tr.emit("a", "s", text="x" * 3000)
    assert len(tr.to_json()["events"][0]["payload"]["text"]) == 2000
    with pytest.raises(ValueError):
        files.write_json(Graph(g.nodes.limit(0), g.edges), p)


def test_detection(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"schema_name": "D", "version": "1", "name": "n", "pages": [{"page_no": 2, "text": "b"}, {"page_no": 1, "text": "a"}]}')
    (tmp_path / "g.json").write_text('{"nodes": [], "edges": []}')
    (tmp_path / "o.json").write_text('{"x": 1}')
    (tmp_path / "t.xml").write_text("<doclang><p>hi</p></doclang>")
    kinds = {r.path.rsplit("/", 1)[-1]: r.kind for r in detect.file_kinds(sources.binaries(spark, f"file://{tmp_path}")).collect()}
    assert kinds == {"d.json": "document", "g.json": "graph", "o.json": "json", "t.xml": "tagged"}
    d = sources.documents(spark, f"file://{tmp_path}/d.json")
    assert sources.full_text(sources.page_texts(d)).first().text == "a\nb"
    assert sources.documents(spark, f"file://{tmp_path}/o.json").first().problem == "no document"
    urls = ["https://example.com/a.pdf", "ftp://x", "http://127.0.0.1/", "http://[::1]/", "http://localhost/", "http://10.0.0.1", None, "http://8.8.8.8/x"]
    got = [r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select(detect.url_problem("u").alias("p")).collect()]
    assert got == [None, "scheme", "protected address", "protected address", "protected host", "protected address", "empty", None]


def test_run_and_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, RECORD)], "n long, r " + INVOICE.schema().simpleString()).select("n", "r.*")
    for i in range(2):
        r = run(spark, Config(INVOICE, f"file://{tmp_path}/{i}", exports=("parquet", "cypher", "report")), df, "n")
    assert r.metadata["nodes"] == 4
    g, audit = merge_runs(spark, [f"file://{tmp_path}/0", f"file://{tmp_path}/1"], f"file://{tmp_path}/m")
    assert g.nodes.count() == 4 and audit["conflicts"].count() == 0
    with pytest.raises(ValueError):
        Config(INVOICE, mode="other")


def test_streams(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    kind = "n long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INVOICE.schema().fields)
    stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).json(f"file://{at}")
    for i, total in enumerate((1.0, 2.0)):
        (at / f"{i}.json").write_text(json.dumps({"n": i} | RECORD | {"total": total}) + "\n")
        incremental.follow(stream, lambda b: build(b, INVOICE, "n"), f"file://{tmp_path}/graph", f"file://{tmp_path}/cp").awaitTermination()
    last = spark.read.parquet(f"file://{tmp_path}/graph/v1/nodes")
    assert last.count() == 4
    assert last.filter("class = 'Invoice'").first().attrs["total"] == "1.0"  # what was stored first stands
    e = tmp_path / "ev"
    e.mkdir()
    (e / "0.json").write_text("\n".join(json.dumps({"user": 1, "event_id": i, "ts": f"2024-01-01T00:00:0{i}Z", "p": i in (1, 3)}) for i in range(5)))
    ev = spark.readStream.schema("user long, event_id long, ts timestamp, p boolean").json(f"file://{e}")
    q = incremental.running_parents(ev, "user", "ts", "p", "1 hour").writeStream.format("memory").queryName("parents").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.parent for r in spark.table("parents").orderBy("event_id").collect()] == [None, 1, 1, 3, 3]


def test_graph_analytics(spark):
    g = graph(spark, [(x, "N", {"a": "1"}) for x in "abcdef"], [("a", "b", "L", False), ("b", "c", "L", False), ("c", "a", "L", False), ("d", "e", "L", False), ("f", "f", "L", False)])
    assert {r.node_id: r.component for r in stats.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {(r.start, r.node_id, r.hops) for r in stats.reach(g.edges, g.nodes.filter("node_id = 'a'"), 1).collect()} == {("a", "a", 0), ("a", "b", 1)}
    path = graph(spark, [(x, "N", {}) for x in "abc"], [("a", "b", "L", False), ("b", "c", "L", False)])
    assert {r.node_id: r.betweenness for r in stats.betweenness(path).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_a_run_extracts_in_two_phases_and_says_where_nodes_come_from(spark, tmp_path):
    from graphloom.extraction_queries import ORDER, Clerk
    from graphloom.pipeline import Config, run

    filler = " ".join(f"Word number {i} says nothing." for i in range(40))
    long = f"This is order 1234 of status F. There is item aa11 flag R quantity 3 in it. {filler} There is item bb22 flag N quantity 5 in it."
    docs = spark.createDataFrame([(1, long), (2, "This is order 1235 of status O."), (3, None)], "doc long, text string")
    out = run(spark, Config(ORDER, str(tmp_path / "out"), "many_to_one", "dense", chunk_tokens=40), docs, "doc", Clerk)
    nodes = {(r["class"], r.attrs.get("item") or r.attrs.get("number")): r for r in out.graph.nodes.collect()}
    assert set(nodes) == {("Order", "1234"), ("Order", "1235"), ("Line", "aa11"), ("Line", "bb22")}
    assert nodes["Line", "bb22"].attrs["quantity"] == "5" and nodes["Order", "1234"].attrs["status"] == "F"
    assert {(r.src, r.dst) for r in out.graph.edges.collect()} == {(nodes["Order", "1234"].node_id, nodes["Line", x].node_id) for x in ("aa11", "bb22")}
    p = {r.node_id: r for r in spark.read.parquet(str(tmp_path / "out/provenance")).collect()}
    assert p[nodes["Line", "aa11"].node_id].kind == "verbatim" and p[nodes["Line", "aa11"].node_id].chunk_ids == [0]
    last = spark.read.parquet(str(tmp_path / "out/chunks")).filter("doc = 1").count() - 1
    assert last > 0 and p[nodes["Line", "bb22"].node_id].chunk_ids == [last]
    assert p[nodes["Order", "1235"].node_id].document == 2


def test_merge_policies(spark):
    a = graph(spark, [("x", "P", {"role": "chief"}), ("y", "P", {"name": "one"})], [])
    b = graph(spark, [("x", "P", {"role": "clerk", "city": "Rome"})], [])
    attrs, _, _ = merged(spark, a, b, split=False, policy=merge.Policy("richest"))
    assert attrs["x"] == {"role": "clerk", "city": "Rome"}
    attrs, _, _ = merged(spark, a, b, split=False, policy=merge.Policy(conflicts="keep-all"))
    assert json.loads(attrs["x"]["__conflicts__"]) == {"role": ["clerk"]}
    attrs, g, _ = merged(spark, a, b, split=False, policy=merge.Policy(conflicts="variants"))
    assert attrs["x"]["role"] == "chief" and [(r.src, r.label) for r in g.edges.collect()] == [("x", "HAS_CONFLICT_VARIANT")]
    with pytest.raises(ValueError):
        merge.Policy("other")


def test_merge_applies_confirmed_aliases(spark):
    a = graph(spark, [("a", "C", {"name": "acme"}), ("b", "C", {"name": "acme france", "city": "Paris"})], [])
    attrs, _, audit = merged(spark, a, split=False, identities={"C": ["name"]}, aliases=spark.createDataFrame([("a", "b")], "a string, b string"))
    assert set(attrs) == {"b"} and audit["aliases"].first().outcome == "merged"


def test_edge_attributes_fold(spark):
    e = spark.createDataFrame([(0, "a", "b", "L", 0, {"w": "", "t": '["x"]'}), (1, "a", "b", "L", 0, {"w": "2", "t": '["y","x"]'}), (1, "a", "b", "M", 1, {"w": "9", "z": "1"})], "input int, src string, dst string, label string, pos int, attrs map<string,string>")
    r = merge.fold_edges(e)[0].first()
    assert (r.label, r.also_labels, r.attrs["w"], json.loads(r.attrs["t"]), "z" in r.attrs) == ("L", ["M"], "2", ["x", "y"], False)
    assert merge.deep_merge({"description": "A" * 4000 + "."}, {"description": "B" * 50 + ". " + "C" * 200 + "."})["description"].endswith("B.")


def test_folds_beyond_the_first_plane(spark):
    import unicodedata

    for s in ("5㎏", "𝐀lpha", "été", "Ａｃｍｅ　№ ½", "ǅ ﬁ"):
        want = "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if c.isascii() and c.isalnum())
        assert one(spark, text.fold_id, s) == want
        assert one(spark, text.equivalence_key, s) == "".join(unicodedata.normalize("NFKC", s).casefold().split())
    assert one(spark, text.equivalence_key, "é") != one(spark, text.equivalence_key, "e")
    assert one(spark, text.fold_number, -12, "int") == "12"


def test_range_and_time_joins_by_brute_force(spark):
    import random

    from graphloom.operators import relational

    rng = random.Random(5)
    points = [(i, rng.choice("ab"), rng.choice([None, rng.uniform(-20, 20), float(rng.randint(-9, 9))])) for i in range(60)]
    spans = [(i, rng.choice("ab"), x, x + rng.choice([0.0, 3.0, 25.0, -1.0])) for i, x in enumerate(float(rng.randint(-15, 15)) for _ in range(40))]
    p = spark.createDataFrame(points, "p int, k string, x double")
    s = spark.createDataFrame(spans, "s int, k string, low double, high double")
    want = {(i, j) for i, k, x in points for j, q, a, b in spans if k == q and x is not None and a <= x <= b}
    for width in (1.0, 7.0, 100.0):
        rows = [(r.p, r.s) for r in relational.range_join(p, "x", s, "low", "high", width, ["k"]).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    none = {r.p for r in relational.range_join(p, "x", s, "low", "high", 4.0, ["k"], "left_anti").collect()}
    assert none == {i for i, _, _ in points} - {i for i, _ in want}
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1), (1, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 5, "b"), (1, 5, "c"), (1, 11, "d"), (2, 2, "e")], "k int, t int, v string")
    assert sorted(((r.k, r.t, r.v) for r in relational.asof_join(left, right, ["k"], "t", "v").collect()), key=str) == [(1, 10, "c"), (1, 5, "c"), (1, 5, "c"), (2, 1, None)]


def test_tables_of_the_catalog(spark):
    from graphloom.sources import tables

    t = tables.save_table(spark.range(100).selectExpr("id", "id % 7 as seven", "if(id < 10, null, id) as some"), "graphloom_numbers", 4, ["id"])
    assert t.count() == 100
    got = {r.column: r for r in tables.statistics(spark, "graphloom_numbers", ["seven", "some"]).collect()}
    assert got["some"].null_count == 10 and got["seven"].rows == 100 and abs(got["seven"].distinct_count - 7) <= 1
    plan = t.join(spark.table("graphloom_numbers").withColumnRenamed("some", "b"), "id").hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan or "Broadcast" in plan
    spark.sql("DROP TABLE graphloom_numbers")
    with pytest.raises(ValueError):
        tables.read(spark, "other", "x")


def test_lint_closed_homes_sentence_order_and_evidence():
    from graphloom.plans import lint

    long = "At most 3 of them. " + "It is not a bill. " + "A paper that says who owes what to whom. " * 8
    t = Template(
        "A",
        (
            Model("A", (Field("no", "str", "identity", examples=("A1",)), Field("kind", "Kind", "edge", reference=True, closed_catalog=True), Field("b", "B", "edge", True)), description=long, induced=True),
            Model("B", (Field("name", "str", "identity"), Field("x", evidence=("x is 1",)), Field("y", description="Rare: seldom"), Field("z")), induced=True),
            Model("Kind", (Field("code", "str", "identity", examples=("K1",)),)),
        ),
    )
    new, found = lint.lint(t)
    rules = {(f.rule, f.where) for f in found}
    assert ("closed_catalog", "A.kind") in rules and ("sentence_order", "A") in rules
    assert {w for r, w in rules if r == "evidence"} == {"A.kind", "A.b", "B.name", "B.z"}
    assert not next(f for f in new.model("A").fields if f.name == "kind").closed_catalog
    assert new.model("A").description.startswith("A paper") and len(new.model("A").description) <= lint.DOC_BUDGET
    assert lint.lint(new)[0] == new
