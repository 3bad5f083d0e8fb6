"""python -m graphloom: convert, merge, inspect, and template from-ontology, from-docs, from-spec, lint, evaluate."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="records in JSON or Parquet to a graph")
    c.add_argument("source"), c.add_argument("template"), c.add_argument("output")
    c.add_argument("--order", required=True), c.add_argument("--export", action="append", default=[])
    m = sub.add_parser("merge", help="graphs to one, the first wins")
    m.add_argument("inputs", nargs="+"), m.add_argument("--output", required=True), m.add_argument("--precedence", default="input-order", choices=("input-order", "richest")), m.add_argument("--conflicts", default="keep-first", choices=("keep-first", "keep-all", "variants")), m.add_argument("--no-split", action="store_true")
    i = sub.add_parser("inspect", help="a report, or a page to look at")
    i.add_argument("path"), i.add_argument("--page")
    t = sub.add_parser("template").add_subparsers(dest="sub", required=True)
    o = t.add_parser("from-ontology")
    o.add_argument("source"), o.add_argument("--root"), o.add_argument("--depth", type=int, default=4), o.add_argument("--include", nargs="*"), o.add_argument("--exclude", nargs="*"), o.add_argument("--output")
    d = t.add_parser("from-docs", help="from observed fields in JSON lines, with a table of classes")
    d.add_argument("fields"), d.add_argument("classes"), d.add_argument("--root"), d.add_argument("--output")
    s = t.add_parser("from-spec")
    s.add_argument("spec"), s.add_argument("--output", required=True), s.add_argument("--strict", action="store_true")
    n = t.add_parser("lint")
    n.add_argument("spec"), n.add_argument("--strict", action="store_true")
    e = t.add_parser("evaluate", help="fill rates of a graph by a template")
    e.add_argument("spec"), e.add_argument("graph")
    init = sub.add_parser("init", help="a template to begin with")
    init.add_argument("output")
    a = p.parse_args(argv)
    from .plans.lint import lint
    from .plans.template import Field, Model, Template, render

    def put(text: str, to: str | None) -> None:
        Path(to).write_text(text) if to else print(text)

    def spec(path: str) -> Template:
        return Template.from_yaml(Path(path).read_text())

    if a.command == "init":
        put(Template("Document", (Model("Document", (Field("name", "str", "identity", required=True), Field("summary"))),)).to_yaml(), a.output)
        return 0
    if a.command == "template" and a.sub == "from-ontology":
        from .plans.ontology import compile_ontology

        made, found = compile_ontology(Path(a.source).read_text(), None, a.root, a.depth, a.include, a.exclude)
        put(made.to_yaml(), a.output)
        print(*found, sep="\n", file=sys.stderr)
        return 0
    if a.command == "template" and a.sub in ("from-spec", "lint"):
        made, found = lint(spec(a.spec), strict=a.strict)
        print(*found, sep="\n", file=sys.stderr)
        if a.sub == "from-spec":
            put(render(made), a.output)
        return int(a.sub == "lint" and any(f.level == "error" for f in found))
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "template" and a.sub == "from-docs":
        from .plans.induce import merged_template

        made, found = merged_template(spark.read.json(a.fields), spark.read.json(a.classes), root=a.root)
        put(made.to_yaml(), a.output)
        return 0
    from .operators.merge import Policy
    from .pipeline import Config, merge_runs, run
    from .sources.files import graph_json, graph_parquet

    if a.command == "convert":
        template = spec(a.template)
        data = spark.read.schema(template.schema()).json(a.source) if a.source.endswith((".json", ".jsonl")) else spark.read.parquet(a.source)
        print(json.dumps(run(spark, Config(template, a.output, exports=tuple(a.export) or ("parquet",)), data, a.order).metadata, indent=2, default=str))
        return 0
    if a.command == "merge":
        g, audit = merge_runs(spark, a.inputs, a.output, split=not a.no_split, policy=Policy(a.precedence, a.conflicts))
        print(json.dumps({"nodes": g.nodes.count(), "edges": g.edges.count()} | {k: v.count() for k, v in audit.items()}))
        return 0
    at = a.path if a.command == "inspect" else a.graph
    g = graph_json(spark, at) if at.endswith(".json") else graph_parquet(spark, at)
    if a.command == "inspect":
        from .sinks.report import markdown, page

        print(markdown(g))
        if a.page:
            put(page(g.nodes.select(F.col("node_id").alias("id"), F.col("class").alias("label")), g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "label")), a.page)
        return 0
    from .operators.evaluate import fill_rates

    t_ = spec(a.spec)
    fill_rates(g, {m_.name: [f.name for f in m_.fields if f.role == "property" and t_.model(f.type) is None] for m_ in t_.models if m_.entity}).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
