"""Reports, traces and pages to look at: bounded by top-k, whatever the graph's size."""

from __future__ import annotations

import html
import json
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..operators import stats
from ..operators.build import Graph
from ..operators.clean import violations


def markdown(g: Graph, title: str = "Graph", samples: int = 5, dropped: DataFrame | None = None) -> str:
    """Overview, types, the first nodes by id, diagnostics, and what relationships were dropped."""
    s = stats.summary(g).first()
    out = [f"# {title}", "", "## Overview", "", f"- nodes: {s.nodes}", f"- edges: {s.edges}", f"- average degree: {s.average_degree:.2f}", f"- density: {s.density:.6f}", ""]
    for name, df in (("Node types", stats.node_types(g)), ("Edge types", stats.edge_types(g))):
        out += [f"## {name}", "", "| type | count |", "|---|---|", *(f"| {r.type} | {r.n} |" for r in df.orderBy(F.desc("n"), "type").limit(50).collect()), ""]
    out += ["## Samples", ""]
    for r in g.nodes.orderBy("node_id").limit(samples).select("node_id", "class", F.transform_values("attrs", lambda k, v: truncate(v, 80)).alias("attrs")).collect():
        out.append(f"- **{r['class']}** `{r.node_id}`: " + ", ".join(f"{k}={v}" for k, v in sorted((r.attrs or {}).items())))
    out += ["", "## Diagnostics", "", *(f"- {r.severity}: {r.kind}: {r['count']}" for r in violations(g).groupBy("severity", "kind").count().orderBy("severity", "kind").collect()), ""]
    if dropped is not None:
        out += ["## Dropped relationships", "", *(f"- {r.src} {r.label} {r.dst}" for r in dropped.orderBy("src", "dst").limit(50).collect()), ""]
    return "\n".join(out)


def elements(nodes: DataFrame, edges: DataFrame, limit: int = 2000) -> dict[str, list[dict]]:
    """The first nodes by id and the edges between them, as elements of a drawing."""
    for c in ("source", "target"):
        if c not in edges.columns:
            raise ValueError(f"edges: no column {c}")
    n = nodes.orderBy("id").limit(limit)
    ids = n.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").orderBy("source", "target").limit(10 * limit)
    plain = lambda r: {k: v for k, v in r.asDict().items() if v is not None}
    return {"nodes": [{"data": plain(r)} for r in n.collect()], "edges": [{"data": plain(r) | {"id": f"e{i}"}} for i, r in enumerate(e.collect())]}


def page(nodes: DataFrame, edges: DataFrame, title: str = "Graph", limit: int = 2000) -> str:
    """A page that holds the elements as JSON and draws them on a circle by itself."""
    data = json.dumps(elements(nodes, edges, limit), ensure_ascii=False).replace("</", "<\\/")
    draw = "const d=JSON.parse(document.getElementById('d').textContent),s=document.getElementById('s'),p={},n=d.nodes.length;d.nodes.forEach((x,i)=>{const a=2*Math.PI*i/n;p[x.data.id]=[500+450*Math.cos(a),500+450*Math.sin(a)]});const add=(t,o,l)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in o)e.setAttribute(k,o[k]);if(l){const c=document.createElementNS('http://www.w3.org/2000/svg','title');c.textContent=l;e.appendChild(c)}s.appendChild(e)};d.edges.forEach(x=>{const a=p[x.data.source],b=p[x.data.target];add('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:'#bbb'},x.data.label)});d.nodes.forEach(x=>{const a=p[x.data.id];add('circle',{cx:a[0],cy:a[1],r:6,fill:'#357'},x.data.id+' '+(x.data.label||''))})"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><svg id='s' viewBox='0 0 1000 1000'></svg><script type='application/json' id='d'>{data}</script><script>{draw}</script></body></html>"


class Trace:
    """Events of a run in their order, on the driver."""

    def __init__(self) -> None:
        self.events: list[dict[str, Any]] = []

    def emit(self, kind: str, stage: str, **payload: Any) -> None:
        self.events.append({"sequence": len(self.events), "at": time.time(), "kind": kind, "stage": stage, "payload": payload})

    def to_json(self, longest: int = 2000) -> dict[str, Any]:
        """Events in order with long texts cut, and a step for each stage with its duration."""
        cut = lambda v: v[: longest - 3] + "..." if isinstance(v, str) and len(v) > longest else {k: cut(x) for k, x in v.items()} if isinstance(v, dict) else [cut(x) for x in v] if isinstance(v, list) else v
        steps: dict[str, dict[str, Any]] = {}
        for e in sorted(self.events, key=lambda e: e["sequence"]):
            s = steps.setdefault(e["stage"], {"stage": e["stage"], "began": e["at"], "ended": e["at"], "events": 0})
            s["ended"], s["events"] = max(s["ended"], e["at"]), s["events"] + 1
        return {"steps": [s | {"seconds": s["ended"] - s["began"]} for s in steps.values()], "events": [e | {"payload": cut(e["payload"])} for e in self.events]}


def trace_steps(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys..., events, began, ended, took_us) of event tables."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.min(ts).alias("began"), F.max(ts).alias("ended"), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("took_us"))
