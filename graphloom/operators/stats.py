"""Statistics and analytics of graphs: counts, degrees, components, paths, centrality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .build import Graph


def shared(spark: SparkSession) -> str:
    """A new path in the folder that executors share, as spark.checkpoint.dir names it. Where that is unset a folder of this machine will do in local mode alone, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            at = given.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            import tempfile

            at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{at.rstrip('/')}/graph-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the folder that executors share and read again, so that iteration doesn't grow the lineage."""
    path = shared(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def node_types(g: Graph) -> DataFrame:
    return g.nodes.groupBy(F.coalesce("class", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def edge_types(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.coalesce("label", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def summary(g: Graph) -> DataFrame:
    """One row: nodes, edges, average degree 2E/N, density E/(N(N-1)), self loops."""
    n = g.nodes.agg(F.count("*").alias("nodes"))
    e = g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("self_loops"))
    v, w = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return n.crossJoin(e).select("nodes", "edges", "self_loops", F.when(v > 0, 2 * w / v).otherwise(0.0).alias("average_degree"), F.when(v > 1, w / (v * (v - 1))).otherwise(0.0).alias("density"))


def degrees(g: Graph) -> DataFrame:
    """(node_id, class, in_degree, out_degree, degree, centrality) of every node."""
    ends = g.edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(g.edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = g.nodes.agg(F.count("*").alias("__n"))
    out = g.nodes.select("node_id", "class").join(d, "node_id", "left").na.fill(0, ["in_degree", "out_degree"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return out.crossJoin(F.broadcast(n)).withColumn("centrality", F.when(F.col("__n") > 1, F.col("degree").cast("double") / (F.col("__n") - 1)).otherwise(0.0)).drop("__n")  # a single row


def top_degree(g: Graph, k: int) -> DataFrame:
    """The k nodes of the highest degree in each class, ties by id."""
    w = Window.partitionBy("class").orderBy(F.desc("degree"), "node_id")
    return degrees(g).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("class", "rank", "node_id", "degree")


def isolated(g: Graph) -> DataFrame:
    ends = g.edges.select(F.col("src").alias("node_id")).unionByName(g.edges.select(F.col("dst").alias("node_id")))
    return g.nodes.join(ends, "node_id", "left_anti").select("node_id", "class")


def completeness(g: Graph) -> DataFrame:
    """Of each class and attribute the number of nodes that have it filled, and the share."""
    per = g.nodes.groupBy("class").agg(F.count("*").alias("nodes"))
    filled = g.nodes.select("class", F.explode("attrs").alias("attribute", "v")).filter("trim(v) <> ''").groupBy("class", "attribute").agg(F.count("*").alias("filled"))
    return filled.join(per, "class").select("class", "attribute", "filled", (F.col("filled").cast("double") / F.col("nodes")).alias("share"))


def edge_fanout(edges: DataFrame) -> DataFrame:
    """(label, total, sources, top_share): the share of the source with the most edges of a label."""
    one = edges.groupBy("label", "src").agg(F.count("*").alias("n"))
    return one.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("sources"), (F.max("n").cast("double") / F.sum("n")).alias("top_share"))


def components(g: Graph) -> DataFrame:
    """(node_id, component): the least id of the nodes that are weakly connected. Large and small stars in turns, each round written; rounds grow with the logarithm of the graph."""

    def marks(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        hop = both.join(low, "u").filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hop if large else hop.unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    e = written(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v").distinct())
    before = None
    while (now := marks(e)) != before:
        before = now
        e = written(star(star(e, True), False))
    root = e.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("root"))
    return g.nodes.select("node_id").join(root, "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("component"))


def component_sizes(g: Graph) -> DataFrame:
    return components(g).groupBy("component").agg(F.count("*").alias("size"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node_id, hops): the fewest steps along edges from each start (node_id) to what it reaches, start itself at 0. Without a depth until nothing is new; each round written."""
    seen = written(start.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("hops")).distinct())
    step = edges.select("src", F.col("dst").alias("next")).distinct()
    front, hops = seen, 0
    while depth is None or hops < depth:
        hops += 1
        new = front.join(step, front.node_id == step.src).select("start", F.col("next").alias("node_id")).distinct().join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("hops", F.lit(hops))
        front = written(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbours(g: Graph, hops: int, labels: list[str] | None = None) -> DataFrame:
    """(src, dst) of all walks of so many edges, by joins on keys; labels: one for each step."""
    e = g.edges
    out = (e.filter(F.col("label") == labels[0]) if labels else e).select("src", "dst")
    for k in range(1, hops):
        nxt = (e.filter(F.col("label") == labels[k]) if labels else e).select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        out = out.join(nxt, "dst").select("src", F.col("next").alias("dst"))
    return out


def distances(g: Graph) -> DataFrame:
    """(start, node_id, hops) of all pairs along edges in either direction. Quadratic in the result, as all-pairs distances are."""
    both = g.edges.select("src", "dst").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, g.nodes.select("node_id")).filter("hops > 0")


#: Tasks that share the sources of a graph's core.
_TASKS = 64


def _over_adjacency(g: Graph, work, schema: str) -> DataFrame:
    """The tables that work(near, known, k) gives for k from 0 to _TASKS - 1, each in a task of its own that holds the adjacency: near the neighbours of each vertex in either direction, known the vertices that are nodes of the graph. Loops and edges without an end don't count."""
    import pyarrow as pa

    both = g.edges.select("src", "dst").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    one = both.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near")).join(g.nodes.select(F.col("node_id").alias("src"), F.lit(True).alias("known")).distinct(), "src", "left")
    whole = one.agg(F.array_sort(F.collect_list(F.struct("src", "near", F.coalesce("known", F.lit(False)).alias("known")))).alias("adj"))

    def run(frames):
        for frame in frames:
            for k, adj in zip(frame.column(0), frame.column(1)):
                rows = adj.as_py()
                yield from pa.Table.from_pylist(work({r["src"]: r["near"] for r in rows}, {r["src"] for r in rows if r["known"]}, k.as_py()), kinds).to_batches()

    names = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
    kinds = pa.schema([pa.field(n, names[t]) for n, t in (c.split() for c in schema.split(", "))])
    tasks = g.nodes.sparkSession.range(0, _TASKS, 1, _TASKS).select(F.col("id").alias("k"))
    return tasks.crossJoin(whole).mapInArrow(run, schema)


def _shrunk(near: dict) -> tuple[dict, list]:
    """The vertex to which each vertex outside the core hangs, in the order in which leaves fall off, and the core: what stays when a vertex with a single neighbour goes, again and again. Of a tree one vertex stays."""
    left = {v: len(n) for v, n in near.items()}
    up: dict = {}
    queue = [v for v, n in left.items() if n == 1]
    for u in queue:
        if left[u] == 1:
            v = up[u] = next(w for w in near[u] if w not in up)
            left[v] -= 1
            if left[v] == 1:
                queue.append(v)
    return up, [v for v in near if v not in up]


def path_summary(g: Graph) -> DataFrame:
    """One row: pairs that are connected, from nodes to vertices other than themselves, their average distance, and the diameter.

    Trees that hang on the core are summed up in linear time, a number of sums a vertex; only the core's vertices search it each for itself, which is quadratic in the core. Tasks hold the adjacency.
    """
    no = float("-inf")

    def work(near, known, k):
        up, core = _shrunk(near)
        # of the vertices that hang on each, itself included: how many, the sum and the most of their depths; the same of those that are nodes
        sums = {v: (1, 0, 0, *((1, 0, 0) if v in known else (0, 0, no))) for v in near}
        pairs = total = 0
        most = no
        for u, v in up.items():
            n, s, m, a, sa, ma = sums[u]
            s, m, sa, ma = s + n, m + 1, sa + a, ma + 1
            n2, s2, m2, a2, sa2, ma2 = sums[v]
            if k == 0:
                pairs += a * n2 + a2 * n
                total += sa * n2 + a * s2 + sa2 * n + a2 * s
                most = max(most, ma + m2, ma2 + m)
            sums[v] = n + n2, s + s2, max(m, m2), a + a2, sa + sa2, max(ma, ma2)
        for start in core[k::_TASKS]:
            _, _, _, a, sa, ma = sums[start]
            dist, queue = {start: 0}, [start]
            for v in queue:
                for w in near[v]:
                    if w not in dist and w not in up:
                        dist[w] = dist[v] + 1
                        queue.append(w)
            for w in queue[1:]:
                n, s, m = sums[w][:3]
                pairs += a * n
                total += a * n * dist[w] + sa * n + a * s
                most = max(most, ma + m + dist[w])
        return [{"pairs": pairs, "total": total, "most": None if most == no else int(most)}]

    p = _over_adjacency(g, work, "pairs long, total long, most int").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("total").alias("total"), F.max("most").alias("diameter"))
    return p.select("pairs", F.when(F.col("pairs") > 0, F.col("total").cast("double") / F.col("pairs")).alias("average_path"), "diameter")


def betweenness(g: Graph) -> DataFrame:
    """(node_id, betweenness): the exact undirected betweenness, not normalised. Trees that hang on the core are counted in linear time by their sizes; Brandes' dependencies, weighted by those, run from every source of the core alone. Sources are spread over tasks that each hold the adjacency, so it is for graphs whose edges fit a worker."""

    def work(near, known, k):
        up, core = _shrunk(near)
        size, below, squares = dict.fromkeys(near, 1), dict.fromkeys(near, 0), dict.fromkeys(near, 0)
        for u, v in up.items():
            size[v] += size[u]
            below[v] += size[u]
            squares[v] += size[u] ** 2
        total = dict.fromkeys(core, 0.0)
        for s in core[k::_TASKS]:
            order, pred, sigma, dist = [], {s: []}, {s: 1.0}, {s: 0}
            queue = [s]
            for v in queue:
                order.append(v)
                for w in near[v]:
                    if w in up:
                        continue
                    if w not in dist:
                        dist[w], sigma[w], pred[w] = dist[v] + 1, 0.0, []
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
                        pred[w].append(v)
            delta = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in pred[w]:
                    delta[v] += sigma[v] / sigma[w] * (size[w] + delta[w])
                if w != s:
                    total[w] += size[s] * delta[w]
        if k == 0:  # pairs of two trees that hang on a vertex, and of one and what lies beyond the vertex; twice, as all pairs
            all_ = {}
            for s in core:
                if s not in all_:
                    queue, seen = [s], {s}
                    for v in queue:
                        for w in near[v]:
                            if w not in seen and w not in up:
                                seen.add(w)
                                queue.append(w)
                    all_ |= dict.fromkeys(queue, sum(size[v] for v in queue))
            for u in reversed(up):
                all_[u] = all_[up[u]]
            for v in near:
                total[v] = total.get(v, 0.0) + below[v] ** 2 - squares[v] + 2 * below[v] * (all_[v] - size[v])
        return [{"node_id": v, "b": float(b)} for v, b in total.items() if b]

    d = _over_adjacency(g, work, "node_id string, b double").groupBy("node_id").agg((F.sum("b") / 2).alias("b"))
    return g.nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))
