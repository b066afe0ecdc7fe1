"""Property graphs as node and edge tables: expansion, bounded paths, visibility, statistics and graph-plus-vector search.

nodes: id, labels, props, embedding, valid_from, valid_to; edges: src, dst, type, weight, created_ms, valid_from, valid_to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .vectors import METRICS


def visible(df: DataFrame, at: int | Column) -> DataFrame:
    """Rows valid at a time: valid_from <= at <= valid_to, open where null."""
    return df.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))


def oriented(edges: DataFrame, direction: str = "OUT", type: str | None = None) -> DataFrame:
    """(a, b): one row for each neighbour; parallel edges are one."""
    e = edges.where(F.col("type") == type) if type else edges
    out, into = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"OUT": lambda: out, "IN": lambda: into, "BOTH": lambda: out.unionByName(into)}[direction]().distinct()


def steps(edges: DataFrame, direction: str = "OUT", type: str | None = None) -> DataFrame:
    """(a, b) along edges, parallel ones as they are."""
    e = edges.where(F.col("type") == type) if type else edges
    out, into = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"OUT": lambda: out, "IN": lambda: into, "BOTH": lambda: out.unionByName(into)}[direction]()


def neighbors(edges: DataFrame, start: DataFrame, depth: int = 1, direction: str = "OUT", type: str | None = None) -> DataFrame:
    """Breadth-first: (id, hops) of all nodes within depth of the start ids (column id), each at its least distance.

    Only edges of the frontier are gone along and made distinct; each round but the last is written, so that the plan
    does not double from hop to hop.
    """
    hop = steps(edges, direction, type)
    seen = start.select("id").distinct().withColumn("hops", F.lit(0))
    edge = seen
    for d in range(1, depth + 1):
        step = edge.join(hop, edge.id == hop.a).select(F.col("b").alias("id")).distinct()
        edge = step.join(seen, "id", "left_anti").withColumn("hops", F.lit(d))
        edge = written(edge, "frontier") if d < depth else edge
        seen = seen.unionByName(edge)
    return seen


def paths(edges: DataFrame, start: DataFrame, least: int, most: int, direction: str = "OUT", type: str | None = None) -> DataFrame:
    """(path): node lists of least to most hops that enter no node twice."""
    hop = oriented(edges, direction, type)
    now = start.select(F.array("id").alias("path"))
    out = now if least == 0 else None
    for d in range(1, most + 1):
        now = now.join(hop, F.element_at("path", -1) == hop.a).where(~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"))
        if d >= least:
            out = now if out is None else out.unionByName(now)
    return out


def match(nodes: DataFrame, edges: DataFrame, *, left: str | None = None, right: str | None = None, direction: str = "OUT", type: str | None = None, optional: bool = False) -> DataFrame:
    """MATCH (a:left)-[:type]->(b:right): pairs a, b; OPTIONAL MATCH keeps every a."""
    pick = lambda label: nodes.where(F.array_contains("labels", label)) if label else nodes
    a, b = pick(left).select(F.col("id").alias("a")), pick(right).select(F.col("id").alias("b"))
    hop = oriented(edges, direction, type).join(b, "b", "left_semi")
    return a.join(hop, "a", "left" if optional else "inner").select("a", "b")


def shortest(edges: DataFrame, start: DataFrame, depth: int, direction: str = "OUT") -> DataFrame:
    """(id, cost): least sum of weights over at most depth edges (Bellman-Ford rounds); costs travel without their paths."""
    e = weighted(edges, direction, depth)
    now = start.select("id", F.lit(0.0).alias("cost"))
    for d in range(depth):
        step = now.join(e, now.id == e.a).select(F.col("b").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"))
        now = now.unionByName(step).groupBy("id").agg(F.min("cost").alias("cost"))
        now = written(now, "relaxed") if d < depth - 1 else now
    return now


def weighted(edges: DataFrame, direction: str, depth: int) -> DataFrame:
    """(a, b, weight) along edges, parallel ones as they are: the least at each node is found anyway. Written where rounds read it again."""
    a, b = ("src", "dst") if direction == "OUT" else ("dst", "src")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), "weight")
    return written(e, "edges") if depth > 1 else e


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int, direction: str = "OUT", most: float | None = None) -> DataFrame:
    """(id, cost, path): a cheapest path of at most depth edges, of equal ones the first by its nodes; none above cost most. Rounds are written."""
    e = weighted(edges, direction, depth)
    now = start.select("id", F.lit(0.0).alias("cost"), F.array("id").alias("path"))
    for d in range(depth):
        step = now.join(e, now.id == e.a).select(F.col("b").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.array_append("path", F.col("b")).alias("path"))
        step = step if most is None else step.where(F.col("cost") <= most)
        best = now.unionByName(step).groupBy("id").agg(F.min(F.struct(F.col("cost").isNull().alias("none"), "cost", "path")).alias("best"))
        now = best.select("id", "best.cost", "best.path")
        now = written(now, "relaxed") if d < depth - 1 else now
    return now


def cost_paths(edges: DataFrame, start: DataFrame, depth: int, most: float, direction: str = "OUT") -> DataFrame:
    """Depth-first search with a cost bound, as a set: (path, cost) of all simple paths of at most depth edges and cost most."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    e = e if direction == "OUT" else e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    now = start.select(F.array("id").alias("path"), F.lit(0.0).alias("cost"))
    out = None
    for _ in range(depth):
        on = now.join(e, F.element_at("path", -1) == e.a).where(~F.array_contains("path", F.col("b")))
        now = on.select(F.array_append("path", F.col("b")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost")).where(F.col("cost") <= most)
        out = now if out is None else out.unionByName(now)
    return out


# ---- writing


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """GRAPH.ADDNODE, CREATE (n): new nodes of the same columns; ids that exist are an error of the caller."""
    return nodes.unionByName(new)


def create_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRAPH.ADDEDGE, CREATE ()-[]->(): edges between nodes that exist; no node is its own neighbour."""
    ids = nodes.select("id")
    ok = new.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(ok)


def merge_nodes(nodes: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """MERGE (n {on}): wanted nodes that no node equals in the columns on are created."""
    return nodes.unionByName(wanted.join(nodes.select(*on).distinct(), on, "left_anti").select(*nodes.columns))


def set_properties(nodes: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """SET n.name = value where which holds; other nodes stay."""
    hit = F.coalesce(which, F.lit(False))
    return nodes.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DELETE n: nodes and edges without the ids of gone; edges at them go too."""
    g = gone.select("id").distinct()
    left = edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(g, "id", "left_anti"), left


def degree_stats(edges: DataFrame) -> DataFrame:
    """GRAPH.INFO: edges, nodes with edges, mean, median and largest degree."""
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return deg.agg((F.sum("degree") / 2).cast("long").alias("edges"), F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean"), F.expr("percentile(degree, 0.5)").alias("median"), F.max("degree").alias("most"))


def vector_search(nodes: DataFrame, edges: DataFrame, start: DataFrame, query: list[float], k: int, hops: int, *, type: str | None = None, threshold: float | None = None) -> DataFrame:
    """GRAPH.VSEARCH: the k nodes within some hops that are most similar by cosine."""
    near = neighbors(edges, start, hops, "BOTH", type).where("hops > 0")
    q = F.lit([float(x) for x in query])
    got = nodes.join(near, "id").withColumn("similarity", 1.0 - METRICS["COSINE"](F.col("embedding"), q))
    got = got.where(F.col("similarity") >= threshold) if threshold is not None else got
    return got.orderBy(F.col("similarity").desc(), "id").limit(k).select("id", "hops", "similarity")


def navigate(seeds: DataFrame, edges: DataFrame, k: int, hops: int, penalty: float = 0.1) -> DataFrame:
    """FT.NAVIGATE: seeds (id, score) expanded; final = score of the seed + hops * penalty, the least for each node."""
    hop = oriented(edges, "BOTH")
    now = seeds.select("id", F.col("score").alias("final"))
    for _ in range(hops):
        step = now.join(hop, now.id == hop.a).select(F.col("b").alias("id"), (F.col("final") + penalty).alias("final"))
        now = now.unionByName(step).groupBy("id").agg(F.min("final").alias("final"))
    return now.orderBy("final", "id").limit(k)


# ---- scores, and search by graph and vector together


def decay(age: Column, rate: float) -> Column:
    return 1.0 / (1.0 + rate * age)


def distance_score(weight: Column) -> Column:
    return 1.0 / (1.0 + F.abs(weight))


def composite(time: Column, distance: Column, similarity: Column, weights: tuple[float, float, float]) -> Column:
    return weights[0] * time + weights[1] * distance + weights[2] * similarity


def edge_cost(weight: Column, created_ms: Column, now_ms: int, rate: float, time_weight: float = 1.0) -> Column:
    """|weight| and a share for the age in seconds; no age where created_ms is 0 or null."""
    age = F.when(F.coalesce(created_ms, F.lit(0)) > 0, F.greatest((F.lit(now_ms) - created_ms) / 1000.0, F.lit(0.0))).otherwise(0.0)
    return F.abs(weight) + rate * time_weight * age


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """GRAPH.ADDEDGE: an edge from a node to itself is refused."""
    return edges.unionByName(new.where("src <> dst"), allowMissingColumns=True)


def _similarity(nodes: DataFrame, query: list[float]) -> DataFrame:
    """(id, similarity): cosine, 0 without an embedding."""
    q = F.lit([float(x) for x in query])
    return nodes.select("id", F.when(F.col("embedding").isNotNull(), 1.0 - METRICS["COSINE"](F.col("embedding"), q)).otherwise(0.0).alias("similarity"))


def hybrid_expand(nodes: DataFrame, edges: DataFrame, query: list[float], k: int, hops: int) -> DataFrame:
    """(id, hops): the k most similar nodes and what lies within some hops of them."""
    top = _similarity(nodes.where("embedding is not null"), query).orderBy(F.col("similarity").desc(), "id").limit(k)
    return neighbors(edges, top, hops, "BOTH")


def hybrid_rerank(nodes: DataFrame, edges: DataFrame, start: DataFrame, candidates: DataFrame, query: list[float], k: int, *, alpha: float = 0.5, hops: int = 3) -> DataFrame:
    """Candidates (id) by alpha * cosine + (1 - alpha) / (1 + distance); what is out of reach counts one hop more than the last."""
    far = candidates.select("id").distinct().join(neighbors(edges, start, hops, "BOTH"), "id", "left").join(_similarity(nodes, query), "id")
    score = alpha * F.col("similarity") + (1 - alpha) / (1 + F.coalesce("hops", F.lit(hops + 1)))
    return far.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def hybrid_walk(nodes: DataFrame, edges: DataFrame, start: DataFrame, query: list[float], steps: int, *, beam: int = 5, least: float = 0.0) -> DataFrame:
    """(id, step, similarity): each step keeps the most similar new neighbours of the last; it ends where the best is below least."""
    hop, near = oriented(edges, "BOTH"), _similarity(nodes, query)
    now = start.select("id").distinct().join(near, "id").withColumn("step", F.lit(0))
    seen = now
    for s in range(1, steps + 1):
        new = now.join(hop, now.id == hop.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        # below the best of a step the rest stays: only a best that is too low ends the walk
        top = new.join(near, "id").orderBy(F.col("similarity").desc(), "id").limit(beam)
        now = top.withColumn("_best", F.max("similarity").over(Window.partitionBy())).where(F.col("_best") >= least).select("id", "similarity", F.lit(s).alias("step"))
        seen = seen.unionByName(now)
    return seen.select("id", "step", "similarity")
