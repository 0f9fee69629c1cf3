"""Iterative graph questions: components, paths, cycles, bridges, distances.

Rounds are DataFrame joins over all graphs at once, keyed by graph; each round's state is settled
in the shared folder, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, linked_components, prepare, settle
from . import reach
from .adjacency import adjacency, directed_graphs, open_adjacency, two_way
from .local import _held, _null_safe, checked


def components(nodes: DataFrame, adj: DataFrame, keys: list[str], held: int = reach.HELD) -> DataFrame:
    """(keys, node_id, component): the smallest node id reachable within the same key values.

    nodes has keys and node_id, adj has keys, src and dst in both directions; edges to nodes that
    are not listed are ignored. Keys with up to held edges are searched by the task that holds them,
    larger ones together in rounds of joins.
    """
    node = nodes.select(*keys, "node_id").distinct()
    near = adj.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")).where("a < b").distinct()
    near = near.join(node.withColumnRenamed("node_id", "a"), [*keys, "a"], "left_semi").join(node.withColumnRenamed("node_id", "b"), [*keys, "b"], "left_semi")
    near = settle(near, "component-edges")
    large = settle(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held).select(*keys), "component-large")
    small = near.join(large, keys, "left_anti")
    found = reach.searched(small.toDF(*keys, "src", "dst").unionByName(small.toDF(*keys, "dst", "src")), keys)
    if not large.isEmpty():
        found = found.unionByName(linked_components(near.join(large, keys, "left_semi"), tuple(keys), "component").withColumnRenamed("node", "node_id"))
    return node.join(found, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("component", "node_id").alias("component"))


def graph_components(nodes: DataFrame, edges: DataFrame, open_only: bool = False) -> DataFrame:
    """(graph_id, node_id, component) of undirected graphs, of all nodes or the available ones."""
    adj = open_adjacency(nodes, edges) if open_only else adjacency(edges)
    return components(nodes.where("is_open") if open_only else nodes, adj, ["graph_id"])


def regions(nodes: DataFrame, adj: DataFrame, keys: list[str], directed: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """((keys, node_id, component), (keys, a, b)): what reaches each other, and which components lead to which.

    directed names the graphs with directions; where it is null there are no links between components.
    """
    if directed is None:
        return components(nodes, adj, keys), None
    at, out = directed.select("graph_id"), "left_anti"
    strong = settle(reach.strong_components(nodes.join(at, "graph_id", "left_semi"), adj.join(at, "graph_id", "left_semi"), keys), "strong")
    plain = components(nodes.join(at, "graph_id", out), adj.join(at, "graph_id", out), keys)
    return plain.unionByName(strong), reach.between(strong, adj, keys)


def reachability(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """yes if an open path of available nodes, along directions, joins source and target."""
    comp, links = regions(nodes.where("is_open"), open_adjacency(nodes, edges), ["graph_id"], directed_graphs(edges))
    s = comp.select("graph_id", F.col("node_id").alias("source"), F.col("component").alias("_cs"))
    t = comp.select("graph_id", F.col("node_id").alias("target"), F.col("component").alias("_ct"))
    out = queries.join(s, ["graph_id", "source"], "left").join(t, ["graph_id", "target"], "left")
    met = F.col("_cs") == F.col("_ct")
    if links is not None:
        out = settle(out, "reach-queries")
        led = reach.closure(out.where("_cs is not null").select("graph_id", F.col("_cs").alias("a")), links, ["graph_id"])
        out = out.join(led.select("graph_id", F.col("a").alias("_cs"), F.col("b").alias("_ct"), F.lit(True).alias("_led")), ["graph_id", "_cs", "_ct"], "left")
        met = met | F.col("_led")
    answer = F.when(F.col("target").isNull(), "invalid").when(met, "yes").otherwise("no")
    return checked(out, nodes, answer).drop("_cs", "_ct", "_led")


def best_paths(sources: DataFrame, adj: DataFrame) -> DataFrame:
    """(graph_id, source, node_id, cost, path): least total weight, the lexicographically smallest path among equals.

    Each round extends the paths that improved and keeps the smallest (cost, path) of each node;
    weights are positive, so a best path's beginnings are best paths too, and no path visits a node
    twice: rounds end with the longest best path.
    """
    near = settle(adj.groupBy("graph_id", "src", "dst").agg(F.min("weight").alias("weight")), "path-edges")
    state = sources.select("graph_id", "source", F.col("source").alias("node_id"), F.struct(F.lit(0.0).alias("cost"), F.array("source").alias("path")).alias("best"), F.lit(True).alias("fresh"))
    state = settle(state, "paths-0")
    i = 0
    while not state.where("fresh").isEmpty():
        i += 1
        front = state.where("fresh").select("graph_id", "source", F.col("node_id").alias("src"), "best")
        step = front.join(near, ["graph_id", "src"]).where(~F.array_contains("best.path", F.col("dst")))
        step = step.select("graph_id", "source", F.col("dst").alias("node_id"), F.struct((F.col("best.cost") + F.col("weight")).alias("cost"), F.concat("best.path", F.array("dst")).alias("path")).alias("best"))
        both = state.select("graph_id", "source", "node_id", "best", F.col("best").alias("old")).unionByName(step.withColumn("old", F.lit(None).cast(state.schema["best"].dataType)))
        new = settle(both.groupBy("graph_id", "source", "node_id").agg(F.min("best").alias("best"), F.min("old").alias("old")).select("graph_id", "source", "node_id", "best", (~F.col("best").eqNullSafe(F.col("old"))).alias("fresh")), f"paths-{i}")
        discard(state)
        state = new
    discard(near)
    return state.select("graph_id", "source", "node_id", "best.cost", "best.path")


#: Work on one graph, its edges times the sources asked about, that one task does by itself.
SEARCHED = 5_000_000


def _query_paths(queries: DataFrame, nodes: DataFrame, edges: DataFrame, held: int = SEARCHED) -> DataFrame:
    """Queries with the best open path between source and target, null where there is none.

    A task that holds a graph with the ends asked about searches it from each source; graphs with
    more work than held go together through the rounds of best_paths, to the same paths.
    """
    ends, ok, key = ["graph_id", "source", "target"], nodes.where("is_open").select("graph_id", F.col("node_id").alias("source")), "graph_id"
    asked = settle(queries.where("target is not null").select(*ends).distinct().join(ok, ends[:2], "left_semi"), "path-ends")
    near = settle(open_adjacency(nodes, edges).groupBy(key, "src", "dst").agg(F.min("weight").alias("weight")), "open-edges")
    work = near.groupBy(key).agg(F.count(F.lit(1)).alias("_e")).join(asked.groupBy(key).agg(F.countDistinct("source").alias("_s")), key)
    large = settle(work.where(F.col("_e") * F.col("_s") > held).select(key), "path-large")
    best = searched_paths(asked.join(large, key, "left_anti"), near.join(large, key, "left_anti"))
    if not large.isEmpty():
        rest = best_paths(asked.join(large, key, "left_semi").select(*ends[:2]).distinct(), near.join(large, key, "left_semi"))
        best = best.unionByName(rest.withColumnRenamed("node_id", "target"))
    return queries.join(best, ends, "left")


def searched_paths(ends: DataFrame, near: DataFrame) -> DataFrame:
    """(graph_id, source, target, cost, path) of the ends (graph_id, source, target) that near (graph_id, src, dst, weight) joins: one search a source, in the task that holds the graph."""
    prepare(near.sparkSession)

    def each(asked: pa.Table, links: pa.Table) -> pa.Table:
        step, goals, rows = {}, {}, []
        for a, b, w in zip(*(links.column(c).to_pylist() for c in ("src", "dst", "weight")), strict=True):
            step.setdefault(a, []).append((b, w))
        for a, b in zip(asked.column("source").to_pylist(), asked.column("target").to_pylist(), strict=True):
            goals.setdefault(a, set()).add(b)
        for source, wanted in goals.items():
            rows += [(source, t, *found) for t, found in nearest(step, source, wanted).items()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())))]
        ids = pa.array([asked.column("graph_id")[0].as_py()] * len(rows) if rows else [], asked.schema.field("graph_id").type)
        return pa.table([ids, *cols], names=["graph_id", "source", "target", "cost", "path"])

    kind = ends.schema["graph_id"].dataType.simpleString()
    return ends.groupBy("graph_id").cogroup(near.groupBy("graph_id")).applyInArrow(each, f"graph_id {kind}, source string, target string, cost double, path array<string>")


def nearest(step: dict[str, list[tuple[str, float]]], source: str, wanted: set[str]) -> dict[str, tuple[float, list[str]]]:
    """Cost and path from source to each wanted node it leads to: least cost, the smallest path among equals, weights being positive."""
    out, done, heap = {}, set(), [(0.0, [source])]
    while heap and len(out) < len(wanted):
        cost, path = heapq.heappop(heap)
        if (at := path[-1]) in done:
            continue
        done.add(at)
        if at in wanted:
            out[at] = (cost, path)
        for to, w in step.get(at, ()):
            if to not in done:
                heapq.heappush(heap, (cost + w, [*path, to]))
    return out


def shortest_path(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The number of nodes on the path of least weight, both ends included; unreachable without one."""
    answer = F.when(F.col("target").isNull(), "invalid").otherwise(F.coalesce(F.size("path").cast("string"), F.lit("unreachable")))
    found = _query_paths(queries, nodes, edges)
    return checked(found, nodes, F.when(F.col("path").isNull() & F.col("target").isNotNull(), "unreachable").otherwise(answer)).drop("cost", "path")


def path_cost(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The weight of that path, whole numbers without decimals, others rounded half to even at two."""
    cost = F.when(F.col("cost") == F.floor("cost"), F.col("cost").cast("long").cast("string")).otherwise(F.bround("cost", 2).cast("string"))
    answer = F.when(F.col("target").isNull(), "invalid").otherwise(F.coalesce(cost, F.lit("unreachable")))
    return checked(_query_paths(queries, nodes, edges), nodes, answer).drop("cost", "path")


def filtered_path_count(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """Nodes on that path, ends included, whose attribute equals the queried token."""
    found = _query_paths(queries, nodes, edges)
    keys = ["graph_id", "source", "target", "attribute", "token"]
    on = found.where("path is not null").select(*keys, "path").distinct().select(*keys, F.explode("path").alias("node_id"))
    n = on.join(_held(attrs), ["graph_id", "node_id", "attribute"], "left").groupBy(*keys).agg(F.count_if(F.col("_own").eqNullSafe(F.col("token"))).alias("_n"))
    answer = F.when(F.col("target").isNull(), "invalid").otherwise(F.coalesce(F.col("_n").cast("string"), F.lit("unreachable")))
    return checked(_null_safe(found, n, keys), nodes, answer).drop("_n", "cost", "path")


def path_questions(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """queries (query_id, kind and the rest) of the three kinds about best paths with their answers; paths are searched once for all."""
    found = settle(_query_paths(queries, nodes, edges), "query-paths")
    n = found.where("path is not null and kind = 'filtered_path_count'").select("query_id", "graph_id", "attribute", "token", F.explode("path").alias("node_id"))
    n = n.join(_held(attrs), ["graph_id", "node_id", "attribute"], "left").groupBy("query_id").agg(F.count_if(F.col("_own").eqNullSafe(F.col("token"))).alias("_n"))
    cost = F.when(F.col("cost") == F.floor("cost"), F.col("cost").cast("long").cast("string")).otherwise(F.bround("cost", 2).cast("string"))
    said = F.when(F.col("kind") == "shortest_path", F.size("path").cast("string")).when(F.col("kind") == "path_cost", cost).otherwise(F.col("_n").cast("string"))
    answer = F.when(F.col("target").isNull(), "invalid").when(F.col("path").isNull(), "unreachable").otherwise(said)
    return checked(found.join(n, "query_id", "left"), nodes, answer).drop("_n", "cost", "path")


def constrained_reachability(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """yes if a path avoids nodes whose attribute equals the token; the ends are exempt, closed nodes count.

    Components of what is left are found once for each graph and avoided class. Two ends are joined
    if they touch, or if one component holds neighbours of both; with directions, if one that the
    source leads to leads to one that leads to the target.
    """
    cls = queries.select("graph_id", "attribute", "token").distinct()
    held = attrs.select("graph_id", "node_id", F.col("name").alias("attribute"), F.col("token").alias("_own"))
    free = cls.join(nodes.select("graph_id", "node_id"), "graph_id").join(held, ["graph_id", "node_id", "attribute"], "left").where(~F.col("_own").eqNullSafe(F.col("token")))
    free = free.select("graph_id", "attribute", F.coalesce("token", F.lit("")).alias("token"), "node_id")
    adj = adjacency(edges).select("graph_id", "src", "dst").distinct()
    keys = ["graph_id", "attribute", "token"]
    comp, links = regions(free, adj.join(free.select(*keys).distinct(), "graph_id"), keys, directed_graphs(edges))
    near = lambda end, inner: adj.join(comp.withColumnRenamed("node_id", inner), ["graph_id", inner]).select(*keys, F.col(end).alias("end"), "component").distinct()
    leave, enter = near("src", "dst"), near("dst", "src")
    q = queries.withColumn("_token", F.coalesce("token", F.lit("")))
    if links is not None:
        asked = q.select("graph_id", "attribute", F.col("_token").alias("token"), F.col("source").alias("end")).distinct()
        leave = settle(leave.join(asked, [*keys, "end"], "left_semi"), "leave")
        led = reach.closure(leave.select(*keys, F.col("component").alias("a")), links, keys)
        leave = leave.withColumnRenamed("component", "a").join(led, [*keys, "a"]).select(*keys, "end", F.col("b").alias("component")).distinct()
    s = leave.select("graph_id", "attribute", F.col("token").alias("_token"), F.col("end").alias("source"), "component")
    t = enter.select("graph_id", "attribute", F.col("token").alias("_token"), F.col("end").alias("target"), "component")
    ends = ["graph_id", "attribute", "_token", "source", "target"]
    by_way = q.select(*ends).distinct().join(s, ends[:4]).join(t, [*ends[:3], "target", "component"]).select(*ends).distinct()
    touch = q.select(*ends).distinct().join(adj.toDF("graph_id", "source", "target"), ["graph_id", "source", "target"], "left_semi")
    met = by_way.unionByName(touch.select(*ends)).distinct().withColumn("_met", F.lit(True))
    out = q.join(met, ends, "left")
    answer = F.when(F.col("target").isNull(), "invalid").when(F.col("_met") | (F.col("source") == F.col("target")), "yes").otherwise("no")
    return checked(out, nodes, answer).drop("_met", "_token")


def blocks(edges: DataFrame) -> DataFrame:
    """(graph_id, block, a, b): the pairs of neighbours a < b of each graph by biconnected block.

    One low-link search a graph, which a task holds whole: graphs of a collection are small, and
    the work is linear in their edges. Parallel edges count as one, self-loops not at all.
    """
    prepare(edges.sparkSession)
    pairs = edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def each(t: pa.Table) -> pa.Table:
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        number = _block_numbers(a, b)
        return pa.table([t.column("graph_id"), pa.array(number, pa.int64()), t.column("a"), t.column("b")], names=["graph_id", "block", "a", "b"])

    return pairs.groupBy("graph_id").applyInArrow(each, f"graph_id {pairs.schema['graph_id'].dataType.simpleString()}, block long, a string, b string")


def _block_numbers(a: list[str], b: list[str]) -> list[int]:
    """The block of each edge of a simple graph, by an iterative depth-first search with low links."""
    near: dict[str, list[tuple[str, int]]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        near.setdefault(x, []).append((y, i))
        near.setdefault(y, []).append((x, i))
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    out, used, waiting, n = [-1] * len(a), [False] * len(a), [], 0
    for start in near:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        walk = [(start, iter(near[start]), -1)]
        while walk:
            x, rest, via = walk[-1]
            for y, i in rest:
                if used[i]:
                    continue
                used[i] = True
                waiting.append(i)
                if y in seen:
                    low[x] = min(low[x], seen[y])
                else:
                    seen[y] = low[y] = len(seen)
                    walk.append((y, iter(near[y]), i))
                    break
            else:
                walk.pop()
                if walk:
                    up = walk[-1][0]
                    low[up] = min(low[up], low[x])
                    if low[x] >= seen[up]:  # nothing below x reaches above up: a block ends with the edge between them
                        while True:
                            i = waiting.pop()
                            out[i] = n
                            if i == via:
                                break
                        n += 1
    return out


def cycle_membership(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """yes if two different neighbours of the source stay connected without it: if it lies in a block of two edges or more; no where edges have directions."""
    block = blocks(edges.where(two_way(edges)))
    many = block.groupBy("graph_id", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id", "block")
    on = block.join(many, ["graph_id", "block"]).select("graph_id", F.explode(F.array("a", "b")).alias("source")).distinct().withColumn("_on", F.lit(True))
    return checked(queries.join(on, ["graph_id", "source"], "left"), nodes, F.when(F.col("_on"), "yes").otherwise("no")).drop("_on")


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, a, b): pairs of neighbours that nothing else connects, blocks of one edge; parallel edges count as one."""
    return blocks(edges).groupBy("graph_id", "block").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1").select("graph_id", "a", "b")


def distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, source, node_id, depth) in steps between all connected pairs of each graph, the source itself at 0.

    The result is a row a pair, so it is for graphs of bounded size; rounds end with the diameter.
    """
    adj = settle(adjacency(edges).select("graph_id", "src", "dst").distinct(), "distance-edges")
    front = settle(nodes.select("graph_id", F.col("node_id").alias("source"), "node_id", F.lit(0).cast("long").alias("depth")), "distance-0")
    state, last, h = front, None, 0
    while not front.isEmpty():
        h += 1
        # A step leads to the depth before, the same, or a new one.
        step = front.select("graph_id", "source", F.col("node_id").alias("src")).join(adj, ["graph_id", "src"]).select("graph_id", "source", F.col("dst").alias("node_id")).distinct()
        known = front if last is None else front.unionByName(last)
        new = settle(step.join(known, ["graph_id", "source", "node_id"], "left_anti").withColumn("depth", F.lit(h).cast("long")), f"distance-{h}")
        state, last, front = state.unionByName(new), front, new
    return state


def extent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, connected, diameter, radius): both null for a graph that is not connected."""
    d = distances(nodes, edges)
    ecc = d.groupBy("graph_id", "source").agg(F.max("depth").alias("ecc"), F.count(F.lit(1)).alias("reached"))
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size"))
    out = ecc.join(size, "graph_id").groupBy("graph_id").agg(F.bool_and(F.col("reached") == F.col("size")).alias("connected"), F.max("ecc").alias("hi"), F.min("ecc").alias("lo"))
    return out.select("graph_id", "connected", F.when(F.col("connected"), F.col("hi")).alias("diameter"), F.when(F.col("connected"), F.col("lo")).alias("radius"))
