"""Which edits of a graph change which answers, read off the graph as it is, without solving any edited graph.

Candidate edits of an undirected graph are SET_CLOSED of an open node, SET_OPEN of a closed one, DEL
of an edge, and ADD of an edge between two nodes that none joins yet. Closing a node or deleting an
edge parts two ends if it lies on their way through the tree of blocks and cut nodes, and makes a
path dearer if all best paths share it. Opening and adding are judged by what they bring together.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import prepare, settle
from . import paths, quota, solve
from .adjacency import adjacency, open_adjacency

#: Kinds whose answers the index knows about.
KINDS = ("reachability", "cycle_membership", "path_cost", "edge_exists", "node_degree")
#: Costs are compared in units of 1e-9, so that sums of weights in another order are equal.
UNIT = 1e9


def _anatomy(a: list[str], b: list[str]) -> tuple[list[int], list[str], dict[str, list[str]]]:
    """(block of each edge, series of each edge, trail of each node) of a simple graph.

    Two edges are of one series if only both together part their block: if the same cycles go
    through them. Each edge beyond a spanning forest names a cycle by 128 bits, an edge of the
    forest has the exclusive or of those that go over it; bridges have none and are a series each.
    The trail of a node leads from a root of its component down to it in the tree of blocks ("b" and
    number) and nodes ("n" and id).
    """
    block = paths._block_numbers(a, b)
    near: dict[str, list[tuple[str, int]]] = {}
    of_node: dict[str, dict[int, None]] = {}
    of_block: dict[int, dict[str, None]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        near.setdefault(x, []).append((y, i))
        near.setdefault(y, []).append((x, i))
        for end in (x, y):
            of_node.setdefault(end, {})[block[i]] = None
            of_block.setdefault(block[i], {})[end] = None
    label, over, trail, forest = [0] * len(a), dict.fromkeys(near, 0), {}, set()
    for root in near:
        if root in trail:
            continue
        trail[root], walk, used = ["n" + root], [root], set()
        while walk:
            x = walk.pop()
            for k in of_node[x]:
                if k not in used:
                    used.add(k)
                    for y in of_block[k]:
                        if y not in trail:
                            trail[y] = [*trail[x], f"b{k}", "n" + y]
                            walk.append(y)
    up: dict[str, tuple[str, int] | None] = {}
    order = []
    for root in near:
        if root in up:
            continue
        up[root], walk = None, [root]
        while walk:
            x = walk.pop()
            order.append(x)
            for y, i in near[x]:
                if y not in up:
                    up[y] = (x, i)
                    forest.add(i)
                    walk.append(y)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if i not in forest:
            label[i] = int.from_bytes(hashlib.blake2b(f"{x}\0{y}".encode(), digest_size=16).digest(), "big")
            over[x] ^= label[i]
            over[y] ^= label[i]
    for x in reversed(order):  # a node comes after the one it hangs on
        if up[x]:
            y, i = up[x]
            label[i] = over[x]
            over[y] ^= over[x]
    return block, [f"{v:032x}" if v else f"bridge {i}" for i, v in enumerate(label)], trail


def anatomy(edges: DataFrame) -> DataFrame:
    """(graph_id, block, series, a, b, node_id, trail): a row for each pair of neighbours a < b, and one for each node with its trail.

    One search a graph, which a task holds whole; parallel edges count as one, self-loops not at
    all, and a node without edges has no row. Trails are as long as the tree is deep.
    """
    prepare(edges.sparkSession)
    pairs = edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def each(t: pa.Table) -> pa.Table:
        a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
        block, series, trail = _anatomy(a, b)
        no, m = [None] * len(trail), [None] * len(a)
        ids = pa.array([t.column("graph_id")[0].as_py()] * (len(a) + len(trail)), t.schema.field("graph_id").type)
        cols = [pa.array(block + no, pa.int64()), *(pa.array(x + no, pa.string()) for x in (series, a, b)), pa.array(m + list(trail), pa.string()), pa.array(m + list(trail.values()), pa.list_(pa.string()))]
        return pa.table([ids, *cols], names=["graph_id", "block", "series", "a", "b", "node_id", "trail"])

    kind = pairs.schema["graph_id"].dataType.simpleString()
    return pairs.groupBy("graph_id").applyInArrow(each, f"graph_id {kind}, block long, series string, a string, b string, node_id string, trail array<string>")


def _way(s: Column, t: Column) -> Column:
    """Blocks and nodes between the ends of two trails, the ends too; null if their roots differ."""
    turn = F.element_at(s, F.size(F.array_intersect(s, t)))  # where the trails part
    return F.when(s[0] == t[0], F.array_union(F.array_union(F.array_except(s, t), F.array_except(t, s)), F.array(turn)))


def _trails(shape: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, trail) of all nodes; one without edges is a tree by itself."""
    return nodes.select("graph_id", "node_id").join(shape.where("node_id is not null").select("graph_id", "node_id", "trail"), ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("trail", F.array(F.concat(F.lit("n"), "node_id"))).alias("trail"))


def _edit(df: DataFrame, op: str, a: Column | str, b: Column | str | None = None, relation: Column | str | None = None) -> DataFrame:
    """(query_id, op, a, b, relation): the ends of an edge in order, a node alone in a."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    text = F.lit(None).cast("string")
    lo, hi = (a, text) if b is None else (F.least(a, b), F.greatest(a, b))
    r = text if relation is None else F.col(relation) if isinstance(relation, str) else relation
    return df.select("query_id", F.lit(op).alias("op"), lo.alias("a"), hi.alias("b"), r.alias("relation"))


def _single(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, relation): edges whose ends no other edge joins."""
    ends = edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation")
    return ends.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("_n"), F.first("relation").alias("relation")).where("_n = 1").drop("_n")


def _free(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, a, b): pairs of nodes a < b that no edge joins; as many as a graph has pairs."""
    n = nodes.select("graph_id", "node_id")
    both = n.toDF("graph_id", "a").join(n.toDF("graph_id", "b"), "graph_id").where("a < b")
    return both.join(_single_pairs(edges), ["graph_id", "a", "b"], "left_anti")


def _single_pairs(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _at(q: DataFrame, table: DataFrame, end: str, how: str = "left") -> DataFrame:
    """q with the columns of table (graph_id, node_id, ...) for its source or target, marked by that name's first letter."""
    rest = [c for c in table.columns if c not in ("graph_id", "node_id")]
    return q.join(table.select("graph_id", F.col("node_id").alias(end), *[F.col(c).alias(f"{end[0]}_{c}") for c in rest]), ["graph_id", end], how)


def _reachability(q: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    up = nodes.where("is_open").select("graph_id", "node_id")
    live = settle(edges.join(up.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(up.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"), "open-edges")
    shape = settle(anatomy(live), "open-anatomy")
    trail = settle(_trails(shape, up), "open-trails")
    q = settle(_at(_at(q, trail, "source"), trail, "target"), "reach-trails")
    met = q.withColumn("way", _way(F.col("s_trail"), F.col("t_trail"))).where("way is not null")
    step = met.select("query_id", "graph_id", F.explode("way").alias("at"))
    shut = _edit(step.where("at like 'n%'"), "SET_CLOSED", F.expr("substr(at, 2)"))
    bridge = shape.where("block is not null").groupBy("graph_id", "block").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    bridge = bridge.join(_single(live), ["graph_id", "a", "b"]).select("graph_id", F.concat(F.lit("b"), "block").alias("at"), "a", "b", "relation")
    cut = _edit(step.join(bridge, ["graph_id", "at"]), "DEL", "a", "b", "relation")
    apart = settle(q.where("s_trail is null or t_trail is null or s_trail[0] <> t_trail[0]").select("query_id", "graph_id", "source", "target", F.col("s_trail")[0].alias("s"), F.col("t_trail")[0].alias("t")), "apart")
    # A node that opens joins the components about it and itself.
    root = trail.select("graph_id", F.col("node_id").alias("dst"), F.col("trail")[0].alias("root"))
    closed = nodes.where("not is_open").select("graph_id", F.col("node_id").alias("v"))
    about = adjacency(edges).select("graph_id", F.col("src").alias("v"), "dst").join(closed, ["graph_id", "v"], "left_semi").join(root, ["graph_id", "dst"]).select("graph_id", "v", "root")
    about = settle(about.unionByName(closed.select("graph_id", "v", F.concat(F.lit("closed "), "v").alias("root"))).distinct(), "about-closed")
    side = lambda end, c: F.coalesce(c, F.concat(F.lit("closed "), end))
    ends = apart.select("query_id", "graph_id", side("source", "s").alias("root"), side("target", "t").alias("other"))
    opens = _edit(ends.join(about, ["graph_id", "root"]).join(about.withColumnRenamed("root", "other"), ["graph_id", "v", "other"]), "SET_OPEN", "v")
    two = apart.where("s is not null and t is not null")
    member = lambda end, node: root.toDF("graph_id", node, end)
    adds = _edit(two.join(member("s", "x"), ["graph_id", "s"]).join(member("t", "y"), ["graph_id", "t"]), "ADD", "x", "y")
    return functools.reduce(DataFrame.unionByName, (shut, cut, opens, adds))


def _cycle_membership(q: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    shape = settle(anatomy(edges), "anatomy")
    pair = shape.where("block is not null").select("graph_id", "block", "series", "a", "b")
    wide = pair.groupBy("graph_id", "block").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("graph_id", "block")
    ring = settle(pair.join(wide, ["graph_id", "block"]), "cycle-pairs")
    on = ring.select("graph_id", "block", "series", F.explode(F.array("a", "b")).alias("source")).groupBy("graph_id", "source").agg(F.countDistinct("block").alias("blocks"), F.count(F.lit(1)).alias("degree"), F.min("series").alias("series"))
    # A node leaves its last cycle if it has two edges in one block, and one of their series goes.
    weak = q.join(on.where("blocks = 1 and degree = 2"), ["graph_id", "source"]).join(ring.select("graph_id", "series", "a", "b"), ["graph_id", "series"]).join(_single(edges), ["graph_id", "a", "b"])
    idle = settle(q.join(on, ["graph_id", "source"], "left_anti").select("query_id", "graph_id", "source"), "off-cycles")
    trail = _trails(shape, nodes)
    asked = trail.join(idle.select("graph_id").distinct(), "graph_id", "left_semi")
    both = _free(nodes.join(idle.select("graph_id").distinct(), "graph_id", "left_semi"), edges)
    both = both.join(asked.toDF("graph_id", "a", "_s"), ["graph_id", "a"]).join(asked.toDF("graph_id", "b", "_t"), ["graph_id", "b"])
    along = both.select("graph_id", "a", "b", F.explode(F.filter(_way(F.col("_s"), F.col("_t")), lambda x: x.startswith("n"))).alias("at"))
    closing = idle.join(along.select("graph_id", "a", "b", F.expr("substr(at, 2)").alias("source")), ["graph_id", "source"])
    return _edit(weak, "DEL", "a", "b", "relation").unionByName(_edit(closing, "ADD", "a", "b"))


def _path_cost(q: DataFrame, nodes: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    up = nodes.where("is_open").select("graph_id", "node_id")
    unit = lambda c: F.round(c * UNIT).cast("long")
    ends = q.select("graph_id", F.explode(F.array("source", "target")).alias("source")).distinct()
    far = paths._query_paths(ends.join(up.withColumnRenamed("node_id", "target"), "graph_id"), nodes, edges).where("cost is not null")
    far = settle(far.select("graph_id", F.col("source").alias("end"), F.col("target").alias("node_id"), unit(F.col("cost")).alias("d")), "end-costs")
    to = lambda end, node, d: far.select("graph_id", F.col("end").alias(end), F.col("node_id").alias(node), F.col("d").alias(d))
    q = settle(q.join(to("source", "target", "cost"), ["graph_id", "source", "target"], "left"), "costs")
    met = q.where("cost is not null")
    shut = _edit(met.select("query_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("v")), "SET_CLOSED", "v")
    step = open_adjacency(nodes, edges).select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y"), "relation", unit(F.col("weight")).alias("w"))
    # Edges of best paths, each from its nearer end's cost to its farther one's. All paths share what nothing else overlaps.
    best = met.join(to("source", "x", "lo"), ["graph_id", "source"]).join(step, ["graph_id", "x"]).join(to("target", "y", "left"), ["graph_id", "target", "y"]).where("lo + w + left = cost")
    best = best.select("query_id", "source", "x", "y", "relation", "lo", (F.col("lo") + F.col("w")).alias("hi"))
    by = Window.partitionBy("query_id").orderBy("lo")
    level = Window.partitionBy("query_id", "lo")
    best = best.select("*", F.max("hi").over(by.rangeBetween(Window.unboundedPreceding, -1)).alias("past"), F.min("lo").over(by.rangeBetween(1, Window.unboundedFollowing)).alias("next"), F.count(F.lit(1)).over(level).alias("n"), (F.min("x").over(level) == F.max("x").over(level)).alias("one"))
    best = settle(best.where("past is null or past <= lo"), "shared-steps")
    cut = _edit(best.where("n = 1 and (next is null or next >= hi)"), "DEL", "x", "y", "relation")
    passed = _edit(best.where("one and x <> source").select("query_id", "x").distinct(), "SET_CLOSED", "x")
    # What opens or is added makes a path cheaper, or makes one.
    fresh = F.col("cost").isNull() | (F.col("ds") + F.col("dt") < F.col("cost"))
    closed = nodes.where("not is_open").select("graph_id", F.col("node_id").alias("v"))
    link = adjacency(edges).select("graph_id", F.col("src").alias("v"), F.col("dst").alias("node_id"), unit(F.col("weight")).alias("w")).join(closed, ["graph_id", "v"], "left_semi")
    reach = far.join(link, ["graph_id", "node_id"]).groupBy("graph_id", "end", "v").agg(F.min(F.col("d") + F.col("w")).alias("d"))
    reach = settle(reach.unionByName(closed.select("graph_id", F.col("v").alias("end"), "v", F.lit(0).cast("long").alias("d"))), "costs-to-closed")
    opens = q.join(reach.toDF("graph_id", "source", "v", "ds"), ["graph_id", "source"]).join(reach.toDF("graph_id", "target", "v", "dt"), ["graph_id", "target", "v"]).where(fresh)
    more = q.join(to("source", "x", "ds").withColumn("ds", F.col("ds") + F.lit(round(weight * UNIT))), ["graph_id", "source"]).join(to("target", "y", "dt"), ["graph_id", "target"]).where(fresh & (F.col("x") != F.col("y")))
    more = more.select("query_id", "graph_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(_single_pairs(edges), ["graph_id", "a", "b"], "left_anti")
    return functools.reduce(DataFrame.unionByName, (shut, cut, passed, _edit(opens, "SET_OPEN", "v"), _edit(more, "ADD", "a", "b")))


def _edge_exists(q: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    q = q.select("query_id", "graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    cut = _edit(q.join(_single(edges), ["graph_id", "a", "b"]), "DEL", "a", "b", "relation")
    return cut.unionByName(_edit(q.where("a <> b").join(_single_pairs(edges), ["graph_id", "a", "b"], "left_anti"), "ADD", "a", "b"))


def _node_degree(q: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    cut = _edit(q.join(adjacency(edges).select("graph_id", F.col("src").alias("source"), "dst", "relation").distinct(), ["graph_id", "source"]), "DEL", "source", "dst", "relation")
    other = q.join(nodes.select("graph_id", F.col("node_id").alias("y")), "graph_id").where("y <> source")
    free = other.select("query_id", "graph_id", F.least("source", "y").alias("a"), F.greatest("source", "y").alias("b")).join(_single_pairs(edges), ["graph_id", "a", "b"], "left_anti")
    return cut.unionByName(_edit(free, "ADD", "a", "b"))


def changing_edits(queries: DataFrame, nodes: DataFrame, edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """(query_id, op, a, b, relation): every candidate edit that changes the answer of a query (query_id, kind, graph_id, source, target).

    Of the kinds in KINDS; other kinds have no rows, and neither has a query whose source, or whose
    target where its kind needs one, is null or not in its graph: it stays invalid. b is null for
    nodes, relation names the edge that a DEL takes and is null otherwise. An ADD has the given
    weight. Of path_cost the cost counts before it is rounded for an answer. Weights are positive,
    query_id tells queries apart and edges are told apart by their ends and relation. Graphs with
    directed edges are refused. Results are as large as what changes: a part of a graph's pairs a query.
    """
    if "directed" in edges.columns and not edges.where("directed").isEmpty():
        raise ValueError("edits of directed graphs are not indexed")
    node = nodes.select("graph_id", F.col("node_id").alias("source")).distinct()
    q = queries.select("query_id", "kind", "graph_id", "source", "target").where(F.col("kind").isin(*KINDS)).join(node, ["graph_id", "source"], "left_semi")
    one = q.where(F.col("kind").isin("cycle_membership", "node_degree"))
    two = q.where(~F.col("kind").isin("cycle_membership", "node_degree")).join(node.withColumnRenamed("source", "target"), ["graph_id", "target"], "left_semi")
    q = settle(one.unionByName(two), "what-if-queries")
    edges = edges.select("graph_id", "src", "dst", "relation", "weight")
    plans = {"reachability": _reachability, "cycle_membership": _cycle_membership, "path_cost": functools.partial(_path_cost, weight=weight), "edge_exists": _edge_exists, "node_degree": _node_degree}
    parts = []
    for kind, plan in plans.items():
        mine = q.where(F.col("kind") == kind)
        about = mine.select("graph_id").distinct()
        parts.append(plan(mine, nodes.join(about, "graph_id", "left_semi"), edges.join(about, "graph_id", "left_semi")))
    return functools.reduce(DataFrame.unionByName, parts)


def edited(edits: DataFrame, nodes: DataFrame, edges: DataFrame, weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph after each of the edits (name, graph_id, op, a, b, relation), with name in place of graph_id.

    An ADD has the given weight and no relation.
    """
    e = edits.select("name", "graph_id", "op", "a", "b", "relation")
    node = e.join(nodes.select("graph_id", "node_id", "is_open"), "graph_id")
    node = node.select(F.col("name").alias("graph_id"), "node_id", F.when(F.col("op").startswith("SET") & (F.col("a") == F.col("node_id")), F.col("op") == "SET_OPEN").otherwise(F.col("is_open")).alias("is_open"))
    gone = (F.col("op") == "DEL") & (F.col("a") == F.least("src", "dst")) & (F.col("b") == F.greatest("src", "dst")) & F.col("relation").eqNullSafe(F.col("_own"))
    edge = e.join(edges.select("graph_id", "src", "dst", F.col("relation").alias("_own"), "weight"), "graph_id").where(~gone).select(F.col("name").alias("graph_id"), "src", "dst", F.col("_own").alias("relation"), "weight")
    new = e.where("op = 'ADD'").select(F.col("name").alias("graph_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("string").alias("relation"), F.lit(weight).alias("weight"))
    return node, edge.unionByName(new)


def counterfactual_pairs(queries: DataFrame, nodes: DataFrame, edges: DataFrame, each: int, seed: int = 0, weight: float = 1.0) -> DataFrame:
    """(query_id, kind, graph_id, source, target, op, a, b, relation, before, after): for each graph and kind up to each questions with an edit that changes the answer.

    The index says which edits do, so only the chosen ones are carried out and answered. The ops
    take turns, and within an op chance decides by the seed, so answers change in both directions
    where the graph allows it. As for candidates of a corpus, questions about ways have open ends
    before the edit, and those about cycles a source of two edges. Pairs of one answer after
    rounding are left out.
    """
    up, ways = nodes.where("is_open").select("graph_id", "node_id"), F.col("kind").isin("reachability", "path_cost")
    q = queries.where(F.col("kind").isin(*KINDS)).select("query_id", "kind", "graph_id", "source", "target")
    two = adjacency(edges).groupBy("graph_id", F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("_d")).where("_d = 2").drop("_d")
    open_ends = q.where(ways).join(up.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(up.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")
    on_two = q.where("kind = 'cycle_membership'").join(two, ["graph_id", "source"], "left_semi")
    q = settle(open_ends.unionByName(on_two).unionByName(q.where(F.col("kind").isin("edge_exists", "node_degree"))), "pair-queries")
    found = changing_edits(q, nodes, edges, weight).join(q, "query_id").withColumn("_by", quota.seeded(seed, "query_id", "op", "a", "b", "relation"))
    # Row numbers that a limit follows keep each rows a partition before the shuffle.
    nth = F.row_number().over(Window.partitionBy("graph_id", "kind", "op").orderBy("_by", "query_id", "a", "b"))
    found = found.withColumn("_nth", nth).where(F.col("_nth") <= each)
    turn = F.row_number().over(Window.partitionBy("graph_id", "kind").orderBy("_nth", "op"))
    pick = found.withColumn("_turn", turn).where(F.col("_turn") <= each).withColumn("name", F.concat_ws("~", F.col("graph_id").cast("string"), "op", "a", "b", "relation"))
    pick = settle(pick.select("query_id", "kind", "graph_id", "source", "target", "op", "a", "b", "relation", "name"), "pairs")
    n, e = edited(pick.select("name", "graph_id", "op", "a", "b", "relation").distinct(), nodes, edges, weight)
    n = n.unionByName(nodes.select(F.col("graph_id").cast("string").alias("graph_id"), "node_id", "is_open"))
    e = e.unionByName(edges.select(F.col("graph_id").cast("string").alias("graph_id"), "src", "dst", "relation", "weight"))
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    when = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("graph_id").cast("string").alias("at")), F.struct(F.lit("after").alias("side"), F.col("name").alias("at"))))
    ask = pick.select("query_id", "name", "kind", "source", "target", when.alias("w"))
    asked = settle(ask.select(F.to_json(F.struct("query_id", "name", "w.side")).alias("_id"), "query_id", "name", "kind", F.col("w.side").alias("side"), F.col("w.at").alias("graph_id"), "source", "target"), "pair-questions")
    no_attrs = nodes.where("false").select(F.col("graph_id").cast("string").alias("graph_id"), "node_id", text.alias("name"), text.alias("token"), text.alias("text"))
    said = solve.answer_queries(asked.select(F.col("_id").alias("query_id"), "kind", "graph_id", "source", "target", text.alias("attribute"), text.alias("token"), none.alias("hops")), settle(n, "pair-nodes"), settle(e, "pair-edges"), no_attrs, KINDS)
    both = asked.join(said.withColumnRenamed("query_id", "_id"), "_id").groupBy("query_id", "name").agg(*[F.max(F.when(F.col("side") == s, F.col("answer"))).alias(s) for s in ("before", "after")])
    return pick.join(both.where("before <> after"), ["query_id", "name"]).drop("name")
