"""Structural summaries and checks of graph collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adjacency import adjacency, degrees, hop_map


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, c) with a < b < c, all three joined."""
    p = edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ab, bc, ac = p.toDF("graph_id", "a", "b"), p.toDF("graph_id", "b", "c"), p.toDF("graph_id", "a", "c")
    return ab.join(bc, ["graph_id", "b"]).join(ac, ["graph_id", "a", "c"]).select("graph_id", "a", "b", "c")


def common_neighbors(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, n): shared neighbours of the pairs a < b that have any."""
    adj = adjacency(edges).select("graph_id", "src", "dst").distinct()
    both = adj.toDF("graph_id", "a", "mid").join(adj.toDF("graph_id", "b", "mid"), ["graph_id", "mid"]).where("a < b")
    return both.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def two_hop_reach(nodes: DataFrame, edges: DataFrame, cap: int = 8) -> DataFrame:
    """(graph_id, node_id, reach): other nodes within two steps, at most cap."""
    src = nodes.select("graph_id", F.col("node_id").alias("source"))
    n = hop_map(src, edges, 2).where("node_id <> source").groupBy("graph_id", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("graph_id", "node_id").join(n, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("long").alias("reach"))


def leaf_neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, has_leaf): whether a neighbour has degree one."""
    leaf = degrees(nodes, edges).where("degree = 1").select("graph_id", F.col("node_id").alias("dst"))
    near = adjacency(edges).join(leaf, ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node_id")).distinct().withColumn("_leaf", F.lit(True))
    return nodes.select("graph_id", "node_id").join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("_leaf", F.lit(False)).alias("has_leaf"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges, density_bin): sparse under .08, medium under .18 of all pairs, else dense; one node alone is sparse."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = n.join(m, "graph_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)).cast("long"))
    share = F.coalesce(F.try_divide(F.col("n_edges") * 2, F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0))
    return out.withColumn("density_bin", F.when(share < 0.08, "sparse").when(share < 0.18, "medium").otherwise("dense"))


def mean_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, mean_degree): twice the edges a node."""
    return density(nodes, edges).select("graph_id", (F.col("n_edges") * 2 / F.col("n_nodes")).alias("mean_degree"))


def missing_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, a, b) with a < b: pairs that no edge joins, the candidates for an ADD."""
    n = nodes.select("graph_id", "node_id")
    pairs = n.toDF("graph_id", "a").join(n.toDF("graph_id", "b"), "graph_id").where("a < b")
    return pairs.join(edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["graph_id", "a", "b"], "left_anti")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, rule, item, n): duplicate node ids, dangling ends, self-loops and duplicate edges of each graph."""
    twice = nodes.groupBy("graph_id", F.col("node_id").alias("item")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id", F.lit("duplicate_node").alias("rule"), "item", "n")
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("item"))
    loose = ends.join(nodes.select("graph_id", F.col("node_id").alias("item")).distinct(), ["graph_id", "item"], "left_anti").groupBy("graph_id", "item").agg(F.count(F.lit(1)).alias("n")).select("graph_id", F.lit("dangling_edge").alias("rule"), "item", "n")
    loops = edges.where("src = dst").groupBy("graph_id", F.col("src").alias("item")).agg(F.count(F.lit(1)).alias("n")).select("graph_id", F.lit("self_loop").alias("rule"), "item", "n")
    key = F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst"), "relation")
    same = edges.groupBy("graph_id", key.alias("item")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id", F.lit("duplicate_edge").alias("rule"), "item", "n")
    return twice.unionByName(loose).unionByName(loops).unionByName(same)


def state_key(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, state_key): a hash of the set of closed nodes and the set of joined pairs."""
    closed = nodes.where("not is_open").groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("closed"))
    pairs = edges.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst")))), ",").alias("pairs"))
    both = nodes.select("graph_id").distinct().join(closed, "graph_id", "left").join(pairs, "graph_id", "left")
    return both.select("graph_id", F.md5(F.concat(F.coalesce("closed", F.lit("")), F.lit("/"), F.coalesce("pairs", F.lit("")))).alias("state_key"))


def neighborhood_hash(nodes: DataFrame, edges: DataFrame, attrs: DataFrame, names: tuple[str, ...] = ("line", "status", "size"), rounds: int = 3) -> DataFrame:
    """(graph_id, wl_hash): Weisfeiler-Lehman refinement over the named attributes, then a hash of all colours."""
    held = attrs.where(F.col("name").isin(*names)).groupBy("graph_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "text"))), ",").alias("label"))
    color = nodes.select("graph_id", "node_id").join(held, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.md5(F.coalesce("label", F.lit(""))).alias("color"))
    adj = adjacency(edges).select("graph_id", "src", "dst").distinct()
    for _ in range(rounds):
        near = adj.join(color.select("graph_id", F.col("node_id").alias("dst"), F.col("color").alias("c")), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("near"))
        color = color.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.md5(F.concat("color", F.lit("|"), F.coalesce("near", F.lit("")))).alias("color"))
    return color.groupBy("graph_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("color")), ",")).alias("wl_hash"))


def neighbor_aggregate(nodes: DataFrame, edges: DataFrame, value: DataFrame) -> DataFrame:
    """(graph_id, node_id, sum, mean, max) of a node value over neighbours, weighted by edge; the mean divides by max(1, total weight).

    value is (graph_id, node_id, x). Nodes without neighbours get zeros.
    """
    near = adjacency(edges).join(value.select("graph_id", F.col("node_id").alias("dst"), "x"), ["graph_id", "dst"])
    agg = near.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum(F.col("weight") * F.col("x")).alias("s"), F.sum(F.abs("weight")).alias("w"), F.max(F.col("x")).alias("m"))
    out = nodes.select("graph_id", "node_id").join(agg, ["graph_id", "node_id"], "left")
    zero = F.lit(0.0)
    return out.select("graph_id", "node_id", F.coalesce("s", zero).alias("sum"), (F.coalesce("s", zero) / F.greatest(F.coalesce("w", zero), F.lit(1.0))).alias("mean"), F.coalesce("m", zero).alias("max"))


def ring_pairs(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, joined): pairs a < b two steps apart over a common neighbour, and whether an edge joins them too."""
    near = common_neighbors(edges)
    pairs = edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(True).alias("_e")).distinct()
    return near.join(pairs, ["graph_id", "a", "b"], "left").select("graph_id", "a", "b", F.coalesce("_e", F.lit(False)).alias("joined"))


def tensor_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, row, src_row, dst_row, weight): both directions of every edge by the places of their ends in order of id, sorted."""
    place = nodes.select("graph_id", "node_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1).cast("long").alias("at"))
    both = adjacency(edges).join(place.toDF("graph_id", "src", "src_row"), ["graph_id", "src"]).join(place.toDF("graph_id", "dst", "dst_row"), ["graph_id", "dst"])
    order = Window.partitionBy("graph_id").orderBy("src_row", "dst_row", "relation", "weight")
    return both.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("row"), "src_row", "dst_row", "weight")
