"""Adjacency of graph collections, keyed by graph: both directions of every edge that has none of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settle


def two_way(edges: DataFrame) -> Column:
    """Whether an edge leads both ways: always, unless edges has a column directed that is set."""
    return ~F.coalesce(F.col("directed"), F.lit(False)) if "directed" in edges.columns else F.lit(True)


def directed_graphs(edges: DataFrame) -> DataFrame | None:
    """(graph_id) of graphs with directed edges; null where edges knows no direction."""
    return edges.where(~two_way(edges)).select("graph_id").distinct() if "directed" in edges.columns else None


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, relation, weight), with edges reversed too unless they are directed. Parallel edges stay apart."""
    cols = ["graph_id", "src", "dst", "relation", "weight"]
    back = edges.where(two_way(edges)).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight")
    return edges.select(*cols).unionByName(back)


def open_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adjacency among available nodes only: those whose is_open is set.

    A node is open unless its status is closed or its attribute open is false (see sources.records).
    """
    ok = nodes.where("is_open").select("graph_id", "node_id")
    adj = adjacency(edges)
    return adj.join(ok.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).join(ok.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).select(*adj.columns)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree): parallel edges count apart, isolated nodes have 0."""
    d = adjacency(edges).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


#: Steps that are planned together; each step beyond is settled and ends the rounds if it finds nothing.
_PLANNED = 3


def hop_map(sources: DataFrame, edges: DataFrame, hops: int | None, available: DataFrame | None = None) -> DataFrame:
    """(graph_id, source, node_id, depth) of nodes at 1 to hops steps from each source (graph_id, source), at any number if hops is null.

    With available nodes given, steps lead over the open ones among them only. One join a step; a
    node found at a smaller depth is not visited again, and a source with a column radius goes no
    farther than that.
    """
    adj = (adjacency(edges) if available is None else open_adjacency(available, edges)).select("graph_id", "src", "dst").distinct()
    own = ["radius"] if "radius" in sources.columns else []
    seen = sources.select("graph_id", "source", F.col("source").alias("node_id"), *own, F.lit(0).cast("long").alias("depth"))
    h = 0
    while hops is None or h < hops:
        h += 1
        front = seen.where(F.col("depth") == h - 1)
        if h > _PLANNED:
            if h == _PLANNED + 1:
                adj = settle(adj, "hop-edges")
            seen = settle(seen, f"hops-{h - 1}")
            front = seen.where(F.col("depth") == h - 1)
            if front.isEmpty():
                break
        if own:
            front = front.where(F.col("radius") >= h)
        front = front.select("graph_id", "source", F.col("node_id").alias("src"), *own)
        step = front.join(adj, ["graph_id", "src"]).select("graph_id", "source", F.col("dst").alias("node_id"), *own, F.lit(h).cast("long").alias("depth"))
        seen = seen.unionByName(step).groupBy("graph_id", "source", "node_id", *own).agg(F.min("depth").alias("depth"))
    return seen.where("depth > 0").drop(*own)
