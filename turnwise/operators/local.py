"""Graph questions answered by joins alone: degrees, neighbours, hops, attributes.

Each operator takes the collection's frames and a frame of queries and returns the queries with a
string ``answer``. A query whose source is not in its graph is ``invalid``. Queries that differ in
any of source, attribute, token and hops are answered apart, null tokens included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adjacency import adjacency, degrees, hop_map


def checked(queries: DataFrame, nodes: DataFrame, answer: Column) -> DataFrame:
    """Queries with their answer, ``invalid`` where the source is unknown."""
    known = nodes.select("graph_id", F.col("node_id").alias("source"), F.lit(True).alias("_known"))
    return queries.join(known, ["graph_id", "source"], "left").withColumn("answer", F.when(F.col("_known"), answer).otherwise("invalid")).drop("_known")


def node_degree(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges).withColumnRenamed("node_id", "source")
    return queries.join(d, ["graph_id", "source"], "left").withColumn("answer", F.coalesce(F.col("degree").cast("string"), F.lit("invalid"))).drop("degree")


def node_count(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    return checked(queries.join(n, "graph_id", "left"), nodes, F.col("_n").cast("string")).drop("_n")


def edge_exists(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """yes if any relation joins source and target; a null target is invalid."""
    near = adjacency(edges).select("graph_id", F.col("src").alias("source"), F.col("dst").alias("target")).distinct().withColumn("_met", F.lit(True))
    out = queries.join(near, ["graph_id", "source", "target"], "left")
    answer = F.when(F.col("target").isNull(), "invalid").when(F.col("_met"), "yes").otherwise("no")
    return checked(out, nodes, answer).drop("_met")


#: Predicting a link asks whether it is there.
link_prediction = edge_exists


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with right on equal keys, where null equals null; keys of right go."""
    there = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        # Graph and node ids take part in an equi-join; the others are null-safe equalities.
        on &= left[k] == there[f"_r_{k}"] if k in ("graph_id", "source", "target") else left[k].eqNullSafe(there[f"_r_{k}"])
    return left.join(there, on, how).drop(*[f"_r_{k}" for k in keys])


def _held(attrs: DataFrame) -> DataFrame:
    return attrs.select("graph_id", "node_id", F.col("name").alias("attribute"), F.col("token").alias("_own"))


def filtered_neighbor_count(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """Neighbours whose attribute equals the queried token; parallel edges count apart."""
    keys = ["graph_id", "source", "attribute", "token"]
    asked = queries.select(*keys).distinct()
    near = asked.join(adjacency(edges).select("graph_id", F.col("src").alias("source"), F.col("dst").alias("node_id")), ["graph_id", "source"])
    near = near.join(_held(attrs), ["graph_id", "node_id", "attribute"], "left").where(F.col("_own").eqNullSafe(F.col("token")))
    n = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return checked(_null_safe(queries, n, keys), nodes, F.coalesce("_n", F.lit(0)).cast("string")).drop("_n")


def attribute_lookup(queries: DataFrame, nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """The printed value of an attribute, none where it is missing or null."""
    own = attrs.select("graph_id", F.col("node_id").alias("source"), F.col("name").alias("attribute"), "text")
    return checked(queries.join(own, ["graph_id", "source", "attribute"], "left"), nodes, F.coalesce("text", F.lit("none"))).drop("text")


def attribute_check(queries: DataFrame, nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """yes if the attribute equals the queried token; a missing attribute equals a null one."""
    own = attrs.select("graph_id", F.col("node_id").alias("source"), F.col("name").alias("attribute"), F.col("token").alias("_own"))
    answer = F.when(F.col("_own").eqNullSafe(F.col("token")), "yes").otherwise("no")
    return checked(queries.join(own, ["graph_id", "source", "attribute"], "left"), nodes, answer).drop("_own")


def _with_hops(queries: DataFrame, hops: int) -> DataFrame:
    """Queries with their radius _hops: their own hops where they have such a column, 2 for null and 0, else the one given."""
    own = F.coalesce(F.when(F.col("hops") != 0, F.col("hops")), F.lit(2)) if "hops" in queries.columns else F.lit(hops)
    return queries.withColumn("_hops", own.cast("int"))


def _reached(asked: DataFrame, edges: DataFrame, attrs: DataFrame | None, hops: int | None) -> DataFrame:
    """asked with each node within its radius; of those the ones with its attribute, if it names one and attrs is given.

    hops is the radius of all queries; where they have their own, it is null and the largest counts.
    """
    if hops is None:
        hops = asked.agg(F.max("_hops")).first()[0] or 0
    near = hop_map(asked.groupBy("graph_id", "source").agg(F.max("_hops").alias("radius")), edges, hops)
    near = asked.join(near, ["graph_id", "source"]).where(F.col("depth") <= F.col("_hops"))
    if attrs is None:
        return near
    held = near.join(_held(attrs), ["graph_id", "node_id", "attribute"], "left")
    return held.where(F.col("attribute").isNull() | F.col("_own").eqNullSafe(F.col("token")))


def _hop_keys(queries: DataFrame, attrs: DataFrame | None) -> list[str]:
    return ["graph_id", "source", "_hops"] + (["attribute", "token"] if attrs is not None else [])


def within_hops_count(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame | None = None, hops: int = 2) -> DataFrame:
    """Nodes at 1 to hops steps, of those the ones with the queried attribute if attrs is given and the query names one.

    Queries may have hops of their own, as many as they like.
    """
    q, keys = _with_hops(queries, hops), _hop_keys(queries, attrs)
    n = _reached(q.select(*keys).distinct(), edges, attrs, None if "hops" in queries.columns else hops).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return checked(_null_safe(q, n, keys), nodes, F.coalesce("_n", F.lit(0)).cast("string")).drop("_n", "_hops")


def within_hops_list(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame | None = None, hops: int = 2) -> DataFrame:
    """Labels of the nodes that within_hops_count counts, sorted and joined by comma and space; none if there is none."""
    q, keys = _with_hops(queries, hops), _hop_keys(queries, attrs)
    named = _reached(q.select(*keys).distinct(), edges, attrs, None if "hops" in queries.columns else hops).join(nodes.select("graph_id", "node_id", "label"), ["graph_id", "node_id"])
    lists = named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("_list"))
    return checked(_null_safe(q, lists, keys), nodes, F.coalesce("_list", F.lit("none"))).drop("_list", "_hops")


def most_common_attribute(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame, hops: int = 2) -> DataFrame:
    """The commonest printed value of an attribute within hops, the source included; the smallest among equals; none without values."""
    q, keys = _with_hops(queries, hops), ["graph_id", "source", "_hops", "attribute"]
    asked = q.select(*keys).distinct()
    near = _reached(asked, edges, None, None if "hops" in queries.columns else hops).select(*keys, "node_id").unionByName(asked.withColumn("node_id", F.col("source")))
    held = near.distinct().join(attrs.withColumnRenamed("name", "attribute"), ["graph_id", "node_id", "attribute"]).where("text is not null")
    n = held.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.min_by("text", F.struct(-F.col("n"), "text")).alias("_top"))
    return checked(_null_safe(q, top, keys), nodes, F.coalesce("_top", F.lit("none"))).drop("_top", "_hops")
