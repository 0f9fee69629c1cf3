"""Trade graphs and editing sessions derived from the star-schema tables.

A graph is a market segment and order priority; its nodes are the nations, and each customer nation
is linked to the supplier nations it buys from most. A session is a user of the events stream; its
turns edit one of the graphs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..operators.solve import KINDS
from ..shared import numbered, once


@dataclass
class Graphs:
    """nodes(graph_id, node_id, label, is_open), edges(graph_id, src, dst, relation, weight) with each edge once,
    attrs(graph_id, node_id, name, token, text)."""

    nodes: DataFrame
    edges: DataFrame
    attrs: DataFrame


def _table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*cols)


def trade_counts(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, s, t, cnt): line items bought by customers of nation s from suppliers of nation t <> s.

    Line items meet their orders in one shuffle and are then counted by nation: a few hundred rows a
    graph, settled once for an input folder.
    """

    def build() -> DataFrame:
        orders = _table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
        customer = _table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
        items = _table(spark, d, "lineitem", "l_orderkey", "l_suppkey")
        supplier = _table(spark, d, "supplier", "s_suppkey", "s_nationkey")
        bought = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "o_orderpriority", "c_nationkey", "c_mktsegment")
        joined = items.join(supplier, items.l_suppkey == supplier.s_suppkey).join(bought, items.l_orderkey == bought.o_orderkey).where("c_nationkey <> s_nationkey")
        counts = joined.groupBy("c_mktsegment", "o_orderpriority", "c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("cnt"))
        return counts.select(F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("graph_id"), F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t"), "cnt")

    return once(spark, d, "trade-counts", build)


def graph_ids(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, gi): every segment and priority, numbered in order of graph_id."""

    def build() -> DataFrame:
        # The names of segments and priorities: two short lists, every pair of which is a graph.
        seg = _table(spark, d, "customer", "c_mktsegment").distinct()
        pri = _table(spark, d, "orders", "o_orderpriority").distinct()
        return numbered(seg.crossJoin(pri).select(F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("graph_id")), ["graph_id"], "gi")

    return once(spark, d, "graph-ids", build)


def trade_graphs(spark: SparkSession, d: str, k: int = 1) -> Graphs:
    """The trade graphs with each nation's k largest partners."""
    nation = _table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, d, "region", "r_regionkey", "r_name")
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("label"), F.col("r_name").alias("line"))
    every = graph_ids(spark, d).crossJoin(nations)  # the nodes: every graph has every nation
    every = every.withColumn("node_id", F.concat(F.lit("n"), F.col("nk").cast("string")))
    every = every.withColumn("status", F.when((F.col("nk") * 7 + F.col("gi") * 3) % 11 == 0, "closed").otherwise("open"))
    # Nodes and attributes are settled, as edges are, so that joins know how small they are.
    nodes = once(spark, d, "nodes", lambda: every.select("graph_id", "node_id", "label", (F.col("status") != "closed").alias("is_open"), "gi", "nk"))
    rail, access = F.col("nk") % 2 == 0, F.floor(F.col("nk") / 5) % 2 == 0
    clean = F.element_at(F.array(*map(F.lit, ("clean", "average", "dirty"))), (F.col("nk") % 3 + 1).cast("int"))
    size = F.element_at(F.array(*map(F.lit, ("small", "medium", "large", "small"))), (F.col("nk") % 4 + 1).cast("int"))

    def attr(name, token, text):
        return F.struct(F.lit(name).alias("name"), token.alias("token"), text.alias("text"))

    values = F.array(
        attr("has_rail", tok.bool_token(rail), tok.bool_text(rail)),
        attr("disabled_access", tok.bool_token(access), tok.bool_text(access)),
        *[attr(n, tok.string_token(c), c) for n, c in (("line", F.col("line")), ("cleanliness", clean), ("size", size), ("status", F.col("status")))],
    )
    attrs = once(spark, d, "attributes", lambda: every.select("graph_id", "node_id", F.explode(values).alias("a")).select("graph_id", "node_id", "a.*"))
    ranked = trade_counts(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "s").orderBy(F.desc("cnt"), "t"))).where(F.col("rank") <= k)
    pairs = ranked.groupBy("graph_id", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.max("cnt").alias("cnt"))
    line = nations.select("nk", "line")
    edges = pairs.join(line.toDF("a", "line_a"), "a").join(line.toDF("b", "line_b"), "b")
    edges = edges.select(
        "graph_id",
        F.concat(F.lit("n"), F.col("a").cast("string")).alias("src"),
        F.concat(F.lit("n"), F.col("b").cast("string")).alias("dst"),
        F.when(F.col("line_a") == F.col("line_b"), "track").otherwise("transfer").alias("relation"),
        (F.lit(1) + F.col("cnt") % 5).cast("double").alias("weight"),
    )
    return Graphs(nodes, once(spark, d, f"edges-{k}", lambda: edges), attrs)


def mixed_graphs(spark: SparkSession, d: str, k: int = 2) -> Graphs:
    """The trade graphs, those of odd number directed: each nation as a customer points to its k largest suppliers.

    edges has a column directed. The weight of a directed edge is 1 + its items modulo 7, over 2, so that paths tie and halves occur.
    """
    g = trade_graphs(spark, d, 1)
    odd = graph_ids(spark, d).where("gi % 2 = 1").select("graph_id")
    ranked = trade_counts(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "s").orderBy(F.desc("cnt"), "t"))).where(F.col("rank") <= k)
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    arrows = ranked.join(odd, "graph_id", "left_semi").select("graph_id", node("s").alias("src"), node("t").alias("dst"), F.lit("supply").alias("relation"), ((F.lit(1) + F.col("cnt") % 7) / 2).cast("double").alias("weight"), F.lit(True).alias("directed"))
    plain = g.edges.join(odd, "graph_id", "left_anti").withColumn("directed", F.lit(False))
    return Graphs(g.nodes, once(spark, d, f"mixed-edges-{k}", lambda: plain.unionByName(arrows)), g.attrs)


def mixed_questions(g: Graphs) -> DataFrame:
    """(query_id, kind, graph_id, source, target, attribute, value, token, hops): a question about each ordered pair of nodes of each graph.

    All sixteen kinds come in turn; hops run from 0 to 6.
    """
    a = g.nodes.select("graph_id", "gi", F.col("nk").alias("x"), F.col("node_id").alias("source"))
    b = g.nodes.select("graph_id", F.col("nk").alias("y"), F.col("node_id").alias("target"))
    no = F.col("x") * 25 + F.col("y") + F.col("gi") * 3
    q = a.join(b, "graph_id").where("x <> y").withColumn("no", no)
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col("no") / 16) % n + 1).cast("int"))
    q = q.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("no") % 16 + 1).cast("int")))
    q = q.withColumn("attribute", pick(4, "has_rail", "status", "cleanliness", None)).withColumn("value", pick(4, "False", "closed", "dirty", None)).withColumn("hops", (F.col("no") % 7).cast("long"))
    cols = ["kind", "graph_id", "source", "target", "attribute", "value", tok.literal(F.col("value"))["token"].alias("token"), "hops"]
    return q.select(F.concat_ws("/", "graph_id", "source", "target").alias("query_id"), *cols)


def pair_queries(g: Graphs) -> DataFrame:
    """(graph_id, source, target): all node pairs a < b of each graph."""
    a = g.nodes.select("graph_id", F.col("nk").alias("a"), F.col("node_id").alias("source"))
    b = g.nodes.select("graph_id", F.col("nk").alias("b"), F.col("node_id").alias("target"))
    return a.join(b, "graph_id").where("a < b").select("graph_id", "source", "target")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, turn_index, graph_id, op, a, b, event_id): the events of each user, in order, as edits of a graph.

    op is SET_CLOSED, SET_OPEN, ADD, DEL or NOOP; a and b are node ids, in that order.
    """
    e = _table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("turn_index", (F.row_number().over(order) - 1).cast("long"))
    x, y = F.get_json_object("props", "$.k").cast("long") % 25, F.col("event_id") % 25
    op = F.when(x == y, "NOOP").when(F.col("event_type") == "error", "SET_CLOSED").when(F.col("event_type") == "signup", "SET_OPEN").when(F.col("event_type") == "purchase", "ADD").when(F.col("event_type") == "click", "DEL").otherwise("NOOP")
    e = e.withColumn("op", op).withColumn("x", x).withColumn("y", y)
    g = graph_ids(spark, d)
    return e.join(g, e.user_id % 25 == g.gi).select(
        F.col("user_id").alias("session_id"), "turn_index", "graph_id", "op",
        F.concat(F.lit("n"), F.col("x").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("y").cast("string")).alias("b"), "event_id",
    )
