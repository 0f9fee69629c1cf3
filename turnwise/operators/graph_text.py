"""Graphs in words: nodes with their attributes, whole graphs as text, order-insensitive fingerprints, prompts.

A graph's text is one row, for graphs of dozens of nodes as the collections hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def node_attributes(attrs: DataFrame) -> DataFrame:
    """(graph_id, node_id, attributes): the attributes of each node as an array of (name, text), sorted by name."""
    return attrs.groupBy("graph_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("attributes"))


def node_text(nodes: DataFrame, attrs: DataFrame, excluded: Column | None = None) -> DataFrame:
    """(graph_id, node_id, text): label and attributes of each node without the excluded names."""
    out = nodes.select("graph_id", "node_id", "label").join(node_attributes(attrs), ["graph_id", "node_id"], "left")
    none = F.array().cast("array<struct<name:string,text:string>>")
    return out.select("graph_id", "node_id", tx.facts(F.col("label"), F.coalesce("attributes", none), F.array().cast("array<string>") if excluded is None else excluded).alias("text"))


def weight_text(c: Column) -> Column:
    """A weight with up to six significant digits and no zeros at the end."""
    digits = F.format_string("%.6f", c)
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ""))


def serialize_graph(nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """(graph_id, text): nodes in order of id with label and attributes, then edges in order of source, target and relation."""
    listed = F.array_join(F.transform("attributes", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["text"], F.lit("None")))), ", ")
    node = nodes.select("graph_id", "node_id", "label").join(node_attributes(attrs), ["graph_id", "node_id"], "left")
    node = node.select("graph_id", F.struct("node_id", F.concat("node_id", F.lit(":"), "label", F.lit("["), F.coalesce(listed, F.lit("")), F.lit("]")).alias("text")).alias("n"))
    line = F.concat("src", F.lit("-"), "dst", F.lit("(relation="), "relation", F.lit(",weight="), weight_text(F.col("weight")), F.lit(")"))
    edge = edges.select("graph_id", F.struct("src", "dst", "relation", line.alias("text")).alias("e"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "; ")
    both = node.groupBy("graph_id").agg(join("n").alias("n")).join(edge.groupBy("graph_id").agg(join("e").alias("e")), "graph_id", "left")
    return both.select("graph_id", F.concat(F.lit("Nodes: "), "n", F.lit(". Edges: "), F.coalesce("e", F.lit("")), F.lit(".")).alias("text"))


def fingerprint(nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """(graph_id, fingerprint): SHA-256 of the sorted nodes and edges; the graph's own id is left out, labels count.

    Edges are undirected: their ends are put in order, so a reversed edge gives the same fingerprint.
    """
    pairs = F.array_join(F.transform("attributes", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["text"], F.lit("null")))), ",")
    node = nodes.select("graph_id", "node_id", "label").join(node_attributes(attrs), ["graph_id", "node_id"], "left")
    node = node.select("graph_id", F.concat_ws("|", "node_id", "label", F.coalesce(pairs, F.lit(""))).alias("n"))
    edge = edges.select("graph_id", F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst"), "relation", weight_text(F.col("weight"))).alias("e"))
    both = node.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("n")), ";").alias("n")).join(edge.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("e")), ";").alias("e")), "graph_id", "left")
    return both.select("graph_id", F.sha2(F.concat("n", F.lit("//"), F.coalesce("e", F.lit(""))), 256).alias("fingerprint"))


def questions(asked: DataFrame, nodes: DataFrame, attrs: DataFrame, withheld: tuple[str, ...] = ("status",), exempt: bool = False) -> DataFrame:
    """asked with ``question``: its wording, with labels for ids, after a line about its nodes.

    withheld names are kept from that line, and so is the attribute that a question about facts asks for.
    """
    label = nodes.select("graph_id", "node_id", "label")
    held = F.array(*map(F.lit, withheld))
    about = F.when(F.col("kind").isin("attribute_lookup", "attribute_check", "most_common_attribute_within_hops") & F.col("attribute").isNotNull(), F.array_append(held, F.col("attribute"))).otherwise(held)
    known = label.join(node_attributes(attrs), ["graph_id", "node_id"], "left")
    q = asked.join(known.toDF("graph_id", "source", "_sl", "_sa"), ["graph_id", "source"], "left").join(known.toDF("graph_id", "target", "_tl", "_ta"), ["graph_id", "target"], "left")
    none = F.array().cast("array<struct<name:string,text:string>>")
    text = tx.question(F.col("kind"), F.coalesce("_sl", "source"), F.coalesce("_tl", "target"), F.col("attribute"), F.col("value"), F.col("hops"), exempt)
    facts = [F.when(F.col(f"_{e}l").isNotNull(), tx.facts(F.col(f"_{e}l"), F.coalesce(f"_{e}a", none), about)) for e in "st"]
    return q.select(*asked.columns, tx.with_facts(text, *facts).alias("question"))


def prompt(condition: Column, initial: Column, current: Column, history: Column, question: Column) -> Column:
    """The prompt of a condition: the graph in words, or the history of updates, or neither, before the question."""
    line = lambda *parts: F.concat_ws("\n", *parts)
    return (
        F.when(condition == "serialized_initial_history", line(F.concat(F.lit("Initial graph: "), initial), history, question))
        .when(condition == "serialized_current_graph", line(F.concat(F.lit("Current graph: "), current), question))
        .when(condition == "modify_and_print", line(F.concat(F.lit("Current graph: "), current), history, question))
        .when(condition == "token_matched_history", line(tx.token_budget(history, 64), question))
        .when(condition.isin("frozen_graph_history", "graph_once_then_text", "soft_prompt"), line(history, question))
        .otherwise(question)
    )
