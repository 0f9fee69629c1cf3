"""How long the prompt of every turn and condition is, without writing one: words add up along a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.trade import Graphs
from . import graph_text
from . import sessions as ses

#: Earlier names of conditions.
EARLIER_NAMES = {"majority_prior": "stale_answer", "cached_no_reencode": "frozen_graph_history"}
#: Words of history that the condition with a budget keeps.
BUDGET = 64


def conditions(names: list[str]) -> list[str]:
    """Conditions by their present names, each once, in the order given; a name that is none raises."""
    out = list(dict.fromkeys(EARLIER_NAMES.get(n, n) for n in names))
    if unknown := sorted(set(out) - set(ses.CONDITIONS)):
        raise ValueError(f"no such conditions: {unknown}")
    return out


def _edge_words(src: Column, dst: Column, relation: Column) -> Column:
    """Words of an edge in a graph's text; a weight adds none to the word it stands in."""
    return F.coalesce(tx.n_words(F.concat(src, F.lit("-"), dst, F.lit("(relation="), relation, F.lit(",weight=1)"))), F.lit(0)).cast("long")


def graph_words(g: Graphs) -> DataFrame:
    """(graph_id, n_words, n_edges) of each graph's nodes and edges in words, without the words about them."""
    listed = F.array_join(F.transform("attributes", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["text"], F.lit("None")))), ", ")
    node = g.nodes.select("graph_id", "node_id", "label").join(graph_text.node_attributes(g.attrs), ["graph_id", "node_id"], "left")
    piece = F.concat("node_id", F.lit(":"), "label", F.lit("["), F.coalesce(listed, F.lit("")), F.lit("]"))
    n = node.groupBy("graph_id").agg(F.sum(tx.n_words(piece)).cast("long").alias("_n"))
    e = g.edges.groupBy("graph_id").agg(F.sum(_edge_words(F.col("src"), F.col("dst"), F.col("relation"))).alias("_e"), F.count(F.lit(1)).alias("n_edges"))
    zero = F.lit(0).cast("long")
    return n.join(e, "graph_id", "left").select("graph_id", (F.col("_n") + F.coalesce("_e", zero)).alias("n_words"), F.coalesce("n_edges", zero).alias("n_edges"))


def input_sizes(turns: DataFrame, said: DataFrame, questions: DataFrame, g: Graphs, names: tuple[str, ...] = tuple(ses.CONDITIONS)) -> DataFrame:
    """(session_id, turn_index, condition, input_tokens): words of the prompt that graph_text.prompt would make of each turn.

    said has the turns with their utterance, questions (session_id, turn_index, question). A history
    holds the updates up to its own turn. Its words are a running sum of its lines', and those of
    the current graph are the first graph's and a running sum over the edges that came and went: a
    status is one word, whichever it is. So the work is linear in turns, where histories and graphs
    written out are not. Null texts have no words.
    """
    turn = ["session_id", "turn_index"]
    ends = g.edges.groupBy("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    start = ends.agg(F.sum(_edge_words(F.col("src"), F.col("dst"), F.col("relation"))).alias("_w"), F.count(F.lit(1)).alias("_k"))
    # An applied operation brings or takes what the pair had at the start, or the one edge that the session adds.
    moved = ses.intervals(turns, g).where("key like 'e:%'").join(start, ["graph_id", "lo", "hi"], "left")
    one = F.lit(1).cast("long")
    sign = F.when(F.col("on"), 1).otherwise(-1)
    moved = moved.select("session_id", F.col("from_turn").alias("turn_index"), (sign * F.coalesce("_w", _edge_words(F.col("lo"), F.col("hi"), F.col("relation")))).alias("_dw"), (sign * F.coalesce("_k", one)).alias("_de"))
    moved = moved.groupBy(*turn).agg(F.sum("_dw").alias("_dw"), F.sum("_de").alias("_de"))
    run = Window.partitionBy("session_id").orderBy("turn_index")
    zero = F.lit(0).cast("long")
    words = lambda c: F.coalesce(tx.n_words(F.col(c)), F.lit(0)).cast("long")
    t = said.select("session_id", "turn_index", "graph_id", words("utterance").alias("_u")).join(moved, turn, "left")
    t = t.select(*turn, "graph_id", F.sum(F.col("_u") + 2).over(run).alias("history"), F.sum(F.coalesce("_dw", zero)).over(run).alias("_dw"), F.sum(F.coalesce("_de", zero)).over(run).alias("_de"))
    t = t.join(graph_words(g), "graph_id", "left").join(questions.select(*turn, words("question").alias("asked")), turn, "left")
    # "Initial graph:" and "Current graph:", "Nodes:" and "Edges:", and a full stop by itself where there is no edge.
    told = lambda n, e: F.coalesce(n, zero) + 4 + F.when(F.coalesce(e, zero) == 0, 1).otherwise(0)
    t = t.withColumn("first", told(F.col("n_words"), F.col("n_edges"))).withColumn("now", told(F.col("n_words") + F.col("_dw"), F.col("n_edges") + F.col("_de")))
    c, asked = F.col("condition"), F.coalesce("asked", zero)
    size = (
        F.when(c == "serialized_initial_history", F.col("first") + F.col("history"))
        .when(c == "serialized_current_graph", F.col("now"))
        .when(c == "modify_and_print", F.col("now") + F.col("history"))
        .when(c == "token_matched_history", F.least("history", F.lit(BUDGET)))
        .when(c.isin("frozen_graph_history", "graph_once_then_text", "soft_prompt"), F.col("history"))
        .otherwise(0)
    )
    t = t.withColumn("condition", F.explode(F.array(*map(F.lit, conditions(list(names))))))
    return t.select(*turn, "condition", (size + asked).cast("long").alias("input_tokens"))
