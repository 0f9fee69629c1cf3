"""Lengths of prompts against prompts that are written out."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.operators import graph_text, prompts
from turnwise.operators import sessions as ses
from turnwise.sources.trade import Graphs


def test_sizes_equal_prompts_written_out(spark):
    nodes = spark.createDataFrame([("g", f"n{i}", f"Stop {i}", i != 2) for i in range(4)], "graph_id string, node_id string, label string, is_open boolean")
    attrs = nodes.select("graph_id", "node_id", F.lit("line").alias("name"), F.lit("s:x").alias("token"), F.lit("old x").alias("text"))
    edges = spark.createDataFrame([("g", "n0", "n1", "track", 3.0), ("g", "n0", "n1", "side way", 1.5)], "graph_id string, src string, dst string, relation string, weight double")
    edits = [("NOOP", "n0", None, None), ("DEL", "n0", "n0", "n1"), ("ADD", "n0", "n2", "n3"), ("SET_CLOSED", "n1", None, None), ("ADD", "n0", "n2", "n3"), ("DEL", "n0", "n2", "n3"), ("ADD", "n0", "n0", "n1")] + [("NOOP", "n0", None, None)] * 12
    rows = [(s, i, "g", op, a, hi, i, lo, hi, "side way" if lo else None) for s in (1, 2) for i, (op, a, lo, hi) in enumerate(edits[s - 1 :])]
    turns = spark.createDataFrame(rows, "session_id long, turn_index long, graph_id string, op string, a string, b string, event_id long, lo string, hi string, relation string")
    said = turns.withColumn("utterance", F.when(F.col("turn_index") % 5 == 4, F.lit(None)).otherwise(F.repeat(F.lit(" a\tnew  word\n"), F.col("turn_index").cast("int"))))
    q = turns.select("session_id", "turn_index", F.concat(F.lit("Is\nit "), F.col("op"), F.lit("?")).alias("question"))
    g = Graphs(nodes, edges, attrs)
    names = tuple(ses.CONDITIONS)
    got = {tuple(r)[:3]: r.input_tokens for r in prompts.input_sizes(turns, said, q, g).collect()}
    assert len(got) == len(rows) * len(names)

    now = ses.states(turns, g)
    each = turns.select(ses.state_id(F.col("session_id"), F.col("turn_index")).alias("graph_id"), F.col("graph_id").alias("base"))
    own = each.join(attrs.withColumnRenamed("graph_id", "base"), "base").drop("base")
    current = graph_text.serialize_graph(now.nodes, now.edges, own).withColumnRenamed("text", "current")
    first = graph_text.serialize_graph(nodes, edges, attrs).select("graph_id", F.col("text").alias("initial"))
    lines = tx.history(said.unionByName(said.groupBy("session_id").agg(F.max("turn_index").alias("m")).join(said, "session_id").where("turn_index = m").withColumn("turn_index", F.col("m") + 1).select(*said.columns)), "session_id", "turn_index", "utterance")
    lines = lines.select("session_id", (F.col("turn_index") - 1).alias("turn_index"), "history")
    full = turns.join(first, "graph_id").join(lines, ["session_id", "turn_index"]).join(q, ["session_id", "turn_index"]).withColumn("graph_id", ses.state_id(F.col("session_id"), F.col("turn_index"))).join(current, "graph_id")
    full = full.withColumn("condition", F.explode(F.array(*map(F.lit, names))))
    text = graph_text.prompt(F.col("condition"), F.col("initial"), F.col("current"), F.col("history"), F.col("question"))
    want = {tuple(r)[:3]: len(r.text.split()) for r in full.select("session_id", "turn_index", "condition", text.alias("text")).collect()}
    assert got == want
    assert any("Edges: ." in r.current for r in current.collect())


def test_names_of_conditions():
    assert prompts.conditions(["majority_prior", "tool_solver", "stale_answer", "cached_no_reencode"]) == ["stale_answer", "tool_solver", "frozen_graph_history"]
    with pytest.raises(ValueError, match="nonesuch"):
        prompts.conditions(["tool_solver", "nonesuch"])
