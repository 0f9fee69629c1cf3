"""Editing sessions: what each turn did, the graph as of every turn, and its question on five graphs.

SET, ADD and DEL are idempotent, so a key's state is its last operation, or the initial state. An
operation that asks for what already holds is not applied; the others alternate, and each holds from
its turn to the next one's: an interval. A window over a key's own operations gives the intervals,
and spelling them out gives the graph as of every turn, in work that is linear in what comes out.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tok
from ..shared import numbered, settle
from ..sources.trade import Graphs
from . import replay, solve

#: The families of wording, by session_id modulo three.
FAMILIES = ("direct", "service", "notice")


def resolved(turns: DataFrame, g: Graphs) -> DataFrame:
    """Turns with the pair (lo, hi) that an ADD or DEL touches and its relation: ADD its own ends, DEL one of the graph's initial edges."""
    order = Window.partitionBy("graph_id").orderBy("src", "dst")
    # Graphs are small and bounded in size; a window holds one graph's edges.
    nth = g.edges.select("graph_id", "src", "dst", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))
    n = nth.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    t = turns.join(n, "graph_id", "left").withColumn("ordinal", F.when(F.col("op") == "DEL", F.col("event_id") % F.col("n_edges")))
    t = t.join(nth, ["graph_id", "ordinal"], "left")
    lo = F.when(F.col("op") == "ADD", F.least("a", "b")).when(F.col("op") == "DEL", F.least("src", "dst"))
    hi = F.when(F.col("op") == "ADD", F.greatest("a", "b")).when(F.col("op") == "DEL", F.greatest("src", "dst"))
    t = t.select("session_id", "turn_index", "graph_id", "op", "a", "b", "event_id", lo.alias("lo"), hi.alias("hi"))
    # What an edge between two nodes is called: track on one line, transfer between lines.
    line = g.attrs.where("name = 'line'").select("graph_id", "node_id", F.struct("text").alias("line"))
    both = t.join(line.toDF("graph_id", "lo", "_x"), ["graph_id", "lo"], "left").join(line.toDF("graph_id", "hi", "_y"), ["graph_id", "hi"], "left")
    named = F.when(F.col("_x.text") == F.col("_y.text"), "track").otherwise("transfer")
    return both.select(*t.columns, F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull() & (F.col("lo") < F.col("hi")), named).alias("relation"))


def touched_key(op: Column, a: Column, lo: Column, hi: Column) -> Column:
    """What an operation touches: n:node, e:lo-hi, or null."""
    return F.when(op.startswith("SET"), F.concat(F.lit("n:"), a)).when(op.isin("ADD", "DEL"), F.concat(F.lit("e:"), lo, F.lit("-"), hi))


def _started(turns: DataFrame, g: Graphs) -> DataFrame:
    """Every operation with its key, the state it asks for, and whether that key held at the start."""
    keyed = turns.withColumn("key", touched_key(F.col("op"), F.col("a"), F.col("lo"), F.col("hi"))).withColumn("goal", F.col("op").isin("SET_OPEN", "ADD"))
    start_node = g.nodes.select("graph_id", F.col("node_id").alias("a"), F.col("is_open").alias("_n"))
    start_edge = g.edges.select("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(True).alias("_e")).distinct()
    keyed = keyed.join(start_node, ["graph_id", "a"], "left").join(start_edge, ["graph_id", "lo", "hi"], "left")
    begin = F.when(F.col("op").startswith("SET"), F.col("_n")).otherwise(F.coalesce("_e", F.lit(False)))
    was = F.lag("goal").over(Window.partitionBy("session_id", "key").orderBy("turn_index"))
    return keyed.withColumn("begin", begin).withColumn("before", F.coalesce(was, "begin")).drop("_n", "_e")


def effects(turns: DataFrame, g: Graphs) -> DataFrame:
    """(session_id, turn_index, op, applied, error): what each edit did to the state before it."""
    out = _started(turns, g)
    applied = (F.col("op") != "NOOP") & (F.col("before") != F.col("goal"))
    error = F.when((F.col("op") == "NOOP") | applied, F.lit(None)).when(F.col("op").startswith("SET"), "no_state_change").when(F.col("op") == "ADD", "edge_exists").otherwise("edge_missing")
    return out.select("session_id", "turn_index", "op", F.coalesce(applied, F.lit(False)).alias("applied"), error.alias("error"))


def intervals(turns: DataFrame, g: Graphs) -> DataFrame:
    """(session_id, key, kind, a, lo, hi, graph_id, begin, on, from_turn, to_turn): each applied operation and the turns its state holds.

    to_turn is the turn of the key's next applied operation, null if it holds to the end.
    """
    moved = _started(turns, g).where("op <> 'NOOP' and before <> goal")
    order = Window.partitionBy("session_id", "key").orderBy("turn_index")
    first = F.row_number().over(order) == 1
    return moved.select("session_id", "graph_id", "key", "a", "lo", "hi", "relation", "begin", first.alias("first"), F.col("goal").alias("on"), F.col("turn_index").alias("from_turn"), F.lead("turn_index").over(order).alias("to_turn"))


def node_state(turns: DataFrame, g: Graphs) -> DataFrame:
    """(session_id, node_id, is_open, from_turn, to_turn) of every change of a node's status."""
    return intervals(turns, g).where("key like 'n:%'").select("session_id", F.col("a").alias("node_id"), F.col("on").alias("is_open"), "from_turn", "to_turn")


def edge_state(turns: DataFrame, g: Graphs) -> DataFrame:
    """(session_id, lo, hi, present, from_turn, to_turn) of every pair that was joined or parted."""
    return intervals(turns, g).where("key like 'e:%'").select("session_id", "lo", "hi", F.col("on").alias("present"), "from_turn", "to_turn")


@dataclass
class States:
    """Graphs as nodes and edges, as in Graphs, with graph_id naming the state; base is the initial graph."""

    nodes: DataFrame
    edges: DataFrame


def state_id(session: Column, turn: Column) -> Column:
    return F.concat_ws(":", session.cast("string"), turn.cast("string"))


def states(turns: DataFrame, g: Graphs, only: DataFrame | None = None) -> States:
    """The graph after each turn of each session, named ``{session}:{turn}``.

    An edge that a session adds has weight 1 and the relation of its pair; one that was there from
    the start keeps its weight while it holds. With only (session_id, turn_index, graph_id, state),
    the graphs after those turns alone, named state.
    """
    sid, turn = F.col("session_id"), F.col("turn_index")
    last = turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("_end"))
    # Turns at which a key differs from the initial graph, spelt out; and those at which an edge of it is one put back.
    spell = F.explode(F.sequence(F.col("from_turn"), F.coalesce("to_turn", F.col("_end")) - 1)).alias("turn_index")
    spelt = intervals(turns, g).where("on <> begin or (on and key like 'e:%')").join(last, "session_id").select("session_id", "key", "a", "lo", "hi", "relation", "on", (F.col("on") != F.col("begin")).alias("off"), spell)
    if only is None:
        each, spelt = turns.select(state_id(sid, turn).alias("state"), "graph_id"), spelt.withColumn("state", state_id(sid, turn))
    else:
        each, spelt = only.select("state", "graph_id"), spelt.join(only.select("session_id", "turn_index", "state"), ["session_id", "turn_index"])
    edge = spelt.where("key like 'e:%'")
    gone, renewed = edge.where("off and not on").select("state", "lo", "hi"), edge.where("not off").select("state", "lo", "hi", F.lit(True).alias("_new"))
    start = g.edges.select("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "relation", "weight")
    kept = each.join(start, "graph_id").join(gone, ["state", "lo", "hi"], "left_anti").join(renewed, ["state", "lo", "hi"], "left")
    kept = kept.select("state", "lo", "hi", "relation", F.when(F.col("_new"), F.lit(1.0)).otherwise(F.col("weight")).alias("weight"))
    new = edge.where("off and on").select("state", "lo", "hi", "relation", F.lit(1.0).alias("weight"))
    edges = kept.unionByName(new).select(F.col("state").alias("graph_id"), F.col("lo").alias("src"), F.col("hi").alias("dst"), "relation", "weight")
    flipped = spelt.where("off and key like 'n:%'").select("state", F.col("a").alias("node_id"), F.col("on").alias("_now"))
    node = each.join(g.nodes.select("graph_id", "node_id", "label", "is_open"), "graph_id").join(flipped, ["state", "node_id"], "left")
    nodes = node.select(F.col("state").alias("graph_id"), F.col("graph_id").alias("base"), "node_id", "label", F.coalesce("_now", "is_open").alias("is_open"))
    return States(nodes, edges)


def marks(turns: DataFrame, g: Graphs) -> DataFrame:
    """(session_id, turn_index, graph_id, state, before, shape): names of the graphs after and before each turn; what has one name is one graph.

    A state differs from its initial graph by a set of items: nodes with another status, edges that
    went, came with a relation, or were put back. Its name is the initial graph's with 128 bits of
    the items' hashes, joined by exclusive or: an item that comes or goes is one term, so running
    terms name all states of a session without spelling one out. The initial graph keeps its name.
    Equal graphs have one name too, but for an edge put back that weighed 1 from the start.
    shape is the same of the closed nodes and the joined pairs alone.
    """
    what = F.when(F.col("on") == F.col("begin"), "again").when(F.col("on"), F.concat_ws(":", F.lit("on"), "relation")).otherwise("off")
    differs = F.col("on") != F.col("begin")
    moved = intervals(turns, g).where("on <> begin or (on and key like 'e:%')")
    terms = {f"_s{i}": F.xxhash64(F.lit(i), "key", what) for i in range(2)} | {f"_k{i}": F.when(differs, F.xxhash64(F.lit(i), "key")).otherwise(F.lit(0)) for i in range(2)}
    moved = moved.select("session_id", F.explode(F.filter(F.array("from_turn", "to_turn"), lambda x: x.isNotNull())).alias("turn_index"), *[h.alias(n) for n, h in terms.items()])
    moved = moved.groupBy("session_id", "turn_index").agg(*[F.bit_xor(n).alias(n) for n in terms])
    order = Window.partitionBy("session_id").orderBy("turn_index")
    run = turns.select("session_id", "turn_index", "graph_id").join(moved, ["session_id", "turn_index"], "left")
    run = run.select("session_id", "turn_index", "graph_id", *[F.coalesce(F.bit_xor(n).over(order), F.lit(0)).alias(n) for n in terms])
    name = lambda x, y: F.when((F.col(x) == 0) & (F.col(y) == 0), F.col("graph_id")).otherwise(F.concat_ws("#", "graph_id", F.hex(x), F.hex(y)))
    named = run.select("session_id", "turn_index", "graph_id", name("_s0", "_s1").alias("state"), name("_k0", "_k1").alias("shape"))
    return named.select("session_id", "turn_index", "graph_id", "state", F.coalesce(F.lag("state").over(order), "graph_id").alias("before"), "shape")


def distinct_states(runs: list[tuple[DataFrame, DataFrame]], g: Graphs) -> States:
    """Every graph that the runs (turns and their marks) come to, each spelt out once, from the first turn that leads to it; the initial graphs of g among them."""
    every = functools.reduce(DataFrame.unionByName, [m.where("state <> graph_id").select("state", F.struct(F.lit(i).alias("run"), "session_id", "turn_index", "graph_id").alias("at")) for i, (_, m) in enumerate(runs)])
    first = settle(every.groupBy("state").agg(F.min("at").alias("at")).select("state", "at.*"), "first-turns")
    nodes, edges = g.nodes.select("graph_id", F.col("graph_id").alias("base"), "node_id", "label", "is_open"), g.edges.select("graph_id", "src", "dst", "relation", "weight")
    for i, (turns, _) in enumerate(runs):
        s = states(turns, g, first.where(F.col("run") == i))
        nodes, edges = nodes.unionByName(s.nodes), edges.unionByName(s.edges)
    return States(settle(nodes, "distinct-nodes"), settle(edges, "distinct-edges"))


def asked(turns: DataFrame) -> DataFrame:
    """Turns with their question: kind, source, target, attribute, value (as text), token, hops.

    All sixteen kinds come by turn; what they ask for comes from the event.
    """
    nth = ((F.col("session_id") + F.col("turn_index")) % 16 + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, solve.KINDS)), nth)
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % n + 1).cast("int"))
    hop_kind = F.col("kind").isin("within_hops_count", "within_hops_list")
    plain = hop_kind & (F.col("event_id") % 4 == 3)
    filtered = F.col("kind").isin("filtered_neighbor_count", "filtered_path_count", "attribute_check") | (hop_kind & ~plain)
    avoid, look = F.col("kind") == "constrained_reachability", F.col("kind").isin("most_common_attribute_within_hops", "attribute_lookup")
    t = turns.withColumn("kind", kind)
    attribute = F.when(filtered, pick(3, "has_rail", "status", "cleanliness")).when(avoid, pick(2, "has_rail", "status")).when(look, pick(3, "line", "status", "cleanliness"))
    value = F.when(filtered, pick(3, "True", "closed", "dirty")).when(avoid, pick(2, "False", "closed"))
    return t.select(
        *turns.columns, "kind", F.col("a").alias("source"), F.when(F.col("kind").isin(*solve.PAIRS), F.col("b")).alias("target"),
        attribute.alias("attribute"), value.alias("value"), tok.literal(value)["token"].alias("token"),
        F.when(F.col("kind").isin("within_hops_count", "within_hops_list", "most_common_attribute_within_hops"), F.col("event_id") % 4).alias("hops"),
    )


def utterances(turns: DataFrame, g: Graphs) -> DataFrame:
    """Turns with family and utterance: what a user says to ask for the edit, in one of three families of wording."""
    label = g.nodes.select("graph_id", "node_id", "label")
    t = turns.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("session_id") % 3 + 1).cast("int")))
    # A DEL names the stored ends, an ADD the ends as they were given.
    one, two = (F.when(F.col("op") == "DEL", F.col(p)).otherwise(F.col(e)) for p, e in (("lo", "a"), ("hi", "b")))
    t = t.withColumn("_x", one).withColumn("_y", two)
    t = t.join(label.toDF("graph_id", "_x", "x"), ["graph_id", "_x"], "left").join(label.toDF("graph_id", "_y", "y"), ["graph_id", "_y"], "left")
    return t.select(*turns.columns, "family", tx.utterance(F.col("op"), F.col("family"), F.col("x"), F.col("y"), F.col("relation"), F.col("event_id") % 3).alias("utterance"))


def edits(said: DataFrame, g: Graphs) -> DataFrame:
    """Turns with the edit that the wording alone suggests, in said_op, said_a, said_b, said_lo, said_hi and said_relation: NOOP where it suggests none.

    A closing or an opening word together with a node's label sets that node, the first in node
    order among several; else the utterance is read as an edit text, with labels for names. Each
    wording is read once a graph, however many turns have it.
    """
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("nk", "node_id", F.lower("label").alias("label")))), lambda x: F.struct(x.node_id.alias("node_id"), x.label.alias("label")))
    table = g.nodes.groupBy("graph_id").agg(in_order.alias("_nodes"))
    table = settle(table.withColumn("_names", F.map_from_entries(F.transform("_nodes", lambda x: F.struct(x.label, x.node_id)))), "names")
    low = F.lower(F.regexp_replace(tx.stripped(F.col("utterance")), r"\.+$", ""))
    status = F.when(low.rlike("closed|suspended"), "closed").when(low.rlike("open|reopened|resumed"), "open")
    hit = F.try_element_at(F.filter("_nodes", lambda x: F.contains(low, x.label)), F.lit(1))["node_id"]
    t = said.select("graph_id", "utterance").distinct().join(table, "graph_id").withColumn("_hit", F.when(status.isNotNull(), hit)).withColumn("_status", status)
    t = t.withColumn("_e", tx.parse_edit(F.regexp_replace(tx.stripped(F.col("utterance")), r"\.+$", ""), F.col("_names")))
    edge = F.col("_hit").isNull() & (F.col("_e.target") == "EDGE") & (F.col("_e.first") != F.col("_e.second"))
    op = F.when(F.col("_hit").isNotNull(), F.when(F.col("_status") == "closed", "SET_CLOSED").otherwise("SET_OPEN")).when(edge, F.col("_e.operation")).otherwise("NOOP")
    t = t.withColumn("_op", op).withColumn("_a", F.coalesce("_hit", F.when(edge, F.col("_e.first")))).withColumn("_b", F.when(edge, F.col("_e.second")))
    read = settle(t.select("graph_id", "utterance", "_op", "_a", "_b", F.when(edge, F.col("_e.relation")).alias("said_relation"), edge.alias("_edge")), "wordings")
    out = said.join(read.withColumnRenamed("graph_id", "_g").withColumnRenamed("utterance", "_u"), (F.col("graph_id") == F.col("_g")) & F.col("utterance").eqNullSafe(F.col("_u")))
    out = out.withColumn("said_a", F.coalesce("_a", "a")).withColumn("said_b", F.coalesce("_b", "b"))
    lo, hi = F.when(F.col("_edge"), F.least("said_a", "said_b")), F.when(F.col("_edge"), F.greatest("said_a", "said_b"))
    return out.select(*said.columns, F.col("_op").alias("said_op"), "said_a", "said_b", lo.alias("said_lo"), hi.alias("said_hi"), "said_relation")


def as_said(both: DataFrame) -> DataFrame:
    """Turns with the edit that edits() read from the wording in place of their own."""
    guess = {c[5:]: F.col(c) for c in both.columns if c.startswith("said_")}
    return both.select(*[guess[c].alias(c) if c in guess else F.col(c) for c in both.columns if not c.startswith("said_")])


def predicted_edits(said: DataFrame, g: Graphs) -> DataFrame:
    """Turns with the edit that the wording alone suggests, in op, a, b, lo, hi and relation."""
    return as_said(edits(said, g))


def session_ring(turns: DataFrame) -> DataFrame:
    """(session_id, graph_id, other): the initial graphs of each session and the next, in order of id; the last takes the first's."""
    ring = numbered(turns.select("session_id", "graph_id").distinct(), ["session_id"], "_no")
    n = ring.agg(F.count(F.lit(1)).alias("_n"))
    after = ring.crossJoin(n).select(F.pmod(F.col("_no") - 1, F.col("_n")).alias("_no"), F.col("graph_id").alias("other"))
    return ring.join(after, "_no").select("session_id", "graph_id", "other")


def played(both: DataFrame, g: Graphs) -> DataFrame:
    """(session_id, turn_index, graph_id, op, said_op, kind, gold, stale, initial, shuffled, predicted, edit_correct, state_exact): the turn's question on five graphs, and how the guessed edit and the state it leads to did.

    both is edits(). gold is the answer on the graph after the turn, stale on the one before it,
    initial on the session's first graph, shuffled on the next session's first graph, and predicted
    on the graph that the edits guessed have made. Sessions are replayed by the tasks that hold
    them, so graphs after turns are not written. An edit is correct if it equals the turn's field by
    field; no edit equals none, not even NOOP. A state is exact if the same nodes are closed and the
    same pairs joined as in the turn's own.
    """
    ends = F.when(F.col("op") == "DEL", F.concat_ws("-", "lo", "hi")).otherwise(F.concat_ws("-", "a", "b"))
    set_right = F.col("op").startswith("SET") & (F.col("a") == F.col("said_a"))
    edge_right = F.col("op").isin("ADD", "DEL") & (ends == F.concat_ws("-", "said_a", "said_b")) & F.col("relation").eqNullSafe(F.col("said_relation"))
    right = (F.col("op") == F.col("said_op")) & (set_right | edge_right)
    graphs = settle(replay.packed(g), "graphs")
    heads = session_ring(both).join(graphs.toDF("graph_id", "own"), "graph_id").join(graphs.toDF("other", "_far"), "other").select("session_id", "own", F.col("_far").alias("other"))
    q = asked(both).withColumn("edit_correct", F.coalesce(right, F.lit(False)))
    return replay.replayed(q, heads, ["session_id", "turn_index", "graph_id", "op", "said_op", "kind", "edit_correct"])


def answers(done: DataFrame) -> DataFrame:
    """(session_id, turn_index, graph_id, op, kind, gold, stale, initial, shuffled, predicted) of played()."""
    return done.select("session_id", "turn_index", "graph_id", "op", "kind", *replay.ROLES)


def majority_prior(answered: DataFrame) -> DataFrame:
    """(kind, prior): the commonest gold answer of each kind in the sessions to learn from, the smallest among equals."""
    n = answered.where(learns()).groupBy("kind", "gold").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("kind").agg(F.min_by("gold", F.struct(-F.col("n"), "gold")).alias("prior"))


def learns() -> Column:
    """Whether a session is one to learn priors from; the others are scored."""
    return F.col("session_id") % 2 == 0


#: The sixteen conditions, with the answer each gives.
CONDITIONS = {
    "question_only": None, "frozen_graph_history": "initial", "graph_once_then_text": "initial", "shuffled_graph": "shuffled", "oracle_updated_graph": "gold_state",
    "predicted_updated_graph": "predicted", "serialized_initial_history": "gold_state", "token_matched_history": "gold_state", "serialized_current_graph": "gold_state",
    "tool_solver": "gold_state", "soft_prompt": "gold_state", "soft_prompt_no_history": "gold_state", "structure_only": None, "modify_and_print": "gold_state",
    "stale_answer": "stale", "majority_answer": "prior",
}


def evaluation_rows(done: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, turn_index, condition, kind, gold, stale_answer, predicted, correct, stale, edit_correct, state_exact): a row for each scored turn and condition.

    done, from played(), holds what the solvers say on the graphs of each turn and how the predicted
    edit and state did; labels (session_id, turn_index, gold, stale) are stored apart, and answers
    are scored against them. stale marks every answer that matches the label before the edit.
    Conditions share answers, so each answer is normalised and matched once a turn, before the
    conditions are spelt out.
    """
    held = done.where(~learns()).select("session_id", "turn_index", "kind", F.col("gold").alias("gold_state"), "initial", "shuffled", "predicted", "edit_correct", "state_exact")
    both = labels.where(~learns()).select("session_id", "turn_index", F.col("gold").alias("label"), "stale").join(held, ["session_id", "turn_index"])
    both = both.join(majority_prior(done), "kind", "left")
    raw = sorted({v for v in CONDITIONS.values() if v})
    turn = ["session_id", "turn_index", "kind", "edit_correct", "state_exact"]
    both = both.select(*turn, tx.normalize_answer(F.col("label")).alias("gold"), *[tx.normalize_answer(F.col(c)).alias(c) for c in raw]).withColumn("nothing", F.lit(None).cast("string"))
    match = lambda a, b: tx.normalized_match(F.col("kind"), F.col(a), F.col(b))
    both = both.select("*", *[match("gold", c).alias(f"right_{c}") for c in (*raw, "nothing")], *[match("stale", c).alias(f"old_{c}") for c in (*raw, "nothing")])
    said = F.array(*[F.struct(F.lit(k).alias("condition"), F.col(v).alias("predicted"), F.col(f"right_{v}").alias("correct"), F.col(f"old_{v}").alias("old")) for k, v in ((k, v or "nothing") for k, v in CONDITIONS.items())])
    rows = both.select(*turn, "gold", F.col("stale").alias("stale_answer"), F.explode(said).alias("s"))
    from_edits = F.col("s.condition") == "predicted_updated_graph"
    return rows.select(
        "session_id", "turn_index", "s.condition", "kind", "gold", "stale_answer", "s.predicted", "s.correct", F.col("s.old").alias("stale"),
        F.when(from_edits, F.col("edit_correct")).alias("edit_correct"), F.when(from_edits, F.col("state_exact")).otherwise(True).alias("state_exact"),
    )


def writes(done: DataFrame) -> DataFrame:
    """(session_id, turn_index, op, said_op, edit_correct, state_exact) of played()."""
    return done.select("session_id", "turn_index", "op", "said_op", "edit_correct", "state_exact")
