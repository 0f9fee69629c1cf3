"""Programs applied edit by edit: hand cases, strict mode, and the states that the window finds."""

import pytest
from pyspark.sql import functions as F

from turnwise.operators.apply import apply_programs
from turnwise.plans import catalog

EDITS = [
    ("ADD", "NODE", "d", None, None, None, None, "Dun", None, True, None), ("ADD", "NODE", "d", None, None, None, None, None, None, False, "node_exists"), ("ADD", "EDGE", "d", "a", None, None, None, None, "track", True, None),
    ("ADD", "EDGE", "a", "d", None, None, None, None, "track", False, "edge_exists"), ("ADD", "EDGE", "a", "d", None, None, None, None, "walk", True, None), ("SET", "NODE", "a", None, "status", "s:open", "open", None, None, False, "no_state_change"),
    ("SET", "NODE", "a", None, "status", "s:closed", "closed", None, None, True, None), ("SET", "NODE", "z", None, "status", "s:open", "open", None, None, False, "unknown_node"), ("SET", "NODE", "b", None, "size", None, None, None, None, False, "no_state_change"),
    ("DEL", "NODE", "b", None, None, None, None, None, None, True, None), ("DEL", "EDGE", "a", "b", None, None, None, None, "track", False, "unknown_end"), ("DEL", "EDGE", "d", "a", None, None, None, None, "track", True, None),
    ("DEL", "EDGE", "d", "a", None, None, None, None, "track", False, "unknown_edge"), ("ADD", "EDGE", "a", "a", None, None, None, None, "track", False, "self_loop"), ("NOOP", None, None, None, None, None, None, None, None, False, None),
]


@pytest.fixture(scope="module")
def parts(spark):
    nodes = spark.createDataFrame([("g", x, x.upper()) for x in "abc"], "graph_id string, node_id string, label string")
    edges = spark.createDataFrame([("g", "a", "b", "track", 2.0), ("g", "b", "c", "track", 1.0)], "graph_id string, src string, dst string, relation string, weight double")
    attrs = spark.createDataFrame([("g", "a", "status", "s:open", "open"), ("g", "b", "status", "s:open", "open")], "graph_id string, node_id string, name string, token string, text string")
    names = "graph_id string, pos long, operation string, target string, first string, second string, attribute string, token string, value string, label string, relation string"
    return nodes, edges, attrs, spark.createDataFrame([("g", i, *e[:9]) for i, e in enumerate(EDITS)], names)


def test_edits_in_order(parts):
    out = apply_programs(*parts).collect()
    assert [(r.applied, r.error) for r in sorted((r for r in out if r.what == "effect"), key=lambda r: r.pos)] == [e[9:] for e in EDITS]
    assert {(r.node_id, r.label) for r in out if r.what == "node"} == {("a", "A"), ("c", "C"), ("d", "Dun")}
    assert {(r.src, r.dst, r.relation, r.weight) for r in out if r.what == "edge"} == {("a", "d", "walk", 1.0)}
    assert {(r.node_id, r.name, r.text) for r in out if r.what == "attribute"} == {("a", "status", "closed")}


def test_strict_mode_raises_at_the_first_edit_that_fails(parts):
    nodes, edges, attrs, edits = parts
    assert apply_programs(nodes, edges, attrs, edits.where("pos in (0, 5, 6)"), strict=True).where("what = 'effect'").count() == 3
    with pytest.raises(Exception, match="node_exists"):
        apply_programs(nodes, edges, attrs, edits, strict=True).collect()


def test_fold_equals_the_window(spark):
    d = "/root/testdata/sf0.001"
    s = catalog.Sessions(spark, d)
    last = s.turns.groupBy("session_id").agg(F.max("turn_index").alias("t")).select(F.concat_ws(":", "session_id", "t").alias("graph_id"))
    want = {(r.graph_id.split(":")[0], *sorted((r.src, r.dst)), r.relation, r.weight) for r in s.after.edges.join(last, "graph_id", "left_semi").collect()}
    got = {(r.graph_id, *sorted((r.src, r.dst)), r.relation, r.weight) for r in catalog.applied_programs(s).where("what = 'edge'").collect()}
    assert got == want
