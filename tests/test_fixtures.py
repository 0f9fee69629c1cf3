"""Hand fixtures: answers, edits, graphs, records, late edits."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.functions.tokens import literal, literal_token
from turnwise.operators import corpus, graph_text, metrics, paths, solve
from turnwise.operators.adjacency import hop_map
from turnwise.sources import records
from turnwise.streaming import session_state

ANSWERS = [
    ("No, there are 2 routes.", "no"), ("Yes, 3 stations are open", "yes"), ("False, because 7 hops", "no"), ("True", "yes"), ("3", "3"), ("3 stations", "3"), ("It is 4", "4"), ("The answer is no", "no"),
    ("no path", "unreachable"), ("No path exists between them", "unreachable"), ("unreachable", "unreachable"), ("4.0", "4.0"), ("-2", "-2"), ("modern", "modern"), ("blue\nExplanation: within 1 hops", "blue"),
    ("\n4\n## Chapter 4", "4"), ("no.\nThe path n0-n3 has 2 hops", "no"), (None, None), ("Yes.", "yes"), ("Yes, but one node is unreachable", "yes"), ("not reachable", "unreachable"), ("it is surely true", "yes"), ("", ""), ("version 3.5.1 it is", "version 3.5.1 it is"),
]


def test_answers_are_read_from_replies(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string")
    got = {r.i: r.n for r in df.select("i", tx.normalize_answer(F.col("a")).alias("n")).collect()}
    assert [got[i] for i in range(len(ANSWERS))] == [b for _, b in ANSWERS]


MATCHES = [
    ("path_cost", "12.0", "12", True), ("path_cost", "12.5", "12.49", True), ("path_cost", "12.5", "14", False), ("reachability", "2", "2.4", False), ("within_hops_list", "A, B", "B,A", True), ("within_hops_list", "none", "none", True),
    ("node_degree", "3", "3.0", True), ("within_hops_count", "2", "two", False), ("reachability", "yes", "Yes.", True), ("reachability", None, None, True), ("reachability", "yes", None, False), ("attribute_lookup", "red", "blue", False),
]


def test_answers_match_by_kind(spark):
    df = spark.createDataFrame([(i, *m[:3]) for i, m in enumerate(MATCHES)], "i int, kind string, a string, b string")
    got = {r.i: r.m for r in df.select("i", tx.answers_match(F.col("kind"), F.col("a"), F.col("b")).alias("m")).collect()}
    assert [got[i] for i in range(len(MATCHES))] == [m[3] for m in MATCHES]
    assert spark.range(1).select(tx.set_f1(F.lit("Belmont, Crount, Ashford"), F.lit("Belmont")).alias("x")).first().x == 0.5


def test_literals(spark):
    cases = [("open", "s:open", "open"), ("TRUE", "n:1", "True"), ("false", "n:0", "False"), ("null", None, "None"), ("3", "n:3", "3"), ("3.0", "n:3", "3.0"), ("2.5", "n:2.5", "2.5"), ('"x y"', "s:x y", "x y"), ("art deco", "s:art deco", "art deco"), ("[1]", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = {r.i: r.v for r in df.select("i", literal(F.col("x")).alias("v")).collect()}
    assert [(got[i].token, got[i].text) for i in range(len(cases))] == [c[1:] for c in cases] and got[9].error == "container"
    assert literal_token(True) == literal_token(1.0) == "n:1"


def test_programs_with_names(spark):
    program = "SET NODE Vale Hill status closed ; DEL EDGE Quill Cross Vale Hill transfer ; ADD EDGE Elm Vale Hill transfer ; ADD NODE n9 New Stop ; DEL EDGE Nowhere Elm ; SET NODE Elm status ; FLY ; SET EDGE a b ; NOOP all well ; END"
    names = F.create_map(*[F.lit(x) for kv in {"vale hill": "n3", "quill cross": "n7", "elm": "n1"}.items() for x in kv])
    df = spark.createDataFrame([(program,)], "p string").select(F.posexplode(tx.program_edits(F.col("p"))).alias("i", "e"))
    got = [tuple(r.x) for r in df.select("i", tx.parse_edit(F.col("e"), names).alias("x")).orderBy("i").collect()]
    assert got == [
        ("SET", "NODE", "n3", None, "status", "closed", None, None, None, None), ("DEL", "EDGE", "n7", "n3", None, None, None, "transfer", None, None), ("ADD", "EDGE", "n1", "n3", None, None, None, "transfer", None, None),
        ("ADD", "NODE", "n9", None, None, None, "New Stop", None, None, None), ("DEL", "EDGE", "Nowhere", "n1", None, None, None, "connected", None, None), (*[None] * 9, "value_missing"), (*[None] * 9, "unknown_operation"), (*[None] * 9, "set_edge"),
        ("NOOP", None, None, None, None, None, None, None, "all well", None),
    ]
    said = spark.createDataFrame([("SET NODE a status open ; End Revision: more END",), ("DEL EDGE a b\nmore",), ("SET NODE Bend status open",)], "p string")
    assert [r.x for r in said.select(tx.generated_program(F.col("p")).alias("x")).collect()] == ["SET NODE a status open ; ", "DEL EDGE a b", "SET NODE Bend status open"]


@pytest.fixture(scope="module")
def path_graph(spark):
    nodes = spark.createDataFrame([("g", "a", "Ashford", True), ("g", "b", "Belmont", True), ("g", "c", "Crount", True)], "graph_id string, node_id string, label string, is_open boolean")
    edges = spark.createDataFrame([("g", "a", "b", "track", 1.0), ("g", "b", "c", "track", 1.0)], "graph_id string, src string, dst string, relation string, weight double")
    attrs = spark.createDataFrame([("g", n, "accessible", t, x) for n, t, x in (("a", "n:1", "True"), ("b", "n:0", "False"), ("c", "n:1", "True"))], "graph_id string, node_id string, name string, token string, text string")
    return nodes, edges, attrs


def test_questions_on_a_path(spark, path_graph):
    asked = [
        ("shortest_path", "a", "c", None, None, None, "3"), ("node_degree", "b", None, None, None, None, "2"), ("node_degree", "a", None, None, None, None, "1"), ("constrained_reachability", "a", "c", "accessible", "n:0", None, "no"),
        ("constrained_reachability", "a", "c", "accessible", "n:1", None, "yes"), ("reachability", "a", "c", None, None, None, "yes"), ("within_hops_count", "a", None, None, None, 0, "2"), ("within_hops_count", "a", None, "accessible", "n:1", 2, "1"),
        ("within_hops_list", "a", None, None, None, 2, "Belmont, Crount"), ("within_hops_list", "a", None, "accessible", "n:1", None, "Crount"), ("within_hops_list", "a", None, None, None, 1, "Belmont"), ("most_common_attribute_within_hops", "a", None, "accessible", None, 2, "True"),
        ("reachability", "a", None, None, None, None, "invalid"), ("path_cost", "z", "a", None, None, None, "invalid"), ("attribute_check", "b", None, "accessible", "n:0", None, "yes"), ("attribute_lookup", "b", None, "height", None, None, "none"), ("attribute_lookup", "b", None, None, None, None, "invalid"),
        ("cycle_membership", "b", None, None, None, None, "no"), ("edge_exists", "a", "c", None, None, None, "no"), ("link_prediction", "b", "c", None, None, None, "yes"), ("node_count", "a", None, None, None, None, "3"), ("filtered_neighbor_count", "b", None, "accessible", "n:1", None, "2"), ("filtered_path_count", "a", "c", "accessible", "n:1", None, "2"), ("path_cost", "a", "c", None, None, None, "2"),
    ]
    q = spark.createDataFrame([(str(i), k, "g", s, t, a, v, h) for i, (k, s, t, a, v, h, _) in enumerate(asked)], "query_id string, kind string, graph_id string, source string, target string, attribute string, token string, hops int")
    got = {r.query_id: r.answer for r in solve.answer_queries(q, *path_graph).collect()}
    assert [got[str(i)] for i in range(len(asked))] == [x[-1] for x in asked]
    nodes, edges, attrs = path_graph
    shut = nodes.withColumn("is_open", F.col("node_id") != "b")
    one = spark.createDataFrame([("g", "a", "c")], "graph_id string, source string, target string")
    assert paths.shortest_path(one, shut, edges).first().answer == "unreachable" and hop_map(one.select("graph_id", "source"), edges, 2, shut).count() == 0


def test_cycles_and_long_chains(spark):
    shapes = {"s": ["s-a", "s-b", "s-c", "b-c"], "t": ["a-b", "b-c", "c-d", "d-e", "e-c", "c-f"], "u": [f"{i:04d}-{i + 1:04d}" for i in range(600)]}
    edges = spark.createDataFrame([(g, *e.split("-"), "track", 1.0) for g, es in shapes.items() for e in es], "graph_id string, src string, dst string, relation string, weight double")
    nodes = edges.selectExpr("graph_id", "explode(array(src, dst)) as node_id").distinct().withColumn("is_open", F.lit(True))
    on = {(r.graph_id, r.source) for r in paths.cycle_membership(nodes.selectExpr("graph_id", "node_id as source"), nodes, edges).where("answer = 'yes'").collect()}
    assert on == {("s", "s"), ("s", "b"), ("s", "c"), ("t", "c"), ("t", "d"), ("t", "e")}
    assert paths.bridges(nodes, edges).where("graph_id = 'u'").count() == 600
    ends = spark.createDataFrame([("u", "0000", "0600"), ("u", "0000", "zz")], "graph_id string, source string, target string")
    assert {r.target: r.answer for r in paths.reachability(ends, nodes, edges).collect()} == {"0600": "yes", "zz": "no"}


def test_fingerprints_ignore_order_and_ids(spark, path_graph):
    nodes, edges, attrs = path_graph
    other = [t.withColumn("graph_id", F.lit("h")) for t in (nodes.orderBy(F.desc("node_id")), edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight"), attrs)]
    one = graph_text.fingerprint(*path_graph).first().fingerprint
    assert graph_text.fingerprint(*other).first().fingerprint == one
    assert graph_text.fingerprint(nodes, edges.withColumn("weight", F.lit(2.5)), attrs).first().fingerprint != one
    text = graph_text.serialize_graph(nodes, edges.withColumn("weight", F.lit(2.5)), attrs).first().text
    assert text == "Nodes: a:Ashford[accessible=True]; b:Belmont[accessible=False]; c:Crount[accessible=True]. Edges: a-b(relation=track,weight=2.5); b-c(relation=track,weight=2.5)."


def test_records_read_back_with_defaults(spark, tmp_path):
    session = {"session_id": "s1", "initial_graph": {"graph_id": "g", "nodes": [{"id": "a", "attributes": {"open": False, "n": 3}}, {"id": "b", "label": "Bee"}], "edges": [{"source": "a", "target": "b"}]}, "turns": [{"turn_index": 0, "gold_edit": {"operation": "NOOP"}}, {"turn_index": 1, "gold_edit": {"operation": "NOOP"}, "gold_edits": [{"operation": "SET"}, {"operation": "ADD"}]}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(session) + "\n\n" + json.dumps({"session_id": "s2"}) + "\n")
    rows = {r.session_id: r for r in records.read_sessions(spark, str(tmp_path / "s.jsonl")).collect()}
    g = rows["s1"].initial_graph
    assert (g.nodes[0].label, g.nodes[1].label, g.edges[0].relation, g.edges[0].weight, g.directed) == ("a", "Bee", "connected", 1.0, False)
    assert [[e.operation for e in t.gold_edits] for t in rows["s1"].turns] == [["NOOP"], ["SET", "ADD"]] and "s2" in rows
    graphs = records.read_sessions(spark, str(tmp_path / "s.jsonl")).where("session_id = 's1'").select(F.col("initial_graph").alias("graph"))
    assert {r.node_id: r.is_open for r in records.graph_nodes(graphs).collect()} == {"a": False, "b": True} and records.graph_edges(graphs).count() == 1
    df = spark.createDataFrame([(2, "x", None), (1, "y", 3.5)], "b int, a string, c double")
    records.write_lines(df, str(tmp_path / "out"))
    back = records.read_lines(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    then = records.manifest(spark, str(tmp_path / "s.jsonl"))
    assert then.count() == 1 and records.manifest_changes(then, then).count() == 0 and records.manifest_changes(then, then.where("false")).first().change == "added"


def test_statistics_of_extreme_rows(spark):
    rows = spark.createDataFrame([("x", s, t, "k", True, False) for s in range(4) for t in range(3)] + [("y", s, t, "k", True, False) for s in range(4) for t in range(3)], "condition string, session_id long, turn_index long, kind string, correct boolean, stale boolean")
    r = metrics.paired_bootstrap(rows, "x", "y", 200).first()
    assert (r.n, r.mean_delta, r.low, r.high, r.p_value, r.ties) == (12, 0.0, 0.0, 0.0, 1.0, 12)
    none = metrics.paired_bootstrap(rows.where("false"), "x", "y", 200).first()
    assert (none.n, none.p_value) == (0, 1.0)
    mixed = rows.withColumn("correct", F.col("session_id") % 2 == 0)
    ci, wide = metrics.bootstrap(mixed, 400).where("condition = 'x'").first(), metrics.rates(mixed, ["condition"]).where("condition = 'x'").first()
    assert ci.low < ci.accuracy < ci.high and ci.high - ci.low > wide.wilson_high - wide.wilson_low


def test_samples(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as k", "id % 7 as v")
    assert [r.id for r in corpus.stride_sample(df, ["id"], 10, 4).orderBy("id").collect()] == [0, 10, 20, 30]
    assert corpus.capped(df, ["k"], ["id"], 5).groupBy("k").count().where("count <> 5").count() == 0
    assert {r.id for r in corpus.first_wins(df, ["k"], "id").collect()} == {0, 1, 2} and {r.id for r in corpus.last_wins(df, ["k"], "id").collect()} == {97, 98, 99}


def test_late_and_repeated_edits_are_dropped(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    rows = [(1, 0, "SET_CLOSED", "n1", None, None, at(0)), (1, 0, "SET_CLOSED", "n1", None, None, at(1)), (1, 1, "SET_OPEN", "n1", None, None, at(2))]
    schema = "session_id long, turn_index long, op string, a string, lo string, hi string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session_state.late_edits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "10 minutes")
    q = stream.writeStream.format("memory").queryName("late_edits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late_edits").count() == 2
