"""JSON-lines records with typed values: scalars there and back, availability, from file to answers and scores."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from turnwise.functions import scalars
from turnwise.functions.tokens import literal_token
from turnwise.operators import solve, static_eval
from turnwise.sources import records

VALUES = [
    True, False, "true", "True", 1, 1.0, 0, -0.5, 2.5, None, "", "null", 'a"b\\c\n', "é", 1e20, 1e-7, 0.0001, 123456789.25, 1e15, 1e16, 12345678901234567890123, 9007199254740993, -(2**63), 2**63, 1e308, 0.1, 100.0, -1e-5,
]


def test_scalars_keep_their_type(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, j string")
    rows = df.select("i", scalars.scalar(F.parse_json("j")).alias("s")).select("i", "s.*").withColumn("back", scalars.scalar_json(F.col("token"), F.col("text"))).collect()
    got = {r.i: r for r in rows}
    for i, v in enumerate(VALUES):
        assert got[i].text == (None if v is None else str(v))
        back = json.loads(got[i].back)
        assert back == v and type(back) is type(v)
        for k, w in enumerate(VALUES):  # tokens are equal as values are
            assert (got[i].token == got[k].token) == (v == w), (v, w)
    assert got[0].token == got[4].token == got[5].token == literal_token(True)


def test_arrays_and_objects_are_kept_as_text(spark):
    df = spark.createDataFrame([("[1, 2]",), ('{"b":1}',)], "j string").select(scalars.scalar(F.parse_json("j")).alias("s")).select("s.*")
    assert sorted(map(tuple, df.collect())) == [("j:[1,2]", "[1,2]"), ('j:{"b":1}', '{"b":1}')]


def static(i, attributes, query, answer, directed=None, **more):
    graph = {"graph_id": "same", "nodes": [{"id": n, "attributes": a} for n, a in attributes.items()], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "c", "weight": 2.5, "relation": "r"}]}
    if directed is not None:
        graph["directed"] = directed
    return {"tuple_id": i, "split": "test", "graph": graph, "query": query, "answer": answer, **more}


@pytest.fixture
def rows(spark, tmp_path):
    def run(items):
        (tmp_path / "x.jsonl").write_text("\n\n".join(json.dumps(x) for x in items))
        return static_eval.evaluate(records.read_static(spark, str(tmp_path / "x.jsonl")))

    return run


def ask(kind, source="a", target=None, **more):
    return {"reasoning_type": kind, "source": source, "target": target, **more}


PLAIN = {"a": {}, "b": {}, "c": {}}


def test_from_file_to_scores(rows):
    code = {"a": {"k": 1}, "b": {"k": True}, "c": {"k": "1"}}
    items = [
        static("t1", code, ask("within_hops_count", attribute="k", value=1.0), "1"), static("t2", code, ask("within_hops_count", attribute="k", value="1"), "1"),
        static("t3", code, ask("attribute_check", "c", attribute="k", value=1), "no"), static("t4", code, ask("attribute_lookup", "b", attribute="k"), "True"), static("t5", code, ask("most_common_attribute_within_hops", attribute="k"), "1"),
        static("open1", PLAIN | {"b": {"open": "false"}}, ask("reachability", "a", "c"), "yes"), static("open2", PLAIN | {"b": {"open": False}}, ask("reachability", "a", "c"), "no"),
        static("open3", PLAIN | {"b": {"open": 0}}, ask("reachability", "a", "c"), "yes"), static("open4", PLAIN | {"b": {"status": None}}, ask("reachability", "a", "c"), "yes"), static("open5", PLAIN | {"b": {"status": "closed"}}, ask("reachability", "a", "c"), "no"),
        static("d1", PLAIN, ask("reachability", "c", "a"), "no", True), static("d2", PLAIN, ask("reachability", "c", "a"), "yes", False), static("d3", PLAIN, ask("path_cost", "a", "c"), "3.5", True), static("d4", PLAIN, ask("cycle_membership"), "no"),
        static("bad", PLAIN, ask("node_degree"), "7"), static("none", PLAIN, ask("no_such_kind"), "1"), static("x", PLAIN, ask("node_count", "zz"), "invalid"), static("m", PLAIN, ask("within_hops_list", hops=2), "c,b", metadata={"reasoning_type": "within_hops_list"}),
    ]
    got = {r.tuple_id: r for r in rows(items).collect()}
    assert len(got) == len(items)
    assert {k for k, r in got.items() if not r.correct} == {"bad", "none"}
    assert got["none"].predicted_answer is None and got["bad"].predicted_answer == "1" and got["d3"].predicted_answer == "3.5"


def test_report_has_scales_and_needs_every_task(rows, spark):
    items = [static(f"a{i}", PLAIN, ask("node_count"), "3", scale_bin="s") for i in range(9)] + [static(f"b{i}", PLAIN, ask("node_degree"), "1" if i else "2", scale_bin="l") for i in range(2)] + [static("c", PLAIN, ask("edge_exists", "a", "c"), "yes")]
    got = {(r.level, r.bucket): (r.n, round(r.accuracy, 3), r.passed) for r in static_eval.report(rows(items)).collect()}
    assert got == {("all", None): (12, 0.833, False), ("task", "node_count"): (9, 1.0, True), ("task", "node_degree"): (2, 0.5, True), ("task", "edge_exists"): (1, 0.0, False), ("scale", "s"): (9, 1.0, None), ("scale", "l"): (2, 0.5, None), ("scale", None): (1, 0.0, None)}
    none = static_eval.report(rows(items).where("false")).collect()
    assert [(r.level, r.n, r.accuracy, r.passed) for r in none] == [("all", 0, 0.0, False)]


def test_graphs_written_and_read_are_the_same(spark, tmp_path):
    g = {"graph_id": "g", "directed": True, "nodes": [{"id": "b", "label": 'B "1"', "attributes": {"z": 1.0, "a": None, "k": True, "s": "1"}}, {"id": "a", "label": "a", "attributes": {}}], "edges": [{"source": "b", "target": "a", "relation": "r", "weight": 1e20}]}
    (tmp_path / "g.jsonl").write_text(json.dumps({"tuple_id": "t", "graph": g}))
    frames = records.collection(records.read_static(spark, str(tmp_path / "g.jsonl")))
    back = json.loads(records.graph_json(frames).first().json)
    assert back == {**g, "nodes": sorted(g["nodes"], key=lambda n: n["id"])}
    assert [type(v) for _, v in sorted(back["nodes"][1]["attributes"].items())] == [type(None), bool, str, float]


def test_questions_about_graphs_of_a_file(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text(json.dumps({"tuple_id": "t", "graph": {"graph_id": "g", "nodes": [{"id": "a", "attributes": {"k": "true"}}, {"id": "b", "attributes": {"k": True}}], "edges": [{"source": "a", "target": "b"}]}}))
    g = records.collection(records.read_static(spark, str(tmp_path / "g.jsonl")))
    q = spark.createDataFrame([(1, "filtered_neighbor_count", "g", "a", None, "k", "n:1", None), (2, "filtered_neighbor_count", "g", "b", None, "k", "n:1", None)], "query_id int, kind string, graph_id string, source string, target string, attribute string, token string, hops int")
    assert {r.query_id: r.answer for r in solve.answer_queries(q, g.nodes, g.edges, g.attrs).collect()} == {1: "1", 2: "0"}


def plain_fingerprint(g):
    ends = lambda e: (e["source"], e["target"]) if g.get("directed") or e["source"] <= e["target"] else (e["target"], e["source"])
    nodes = sorted([n["id"], n.get("label", n["id"]), sorted(map(list, n.get("attributes", {}).items()))] for n in g["nodes"])
    edges = sorted([*ends(e), e.get("relation", "connected"), float(e.get("weight", 1)), sorted(map(list, e.get("attributes", {}).items()))] for e in g["edges"])
    return hashlib.sha256(json.dumps({"directed": bool(g.get("directed")), "nodes": nodes, "edges": edges}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


GRAPHS = [
    {"graph_id": "1", "nodes": [{"id": "b", "label": "Ä 😀 \"x\"", "attributes": {"z": 1.0, "k": True, "a": None, "s": "1\n", "i": 3, "f": 1e-7, "é": "é"}}, {"id": "a"}], "edges": [{"source": "b", "target": "a", "weight": 2, "attributes": {"built": 1999, "aircon": False}}, {"source": "a", "target": "b", "relation": "r", "weight": 0.1}]},
    {"graph_id": "2", "directed": True, "nodes": [{"id": "b"}, {"id": "a"}], "edges": [{"source": "b", "target": "a"}]}, {"graph_id": "3", "nodes": [], "edges": []},
]


def test_fingerprints_are_those_of_canonical_json(spark, tmp_path):
    lines = [{"tuple_id": g["graph_id"], "graph": g} for g in GRAPHS]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    got = {r.tuple_id: r.f for r in records.read_static(spark, str(tmp_path / "g.jsonl")).select("tuple_id", records.fingerprint(F.col("graph")).alias("f")).collect()}
    assert got == {g["graph_id"]: plain_fingerprint(g) for g in GRAPHS}


def test_chains_of_fingerprints(spark, tmp_path):
    turn = lambda i, before, after: {"turn_index": i, "before_fingerprint": before, "after_fingerprint": after}
    own = plain_fingerprint(GRAPHS[0])
    sessions = [
        {"session_id": "good", "initial_graph": GRAPHS[0], "turns": [turn(0, own, "x"), turn(1, "x", "y"), turn(2, "y", "z")]}, {"session_id": "start", "initial_graph": GRAPHS[0], "turns": [turn(0, "w", "x"), turn(1, "x", "y")]},
        {"session_id": "gap", "initial_graph": GRAPHS[0], "turns": [turn(0, own, "x"), turn(1, "x2", "y"), turn(2, None, "z")]}, {"session_id": "none", "initial_graph": GRAPHS[0], "turns": []},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in sessions))
    got = {tuple(r) for r in records.chain_violations(records.read_sessions(spark, str(tmp_path / "s.jsonl"))).collect()}
    assert got == {("start", 0, "initial_state"), ("gap", 1, "broken_chain"), ("gap", 2, "broken_chain")}
