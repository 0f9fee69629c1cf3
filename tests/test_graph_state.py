"""A stream of edits, node edits included, against the same programs applied at once."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import apply
from turnwise.streaming import graph_state


def programs(seed, graphs=4, length=24):
    rng = random.Random(seed)
    names, out = [f"n{i}" for i in range(7)], []
    for g in range(graphs):
        for pos in range(length):
            kind, a, b = rng.randrange(10), rng.choice(names), rng.choice(names)
            rel = rng.choice(["r", "s"])
            if kind < 2:
                e = ("ADD", "NODE", a, None, None, None, None, rng.choice([None, "New"]), None)
            elif kind < 4:
                e = ("DEL", "NODE", a, None, None, None, None, None, None)
            elif kind < 6:
                v = rng.choice(["x", "y", None])
                e = ("SET", "NODE", a, None, rng.choice(["k", "l"]), None if v is None else f"s:{v}", v, None, None)
            elif kind < 9:
                e = (rng.choice(["ADD", "ADD", "DEL"]), "EDGE", a, b, None, None, None, None, rel)
            else:
                e = ("NOOP", None, None, None, None, None, None, None, None)
            out.append((f"g{g}", pos, *e))
    return out


@pytest.fixture
def graphs(spark):
    nodes = spark.createDataFrame([(f"g{g}", f"n{i}", f"N{i}") for g in range(5) for i in range(5)], "graph_id string, node_id string, label string")
    edges = spark.createDataFrame([(f"g{g}", f"n{i}", f"n{(i + 1) % 5}", "r", 2.5) for g in range(5) for i in range(5)], "graph_id string, src string, dst string, relation string, weight double")
    attrs = spark.createDataFrame([(f"g{g}", f"n{i}", "k", "s:x", "x") for g in range(5) for i in range(3)], "graph_id string, node_id string, name string, token string, text string")
    return nodes, edges, attrs


def run(spark, tmp_path, batches, start, **more):
    """All rows that the batches, one after the other, give."""
    graph_state.configure(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, graph_state.EDIT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:02d}"))
    edits = spark.readStream.schema(graph_state.EDIT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = graph_state.graph_changes(edits, start, **more)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def whole(df):
    cols = ["graph_id", "what", "node_id", "label", "name", "token", "text", F.least("src", "dst"), F.greatest("src", "dst"), "relation", "weight"]
    return sorted(str(tuple(r)) for r in df.where("what in ('node', 'attribute', 'edge')").select(*cols).collect())


def test_replay_equals_programs_applied_at_once(spark, tmp_path, graphs):
    nodes, edges, attrs = graphs
    edits = programs(1)
    got = run(spark, tmp_path, [[e for e in edits if e[1] // 12 == i] for i in range(2)], graph_state.initial_rows(nodes, edges, attrs)).cache()
    want = apply.apply_programs(nodes, edges, attrs, spark.createDataFrame(edits, graph_state.EDIT)).cache()
    effect = lambda df: sorted(str(tuple(r)) for r in df.where("what = 'effect'").select("graph_id", "pos", "applied", "error").collect())
    assert effect(got) == effect(want) and len(effect(got)) == len(edits)
    # What no edit touched is as it was at the start.
    start = graph_state.initial_rows(nodes, edges, attrs).select("*", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("seq"), F.lit(False).alias("gone"))
    assert whole(graph_state.latest(got.unionByName(start, allowMissingColumns=True))) == whole(want)


def test_late_and_repeated_edits_change_nothing(spark, tmp_path):
    add = lambda pos, n: ("g", pos, "ADD", "NODE", n, None, None, None, None, None, None)
    got = run(spark, tmp_path, [[add(5, "a"), add(2, "b")], [add(5, "a"), add(3, "c"), add(None, "x"), add(6, "d")], [add(4, "e")]], None)
    rows = {(r.what, r.pos, r.error) for r in got.where("what in ('effect', 'late')").collect()}
    assert rows == {("effect", 2, None), ("effect", 5, None), ("effect", 6, None), ("late", 5, "late"), ("late", 3, "late"), ("late", None, "no_position"), ("late", 4, "late")}
    assert sorted(r.node_id for r in graph_state.latest(got).collect()) == ["a", "b", "d"]


def test_entries_with_a_time_to_live(spark, tmp_path):
    add = ("g", 1, "ADD", "NODE", "a", None, None, None, None, None, None)
    got = run(spark, tmp_path, [[add]], None, live_ms=3_600_000)
    assert [(r.what, r.applied) for r in got.orderBy("seq").collect()] == [("effect", True), ("node", None)]
