"""Answers of replayed sessions against those of the graphs spelt out, and what the queries about sessions leave on disk."""

import functools
import os
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import metrics, replay, solve
from turnwise.operators import sessions as ses
from turnwise.plans import catalog
from turnwise.plans.catalog import Sessions
from turnwise.shared import table_dir
from turnwise.sources.trade import Graphs

DATA = "/root/testdata/sf0.001"


def written(spark):
    """Bytes in this application's tables."""
    top = table_dir(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(top) for x in names if not x.endswith(".crc"))


def odd_sessions(spark, seed):
    """Graphs with loops, parts and halves as weights; sessions with unknown nodes, edits without ends, and guesses that go astray."""
    rng, nodes, edges, attrs = random.Random(seed), [], [], []
    for g, (n, m) in {"a": (7, 9), "b": (12, 15), "c": (3, 0)}.items():
        nodes += [(g, f"n{i}", f"L{i % 5}", rng.random() < 0.8, i) for i in range(n)]
        pairs = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(m)}
        edges += [(g, *(f"n{x}" for x in rng.sample(p, 2)), "track", rng.choice((0.5, 1.0, 1.25, 2.0))) for p in sorted(pairs)]
        for i in range(n):
            attrs += [(g, f"n{i}", "has_rail", *rng.choice((("n:1", "True"), ("n:0", "False")))), (g, f"n{i}", "line", "s:x", rng.choice("xy"))] + [(g, f"n{i}", "cleanliness", "s:dirty", "dirty")] * (i % 2)
    rows = []
    for s in range(12):
        g, size = (("a", 7), ("b", 12), ("c", 3))[s % 3]
        for t in range(20):
            def edit():
                op, (a, b) = rng.choice(("SET_CLOSED", "SET_OPEN", "ADD", "DEL", "NOOP")), rng.sample([f"n{i}" for i in range(size)] + ["n99"], 2)
                ends = (min(a, b), max(a, b)) if op in ("ADD", "DEL") and rng.random() < 0.9 or op == "ADD" else (None, None)
                return (op, a, b, *ends, "track" if ends[0] else None)

            own = edit()
            rows.append((s, t, g, *own, rng.randrange(1000), *(own if rng.random() < 0.6 else edit())))
    kind = "session_id long, turn_index long, graph_id string, op string, a string, b string, lo string, hi string, relation string, event_id long, said_op string, said_a string, said_b string, said_lo string, said_hi string, said_relation string"
    graphs = Graphs(
        spark.createDataFrame(nodes, "graph_id string, node_id string, label string, is_open boolean, nk int"),
        spark.createDataFrame(edges, "graph_id string, src string, dst string, relation string, weight double"),
        spark.createDataFrame(attrs, "graph_id string, node_id string, name string, token string, text string"),
    )
    return spark.createDataFrame(rows, kind), graphs


def spelt_out(turns, q, g):
    """{(session, turn): answer} on the graph after each turn, by the operators over whole collections."""
    s = ses.states(turns, g)
    status = F.when(F.col("is_open"), "open").otherwise("closed")
    own = s.nodes.select("graph_id", "node_id", F.lit("status").alias("name"), F.concat(F.lit("s:"), status).alias("token"), status.alias("text"))
    fixed = turns.select(ses.state_id(F.col("session_id"), F.col("turn_index")).alias("state"), "graph_id").join(g.attrs, "graph_id").select(F.col("state").alias("graph_id"), "node_id", "name", "token", "text")
    state = ses.state_id(F.col("session_id"), F.col("turn_index"))
    ask = q.select(state.alias("query_id"), "kind", state.alias("graph_id"), "source", "target", "attribute", "token", "hops")
    return {tuple(map(int, r.query_id.split(":"))): r.answer for r in solve.answer_queries(ask, s.nodes, s.edges, own.unionByName(fixed)).collect()}


def test_replay_equals_states_spelt_out(spark):
    both, g = odd_sessions(spark, 1)
    turns, q = both.select([c for c in both.columns if not c.startswith("said_")]), ses.asked(both)
    done = {(r.session_id, r.turn_index): r for r in ses.played(both, g).collect()}
    # The question of a turn on a session's first graph, and on the next session's: as if nothing had been done. On the one before it: a turn later.
    still = turns.withColumn("op", F.lit("NOOP")).withColumns({c: F.lit(None).cast("string") for c in ("lo", "hi")})
    away = still.drop("graph_id").join(ses.session_ring(both).select("session_id", F.col("other").alias("graph_id")), "session_id")
    late = turns.withColumn("turn_index", F.col("turn_index") + 1)
    runs = {"gold": (turns, q), "predicted": (ses.as_said(both), q), "initial": (still, q), "shuffled": (away, q), "stale": (late, q.where("turn_index > 0"))}
    apart = lambda t, i, cols: t.select((F.col("session_id") + 1000 * i).alias("session_id"), *[c for c in cols if c != "session_id"])
    union = lambda k, cols: functools.reduce(DataFrame.unionByName, [apart(r[k], i, cols) for i, r in enumerate(runs.values())])
    plain = spelt_out(union(0, turns.columns), union(1, q.columns), g)
    assert len(done) == both.count() and len(plain) == 5 * len(done) - 12
    for (session, turn), answer in plain.items():
        role, r = list(runs)[session // 1000], done[session % 1000, turn]
        assert r[role] == answer, (role, r, answer)
    assert len({r.gold for r in done.values()}) > 15
    shapes = [{(r.session_id, r.turn_index): r.shape for r in ses.marks(t, g).collect()} for t in (turns, ses.as_said(both))]
    assert {k: r.state_exact for k, r in done.items()} == {k: shapes[0][k] == shapes[1][k] for k in done}


def test_costs_print_as_spark_does(spark):
    costs = [0.0, 3.0, 2.5, 0.125, 0.375, 1.005, 12345678.25, 1e17, 0.001, 99999.995]
    plain = F.when(F.col("x") == F.floor("x"), F.col("x").cast("long").cast("string")).otherwise(F.bround("x", 2).cast("string"))
    assert [replay.cost_text(x) for x in costs] == [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(costs)], "i int, x double").select("i", plain.alias("t")).orderBy("i").collect()]


def test_session_answers_writes_little(spark, tmp_path):
    """graphs after turns and their questions are not written."""
    os.symlink(DATA, tmp_path / "data")
    s = Sessions(spark, str(tmp_path / "data"))
    n, _, at = s.said.count(), s.guessed.count(), written(spark)
    assert s.answers.count() == n
    assert (size := written(spark) - at) < 60 * n, size / n


def test_weights_of_a_session_equal_draw(spark):
    """draws are made in the task that holds a session, to the same weights."""
    drawn = spark.range(1, 301).select("id", *[metrics.draw(0, F.col("id"), F.lit(k)).alias(f"s{k}") for k in (1, 77, 89_999)]).orderBy("id").collect()
    for k in (1, 77, 89_999):
        assert metrics.weights(0, 300, str(k)).tolist() == [r[f"s{k}"] for r in drawn]
    totals = spark.createDataFrame([(c, s, s % 3, 5) for c in ("x", "y") for s in range(70)], "label string, session_id long, x long, n long")
    by_join = totals.crossJoin(spark.range(1, 41).withColumnRenamed("id", "rep")).withColumn("w", metrics.draw(3, F.col("rep"), F.col("session_id")))
    by_join = by_join.groupBy("label", "rep").agg(F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("n")))
    assert sorted(map(tuple, metrics.resampled(totals, 40, 3).collect())) == sorted(map(tuple, by_join.collect()))


def test_labels_are_written_once(spark, tmp_path):
    """rows that are there are read without labels being written again."""
    os.symlink(DATA, tmp_path / "data")
    s = Sessions(spark, str(tmp_path / "data"))
    n, at = s.rows.count(), written(spark)
    assert s.rows.count() == n > 0 and written(spark) == at


def test_draws_are_dealt_over_tasks(spark):
    """many sessions of few bytes don't end up in one task."""
    totals = spark.range(200).select(F.lit("all").alias("label"), F.col("id").alias("session_id"), F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("n"))
    plan = metrics.resampled(totals, 5, 0)
    plan.collect()
    assert "RoundRobinPartitioning(4), REPARTITION_BY_NUM" in plan._jdf.queryExecution().toString()


def test_mentions_ask_for_no_answers(spark, tmp_path, monkeypatch):
    """whether a question names what its edit touches shows without solving it."""
    os.symlink(DATA, tmp_path / "data")
    monkeypatch.setattr(Sessions, "answers", property(lambda s: 1 / 0))
    assert catalog.queries()["edit_mentions"](spark, str(tmp_path / "data")).count() == 1000
