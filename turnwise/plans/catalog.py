"""Named queries over the driver's tables, each a Spark plan built from this library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import literal_token, string_token
from ..operators import adjacency as adj
from ..operators import apply, boosting, corpus, graph_text, leaks, local, metrics, paths, prompts, quota, reach, reports, solve, spectrum, structure, vectors, what_if
from ..operators import sessions as ses
from ..operators import static_eval
from ..shared import once
from ..sources import records, trade

Query = Callable[[SparkSession, str], DataFrame]
ANSWER = ["graph_id", "source", "answer"]
PAIR = ["graph_id", "source", "target", "answer"]


def _nodes_query(g: trade.Graphs) -> DataFrame:
    return g.nodes.select("graph_id", F.col("node_id").alias("source"))


def _with_attribute(q: DataFrame, name: str, value) -> DataFrame:
    return q.withColumn("attribute", F.lit(name)).withColumn("token", F.lit(literal_token(value)))


def _two_tokens(q: DataFrame, name: str, one, two) -> DataFrame:
    """Every query twice, with either token of one attribute."""
    return _with_attribute(q, name, one).unionByName(_with_attribute(q, name, two))


def _graph_query(f: Callable[[trade.Graphs], DataFrame], k: int = 1) -> Query:
    return lambda spark, d: f(trade.trade_graphs(spark, d, k))


class Sessions:
    """The tables about an input folder's sessions, each settled the first time it is asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.graphs = spark, d, trade.trade_graphs(spark, d, 1)

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return once(self.spark, self.d, name, build)

    @property
    def turns(self) -> DataFrame:
        return self._once("turns", lambda: ses.resolved(trade.sessions(self.spark, self.d), self.graphs))

    @property
    def said(self) -> DataFrame:
        return self._once("utterances", lambda: ses.utterances(self.turns, self.graphs))

    @property
    def edits(self) -> DataFrame:
        return self._once("edits", lambda: ses.edits(self.said, self.graphs))

    @property
    def guessed(self) -> DataFrame:
        return ses.as_said(self.edits)

    @property
    def after(self) -> ses.States:
        s = ses.states(self.turns, self.graphs)
        return ses.States(self._once("state-nodes", lambda: s.nodes), self._once("state-edges", lambda: s.edges))

    @property
    def marks(self) -> DataFrame:
        return self._once("marks", lambda: ses.marks(self.turns, self.graphs))

    @property
    def guessed_marks(self) -> DataFrame:
        return self._once("guessed-marks", lambda: ses.marks(self.guessed, self.graphs))

    @property
    def played(self) -> DataFrame:
        return self._once("played", lambda: ses.played(self.edits, self.graphs))

    @property
    def answers(self) -> DataFrame:
        return ses.answers(self.played)

    @property
    def writes(self) -> DataFrame:
        return ses.writes(self.played)

    @property
    def rows(self) -> DataFrame:
        labels = lambda: records.round_trip(self.answers.select("session_id", "turn_index", "gold", "stale"), "labels")
        return self._once("rows", lambda: ses.evaluation_rows(self.played, labels()))

    @property
    def ladder(self) -> DataFrame:
        return self._once("ladder", lambda: metrics.lookup_ladder(self.answers.where(ses.learns()), self.answers.where(~ses.learns()), [["kind", "op", "stale"], ["kind", "stale"], ["kind"]]))

    @property
    def dimensions(self) -> DataFrame:
        return self._once("dimensions", lambda: reports.turn_dimensions(ses.asked(self.said), self.answers))


def _session_query(f: Callable[[Sessions], DataFrame]) -> Query:
    return lambda spark, d: f(Sessions(spark, d))


def _dialogue(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")


def _history_text(spark: SparkSession, d: str) -> DataFrame:
    return tx.history(_dialogue(spark, d), "conv_id", "turn", "text").select("conv_id", "turn", "history")


def _token_budget(spark: SparkSession, d: str) -> DataFrame:
    t = _dialogue(spark, d)
    return t.select("conv_id", "turn", tx.token_budget(F.col("text"), 16).alias("kept"), F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))


def _set_f1(spark: SparkSession, d: str) -> DataFrame:
    t = _dialogue(spark, d)
    listed = F.array_join(tx.words(F.col("text")), ",")
    a = t.where("role = 'user'").select("conv_id", "turn", listed.alias("x"))
    b = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), listed.alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", tx.set_f1(F.col("x"), F.col("y")).alias("f1"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    t = _dialogue(spark, d)
    return t.select("conv_id", "turn", tx.normalize_answer(F.col("text")).alias("answer"))


def _pooled_mean(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null")
    dims = e.select("label", F.posexplode("embedding").alias("dim", "x"))
    return dims.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _programs(s: Sessions) -> DataFrame:
    """(session_id, program): each session's edits as one program text."""
    op = F.col("op")
    operation = F.when(op.startswith("SET"), "SET").otherwise(op)
    edit = tx.canonical_edit(
        operation, F.when(op.startswith("SET"), "NODE").when(op.isin("ADD", "DEL"), "EDGE"),
        F.when(op == "DEL", F.col("lo")).otherwise(F.col("a")), F.when(op == "DEL", F.col("hi")).otherwise(F.col("b")),
        F.when(op.startswith("SET"), "status"), F.when(op == "SET_CLOSED", "closed").when(op == "SET_OPEN", "open"), F.lit(None).cast("string"), F.col("relation"),
    )
    listed = s.turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", edit.alias("edit")))).alias("edits"))
    return listed.select("session_id", tx.program_text(F.transform("edits", lambda e: e.edit)).alias("program"))


def _parsed(s: Sessions) -> DataFrame:
    p = _programs(s).select("session_id", F.posexplode(tx.program_edits(F.col("program"))).alias("pos", "edit"))
    return p.select("session_id", F.col("pos").cast("long").alias("pos"), tx.parse_edit(F.col("edit")).alias("e")).select("session_id", "pos", "e.*")


def applied_programs(s: Sessions) -> DataFrame:
    """Each session's program applied edit by edit to its first graph; graph_id is the session's id."""
    own = s.turns.select("session_id", "graph_id").distinct().withColumn("_id", F.col("session_id").cast("string"))
    of = lambda t: t.join(own, "graph_id").drop("graph_id", "session_id").withColumnRenamed("_id", "graph_id")
    edits = _parsed(s).select(F.col("session_id").cast("string").alias("graph_id"), "pos", "operation", "target", "first", "second", "attribute", string_token(F.col("value")).alias("token"), "value", "label", "relation")
    return apply.apply_programs(of(s.graphs.nodes), of(s.graphs.edges), of(s.graphs.attrs), edits)


def _equivalence(s: Sessions) -> DataFrame:
    """Whether each edit program equals that of the session numbered one higher, field by field and in order."""
    fields = F.struct("pos", "operation", "target", "first", "second", "attribute", "value", "relation")
    whole = _parsed(s).groupBy("session_id").agg(F.array_sort(F.collect_list(fields)).alias("edits"))
    other = whole.select((F.col("session_id") - 1).alias("session_id"), F.col("edits").alias("others"))
    return whole.join(other, "session_id").select("session_id", F.size("edits").cast("long").alias("n"), F.col("edits").eqNullSafe(F.col("others")).alias("equal"))


def _op_sets(s: Sessions) -> DataFrame:
    t = s.turns.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("op")), "+").alias("ops"), F.count(F.lit(1)).alias("turns"))
    return t.groupBy("ops").agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"))


def _asked_before(s: Sessions) -> DataFrame:
    """Whether a turn's question had been asked before in its session: whether it is not the first of its kind there."""
    q = ses.asked(s.turns).withColumn("q", F.concat_ws("|", "kind", "source", F.coalesce("target", F.lit("")), F.coalesce("attribute", F.lit("")), F.coalesce("value", F.lit("")), F.coalesce("hops", F.lit(-1))))
    first = Window.partitionBy("session_id", "q").orderBy("turn_index")
    return q.select("session_id", "turn_index", (F.row_number().over(first) > 1).alias("asked_before"))


def _damaged(text) -> F.Column:
    """An edit text with a fault that depends on its place: none, a word too few, an unknown operation, a SET of an edge."""
    n = F.col("pos") % 4
    return F.when(n == 1, F.regexp_replace(text, r" \S+$", "")).when(n == 2, F.concat(F.lit("X"), text)).when(n == 3, F.regexp_replace(text, "^(ADD|DEL) EDGE", "SET EDGE")).otherwise(text)


def _malformed(s: Sessions) -> DataFrame:
    p = _programs(s).select("session_id", F.posexplode(tx.program_edits(F.col("program"))).alias("pos", "edit"))
    e = p.select("session_id", F.col("pos").cast("long").alias("pos"), tx.parse_edit(_damaged(F.col("edit"))).alias("e"))
    return e.select("session_id", "pos", "e.operation", "e.error")


def _mixed_query(f: Callable[[trade.Graphs], DataFrame]) -> Query:
    return lambda spark, d: f(trade.mixed_graphs(spark, d))


def _mixed_answers(spark: SparkSession, d: str) -> DataFrame:
    g = trade.mixed_graphs(spark, d)
    return once(spark, d, "mixed-answers", lambda: solve.answer_queries(once(spark, d, "mixed-questions", lambda: trade.mixed_questions(g)), g.nodes, g.edges, g.attrs))


def _strong(g: trade.Graphs) -> DataFrame:
    return paths.regions(g.nodes, adj.adjacency(g.edges), ["graph_id"], adj.directed_graphs(g.edges))[0]


def _open_reach(g: trade.Graphs) -> DataFrame:
    """(graph_id, node_id, reached): how many nodes an open node leads to over open ones: the sizes of the components that its own leads to."""
    comp, links = paths.regions(g.nodes.where("is_open"), adj.open_adjacency(g.nodes, g.edges), ["graph_id"], adj.directed_graphs(g.edges))
    led = reach.closure(comp.select("graph_id", F.col("component").alias("a")), links, ["graph_id"])
    size = comp.groupBy("graph_id", F.col("component").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = led.join(size, ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("component")).agg(F.sum("n").alias("reached"))
    return comp.join(total, ["graph_id", "component"]).select("graph_id", "node_id", "reached")


def coded(g: trade.Graphs) -> trade.Graphs:
    """g with an attribute code on every node, whose values true, "true", 1 and 1.0 differ in type alone."""
    nth = F.col("nk") % 4
    token, said = F.when(nth == 1, "s:true").otherwise("n:1"), F.element_at(F.array(*map(F.lit, ("True", "true", "1", "1.0"))), (nth + 1).cast("int"))
    code = g.nodes.select("graph_id", "node_id", F.lit("code").alias("name"), token.alias("token"), said.alias("text"))
    return trade.Graphs(g.nodes, g.edges, g.attrs.unionByName(code))


def static_questions(g: trade.Graphs) -> DataFrame:
    """One question about each node of each graph, of all kinds in turn, with value_json and what identifies a static record."""
    q = trade.mixed_questions(g).where(F.col("target") == F.concat(F.lit("n"), F.pmod(F.substring("source", 2, 9).cast("int") + 7, F.lit(25)).cast("string")))
    n = F.substring("source", 2, 9).cast("int")
    code = n % 3 == 0
    attribute, value = F.when(code, "code").otherwise(F.col("attribute")), F.when(code, F.when(n % 2 == 0, "true").otherwise("1.0"))
    plain = F.when(F.col("value") == "False", "false").when(F.col("value").isNotNull(), F.concat(F.lit('"'), "value", F.lit('"')))
    return q.select(
        "query_id", "kind", "graph_id", "source", "target", attribute.alias("attribute"), F.coalesce(value, plain).alias("value_json"),
        F.when(code, F.lit("n:1")).otherwise(F.col("token")).alias("token"), "hops", F.when(n % 2 == 0, "train").otherwise("test").alias("split"), F.when(n < 10, "small").otherwise("large").alias("scale_bin"),
    )


def _static_rows(spark: SparkSession, d: str) -> DataFrame:
    """Static records written as JSON lines, read back and answered; their stored answers hold for the graphs without directions."""

    def build() -> DataFrame:
        g = coded(trade.mixed_graphs(spark, d))
        q = static_questions(g)
        gold = solve.answer_queries(q.select("query_id", "kind", "graph_id", "source", "target", "attribute", "token", "hops"), g.nodes, g.edges.drop("directed"), g.attrs)
        lines = records.static_json(q.join(gold, "query_id"), records.graph_json(g))
        path = records.new_folder(spark, "static")
        lines.write.text(path)
        return static_eval.evaluate(records.read_static(spark, path))

    return once(spark, d, "static-rows", build)


def _leaks(s: Sessions) -> DataFrame:
    """The audit over the sessions' questions: rules from sessions to learn from, scored on the others."""
    q = leaks.prompt_features(ses.asked(s.turns), s.graphs.attrs)
    rows = q.join(s.answers.select("session_id", "turn_index", F.col("gold").alias("answer")), ["session_id", "turn_index"])
    rows = s._once("leak-rows", lambda: rows.select("session_id", "turn_index", F.col("kind").alias("task"), "answer", "features"))
    return leaks.audit(rows.where(ses.learns()), rows.where(~ses.learns()), ["session_id", "turn_index"])


def _structure_overlap(s: Sessions) -> DataFrame:
    """Structures that the graphs after their first turn share between sessions to learn from and sessions to score."""
    first = s.turns.where("turn_index = 0").select("session_id", "turn_index", "graph_id", F.col("session_id").cast("string").alias("state"))
    at = ses.states(s.turns, s.graphs, first)
    fixed = first.select("state", "graph_id").join(s.graphs.attrs.where("name in ('line', 'size')"), "graph_id").select(F.col("state").alias("graph_id"), "node_id", "name", "text")
    status = at.nodes.select("graph_id", "node_id", F.lit("status").alias("name"), F.when(F.col("is_open"), "open").otherwise("closed").alias("text"))
    hashes = structure.neighborhood_hash(at.nodes, at.edges, fixed.unionByName(status))
    return reports.structure_overlap(hashes, first.select(F.col("state").alias("graph_id"), ses.learns().alias("learns")))


def edit_questions(g: trade.Graphs) -> DataFrame:
    """(query_id, kind, graph_id, source, target): every node of every graph about its cycles and degree, every pair about its ways and edge."""
    one = _nodes_query(g).withColumn("target", F.lit(None).cast("string")).select("*", F.explode(F.array(*map(F.lit, ("cycle_membership", "node_degree")))).alias("kind"))
    two = trade.pair_queries(g).select("*", F.explode(F.array(*map(F.lit, ("reachability", "path_cost", "edge_exists")))).alias("kind"))
    return one.unionByName(two).select(F.concat_ws("/", "kind", "graph_id", "source", "target").alias("query_id"), "kind", "graph_id", "source", "target")


def _changing_edits(g: trade.Graphs) -> DataFrame:
    """For each question and operation how many edits change the answer, the first and the last of them."""
    q = edit_questions(g)
    edit = F.concat_ws("-", "a", "b", "relation")
    out = what_if.changing_edits(q, g.nodes, g.edges).groupBy("query_id", "op").agg(F.count(F.lit(1)).alias("edits"), F.min(edit).alias("first_edit"), F.max(edit).alias("last_edit"))
    return out.join(q, "query_id").select("kind", "graph_id", "source", "target", "op", "edits", "first_edit", "last_edit")


def _counterfactuals(g: trade.Graphs) -> DataFrame:
    return what_if.counterfactual_pairs(edit_questions(g), g.nodes, g.edges, 12).drop("query_id")


def _hashed(g: trade.Graphs) -> DataFrame:
    return vectors.node_vectors(g.nodes, coded(g).attrs)


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """df with columns rounded, and no negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


#: Steps that the query's probe takes; the operator's own number is 500.
PROBE_ROUNDS = 20


def _probe(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the vectors of odd id, by a linear probe fitted on those of even id."""
    e = _embeddings(spark, d)
    model = spectrum.fit_probe(e.where("vec_id % 2 = 0"), "label", rounds=PROBE_ROUNDS)
    return model.predict(e.where("vec_id % 2 = 1"), "label").select("vec_id", "label", "predicted")


#: Trees a class that the query grows; the operator's own number is 150.
SHORTCUT_ROUNDS = 12


def _shortcut(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, task, answer, guess, correct): answers guessed from the structure close to the question, trees grown on half of the graphs and asked about the others."""
    g = trade.mixed_graphs(spark, d)
    q = trade.mixed_questions(g).where(~F.col("kind").isin(*solve.NAMED))
    said = _mixed_answers(spark, d)
    rows = boosting.structure_features(q, g.nodes, g.edges).join(said, "query_id").join(trade.graph_ids(spark, d), "graph_id")
    rows = once(spark, d, "shortcut-rows", lambda: rows.select("query_id", F.col("kind").alias("task"), "features", tx.normalize_answer(F.col("answer")).alias("answer"), (F.col("gi") % 4 < 2).alias("learns")).where("task <> 'within_hops_list'"))
    guessed = boosting.predict(rows.where("not learns"), boosting.fit(rows.where("learns"), SHORTCUT_ROUNDS))
    return guessed.select("query_id", "task", "answer", "guess", tx.answers_match(F.col("task"), F.col("answer"), F.col("guess")).alias("correct"))


def _degree_value(g: trade.Graphs) -> DataFrame:
    return adj.degrees(g.nodes, g.edges).select("graph_id", "node_id", F.col("degree").cast("double").alias("x"))


def queries() -> dict[str, Query]:
    gq, nq = _graph_query, _nodes_query
    return {
        "node_degree": gq(lambda g: local.node_degree(nq(g), g.nodes, g.edges).select(*ANSWER)),
        "node_count": gq(lambda g: local.node_count(nq(g), g.nodes).select(*ANSWER)),
        "edge_exists": gq(lambda g: local.edge_exists(trade.pair_queries(g), g.nodes, g.edges).select(*PAIR)),
        "link_prediction": gq(lambda g: local.link_prediction(trade.pair_queries(g), g.nodes, g.edges).select(*PAIR), k=2),
        "filtered_neighbor_count": gq(lambda g: local.filtered_neighbor_count(_with_attribute(nq(g), "has_rail", True), g.nodes, g.edges, g.attrs).select(*ANSWER)),
        "attribute_lookup": gq(lambda g: local.attribute_lookup(_with_attribute(nq(g), "disabled_access", None), g.nodes, g.attrs).select(*ANSWER)),
        "attribute_check": gq(lambda g: local.attribute_check(_with_attribute(nq(g), "cleanliness", "dirty"), g.nodes, g.attrs).select(*ANSWER)),
        "within_hops_count": gq(lambda g: local.within_hops_count(_with_attribute(nq(g), "has_rail", True), g.nodes, g.edges, g.attrs, hops=2).select(*ANSWER)),
        "within_hops_list": gq(lambda g: local.within_hops_list(nq(g), g.nodes, g.edges, hops=2).select(*ANSWER)),
        "most_common_attribute": gq(lambda g: local.most_common_attribute(_with_attribute(nq(g), "line", None), g.nodes, g.edges, g.attrs).select(*ANSWER)),
        "hop_map": gq(lambda g: adj.hop_map(nq(g), g.edges, 3)),
        "reachability": gq(lambda g: paths.reachability(trade.pair_queries(g), g.nodes, g.edges).select(*PAIR)),
        "graph_components": gq(lambda g: paths.graph_components(g.nodes, g.edges)),
        "shortest_path": gq(lambda g: paths.shortest_path(trade.pair_queries(g), g.nodes, g.edges).select(*PAIR)),
        "path_cost": gq(lambda g: paths.path_cost(trade.pair_queries(g), g.nodes, g.edges).select(*PAIR)),
        "filtered_path_count": gq(lambda g: paths.filtered_path_count(_with_attribute(trade.pair_queries(g), "has_rail", True), g.nodes, g.edges, g.attrs).select(*PAIR)),
        "constrained_reachability": gq(lambda g: paths.constrained_reachability(_with_attribute(trade.pair_queries(g), "has_rail", False), g.nodes, g.edges, g.attrs).select(*PAIR)),
        "cycle_membership": gq(lambda g: paths.cycle_membership(nq(g), g.nodes, g.edges).select(*ANSWER)),
        "bridges": gq(lambda g: paths.bridges(g.nodes, g.edges)),
        "graph_extent": gq(lambda g: paths.extent(g.nodes, g.edges), k=2),
        "triangles": gq(lambda g: structure.triangles(g.edges), k=2),
        "common_neighbors": gq(lambda g: structure.common_neighbors(g.edges)),
        "two_hop_reach": gq(lambda g: structure.two_hop_reach(g.nodes, g.edges)),
        "leaf_neighbors": gq(lambda g: structure.leaf_neighbors(g.nodes, g.edges)),
        "density_bins": gq(lambda g: structure.density(g.nodes, g.edges)),
        "mean_degree": gq(lambda g: structure.mean_degree(g.nodes, g.edges)),
        "missing_edges": gq(lambda g: structure.missing_edges(g.nodes, g.edges)),
        "graph_violations": gq(lambda g: structure.violations(g.nodes, g.edges.unionByName(g.edges.where("src = 'n0'")).unionByName(g.edges.where("dst = 'n7'").withColumn("dst", F.col("src"))))),
        "state_key": gq(lambda g: structure.state_key(g.nodes, g.edges)),
        "neighborhood_hash": gq(lambda g: structure.neighborhood_hash(g.nodes, g.edges, g.attrs)),
        "neighbor_aggregate": gq(lambda g: structure.neighbor_aggregate(g.nodes, g.edges, _degree_value(g))),
        "two_token_neighbor_count": gq(lambda g: local.filtered_neighbor_count(_two_tokens(nq(g), "cleanliness", "dirty", "clean"), g.nodes, g.edges, g.attrs).select(*ANSWER, "token"), k=2),
        "two_token_hops_count": gq(lambda g: local.within_hops_count(_two_tokens(nq(g), "size", "small", "large"), g.nodes, g.edges, g.attrs).select(*ANSWER, "token")),
        "two_token_hops_list": gq(lambda g: local.within_hops_list(_two_tokens(nq(g), "size", "small", "large"), g.nodes, g.edges, g.attrs).select(*ANSWER, "token")),
        "two_token_path_count": gq(lambda g: paths.filtered_path_count(_two_tokens(trade.pair_queries(g), "has_rail", True, False), g.nodes, g.edges, g.attrs).select(*PAIR, "token")),
        "open_hop_map": gq(lambda g: adj.hop_map(nq(g), g.edges, 3, g.nodes)),
        "ring_pairs": gq(lambda g: structure.ring_pairs(g.edges)),
        "graph_text": gq(lambda g: graph_text.serialize_graph(g.nodes, g.edges, g.attrs)),
        "graph_fingerprint": gq(lambda g: graph_text.fingerprint(g.nodes, g.edges, g.attrs)),
        "node_text": gq(lambda g: graph_text.node_text(g.nodes, g.attrs, F.array(F.lit("status")))),
        "graph_audit": gq(lambda g: reports.graph_audit(g.nodes, g.edges), k=2),
        "session_edits": _session_query(lambda s: s.turns.select("session_id", "turn_index", "graph_id", "op", "a", "b", "lo", "hi", "relation")),
        "edit_effects": _session_query(lambda s: ses.effects(s.turns, s.graphs)),
        "session_node_state": _session_query(lambda s: ses.node_state(s.turns, s.graphs)),
        "session_edge_state": _session_query(lambda s: ses.edge_state(s.turns, s.graphs)),
        "state_nodes": _session_query(lambda s: s.after.nodes.select("graph_id", "node_id", "is_open")),
        "state_edges": _session_query(lambda s: s.after.edges),
        "utterances": _session_query(lambda s: s.said.select("session_id", "turn_index", "family", "utterance")),
        "predicted_edits": _session_query(lambda s: s.guessed.select("session_id", "turn_index", "op", "a")),
        "write_accuracy": _session_query(lambda s: s.writes),
        "session_questions": _session_query(lambda s: graph_text.questions(ses.asked(s.turns), s.graphs.nodes, s.graphs.attrs).select("session_id", "turn_index", "question")),
        "session_answers": _session_query(lambda s: s.answers),
        "prompt_sizes": _session_query(lambda s: prompts.input_sizes(s.turns, s.said, graph_text.questions(ses.asked(s.turns), s.graphs.nodes, s.graphs.attrs), s.graphs)),
        "edit_programs": _session_query(_programs),
        "parse_programs": _session_query(_parsed),
        "malformed_edits": _session_query(_malformed),
        "applied_effects": _session_query(lambda s: applied_programs(s).where("what = 'effect'").select(F.col("graph_id").cast("long").alias("session_id"), "pos", "applied", "error")),
        "applied_edges": _session_query(lambda s: applied_programs(s).where("what = 'edge'").select(F.col("graph_id").cast("long").alias("session_id"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "relation", "weight")),
        "program_equivalence": _session_query(_equivalence),
        "edit_mentions": _session_query(lambda s: reports.edit_mentions(ses.asked(s.turns))),
        "operation_sets": _session_query(_op_sets),
        "asked_before": _session_query(_asked_before),
        "turn_dimensions": _session_query(lambda s: s.dimensions),
        "last_mention": _session_query(lambda s: reports.last_mention(ses.asked(s.turns))),
        "states_seen": _session_query(lambda s: reports.states_seen(s.turns, s.graphs)),
        "closed_counts": _session_query(lambda s: s.after.nodes.groupBy("graph_id").agg(F.count_if(~F.col("is_open")).alias("closed"))),
        "evaluation_rows": _session_query(lambda s: s.rows),
        "condition_summary": _session_query(lambda s: metrics.rates(s.rows, ["condition"])),
        "stratified_accuracy": _session_query(lambda s: metrics.rates(s.rows, ["condition", "kind"])),
        "final_state_accuracy": _session_query(lambda s: metrics.final_accuracy(s.rows)),
        "session_totals": _session_query(lambda s: metrics.session_totals(s.rows)),
        "paired_delta": _session_query(lambda s: metrics.paired(s.rows, "tool_solver", "stale_answer")),
        "cluster_bootstrap": _session_query(lambda s: metrics.bootstrap(s.rows)),
        "paired_bootstrap": _session_query(lambda s: metrics.paired_bootstrap(s.rows, "predicted_updated_graph", "stale_answer")),
        "static_gate": _session_query(lambda s: metrics.gate(s.rows, "stale_answer")),
        "slice_accuracy": _session_query(lambda s: reports.slices(s.rows.where("condition = 'stale_answer'"), s.dimensions, s.ladder)),
        "breakdowns": _session_query(lambda s: reports.breakdowns(s.rows, s.dimensions)),
        "write_path_report": _session_query(lambda s: reports.write_path(s.writes, s.dimensions)),
        "condition_gain": _session_query(lambda s: reports.gain(s.rows, "predicted_updated_graph", ["frozen_graph_history", "question_only"])),
        "seed_summary": _session_query(lambda s: reports.seed_summary(s.rows)),
        "label_audit": _session_query(lambda s: metrics.label_audit(s.answers)),
        "session_audit": _session_query(lambda s: reports.session_audit(s.turns, s.answers)),
        "session_violations": _session_query(lambda s: reports.violations(s.said, s.answers)),
        "chance_of_mention": _session_query(lambda s: reports.chance_of_mention(ses.asked(s.turns), s.graphs.nodes)),
        "split_overlap": _session_query(lambda s: reports.split_overlap(s.turns)),
        "structure_overlap": _session_query(_structure_overlap),
        "majority_prior": _session_query(lambda s: ses.majority_prior(s.answers)),
        "lookup_ladder": _session_query(lambda s: s.ladder),
        "stride_sample": _session_query(lambda s: corpus.stride_sample(s.turns, ["session_id", "turn_index"], 7, 50)),
        "first_sessions": _session_query(lambda s: corpus.first_keys(s.turns, "session_id", 5).select("session_id", "turn_index", "op")),
        "last_states": _session_query(lambda s: corpus.last_wins(s.turns.withColumn("_key", ses.touched_key(F.col("op"), F.col("a"), F.col("lo"), F.col("hi"))).where("_key is not null"), ["session_id", "_key"], "turn_index").select("session_id", F.col("_key").alias("key"), "turn_index", "op")),
        "first_states": _session_query(lambda s: corpus.first_wins(s.turns.withColumn("_key", ses.touched_key(F.col("op"), F.col("a"), F.col("lo"), F.col("hi"))).where("_key is not null"), ["session_id", "_key"], "turn_index").select("session_id", F.col("_key").alias("key"), "turn_index", "op")),
        "changed_questions": _session_query(lambda s: corpus.changed_questions(s.answers)),
        "changed_quota": _session_query(lambda s: quota.changed_quota(s.answers)),
        "changing_edits": gq(_changing_edits),
        "counterfactual_pairs": gq(_counterfactuals),
        "two_sided_strata": _session_query(lambda s: corpus.two_sided(s.answers.select("kind", "op", F.col("gold").alias("answer")), ["kind", "op"])),
        "training_examples": _session_query(lambda s: corpus.session_examples(graph_text.questions(ses.asked(s.turns), s.graphs.nodes, s.graphs.attrs), s.answers)),
        "session_records": _session_query(lambda s: records.round_trip(records.turn_records(s.said, s.answers), "session-records")),
        "record_hash": _session_query(lambda s: records.stream_hash(records.turn_records(s.said, s.answers), ["session_id", "turn_index"], "session_id")),
        "query_eligibility": gq(lambda g: corpus.eligible(trade.pair_queries(g), g.nodes, g.edges)),
        "candidate_questions": gq(lambda g: corpus.attribute_candidates(nq(g), g.attrs, ["has_rail", "cleanliness"])),
        "unique_mode": gq(lambda g: corpus.unique_mode(g.attrs.where("name in ('line', 'size')"), ["graph_id", "name"], "text")),
        "pair_strata": gq(lambda g: corpus.strata(trade.pair_queries(g), g.nodes, g.edges, g.attrs)),
        "scale_and_hop_bins": gq(lambda g: corpus.bins(trade.pair_queries(g), g.nodes, g.edges)),
        "tensor_order": gq(lambda g: structure.tensor_order(g.nodes, g.edges)),
        "grid_cells": gq(lambda g: corpus.grid(g.nodes)),
        "values_present": gq(lambda g: g.attrs.select("graph_id", "name", "text").distinct()),
        "normalized_answers": _normalized,
        "answer_matches": _session_query(lambda s: s.answers.select("session_id", "turn_index", tx.answers_match(F.col("kind"), F.concat(F.col("gold"), F.lit(".")), F.col("initial")).alias("matches"))),
        "history_text": _history_text,
        "token_budget": _token_budget,
        "set_f1": _set_f1,
        "pooled_mean": _pooled_mean,
        "mixed_answers": _mixed_answers,
        "directed_components": _mixed_query(_strong),
        "directed_closure": _mixed_query(_open_reach),
        "node_vectors": gq(lambda g: _rounded(_hashed(g), 9, "value")),
        **{f"message_{how}": gq(lambda g, how=how: _rounded(vectors.messages(g.edges, _hashed(g), how), 9, "value")) for how in ("sum", "mean", "max")},
        "embedding_covariance": lambda spark, d: _rounded(spectrum.covariance(_embeddings(spark, d)), 6, "value"),
        "collapse_statistics": lambda spark, d: _rounded(_rounded(spectrum.collapse(_embeddings(spark, d), "label"), 9, "mean_within_cosine"), 6, "effective_rank"),
        "principal_components": lambda spark, d: spectrum.principal_components(_embeddings(spark, d), 8),
        "linear_probe": _probe,
        "shortcut_answers": _shortcut,
        "text_leak_audit": _session_query(_leaks),
        "static_eval": lambda spark, d: _static_rows(spark, d).select("tuple_id", "split", "reasoning_type", "scale_bin", "gold_answer", "predicted_answer", "correct"),
        "static_report": lambda spark, d: static_eval.report(_static_rows(spark, d)),
        "deep_hops": _mixed_query(lambda g: adj.hop_map(nq(g), g.edges, None)),
    }
