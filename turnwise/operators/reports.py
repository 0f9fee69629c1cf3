"""Reports over evaluation rows and sessions: dimensions, breakdowns, slices, gains, audits, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import sessions as ses
from .structure import density

TURN = ["session_id", "turn_index"]


def touched_nodes() -> Column:
    """The node ids that a turn's operation touches."""
    return F.when(F.col("op").startswith("SET"), F.array("a")).when(F.col("op").isin("ADD", "DEL"), F.array("lo", "hi")).otherwise(F.array().cast("array<string>"))


def named_nodes() -> Column:
    """The node ids that a turn's question names."""
    return F.array_distinct(F.array_compact(F.array("source", "target")))


def edit_mentions(asked: DataFrame) -> DataFrame:
    """(session_id, turn_index, mentions): whether a turn's question names a node that its edit touches."""
    return asked.select(*TURN, F.arrays_overlap(touched_nodes(), named_nodes()).alias("mentions"))


def turn_dimensions(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(session_id, turn_index, task, length, turn, family, changed, mentions, ops): what breakdowns go by, a row a turn; asked are utterances with their questions."""
    length = asked.groupBy("session_id").agg(F.count(F.lit(1)).alias("length"))
    a = answers.select(*TURN, (tx.normalize_answer(F.col("gold")) != tx.normalize_answer(F.col("stale"))).alias("changed"))
    ops = F.when(F.col("op") == "NOOP", "noop").when(F.col("op").startswith("SET"), "SET NODE").otherwise(F.concat("op", F.lit(" EDGE")))
    t = asked.select(*TURN, F.col("kind").alias("task"), (F.col("turn_index") + 1).alias("turn"), F.arrays_overlap(touched_nodes(), named_nodes()).alias("mentions"), ops.alias("ops"), "family")
    return t.join(a, TURN).join(length, "session_id").select(*TURN, "task", "length", "turn", "family", "changed", "mentions", "ops")


def breakdowns(rows: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(condition, view, bucket, turns, accuracy) by length, turn, task, family and change, and over all, in one grouping."""
    r = rows.select("condition", *TURN, "correct").join(dimensions, TURN)
    view = lambda name, c: F.struct(F.lit(name).alias("view"), c.cast("string").alias("bucket"))
    views = F.array(
        view("all", F.lit("all")), view("by_length", F.col("length")), view("by_turn", F.col("turn")), view("by_task", F.col("task")), view("by_family", F.col("family")),
        view("by_change", F.when(F.col("changed"), "changed").otherwise("unchanged")), view("by_operation", F.col("ops")),
        view("changed_no_mention", F.when(F.col("changed") & ~F.col("mentions"), "changed_no_mention")),
    )
    out = r.select("condition", "correct", F.explode(views).alias("v")).where("v.bucket is not null")
    return out.groupBy("condition", "v.view", "v.bucket").agg(F.count(F.lit(1)).alias("turns"), (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"))


def slices(rows: DataFrame, dimensions: DataFrame, ladder: DataFrame) -> DataFrame:
    """(slice, turns, accuracy) over thirteen slices of the turns; a slice that asks for a wrong shortcut leaves out turns without one.

    The shortcut is the ladder's guess: that of a finer level where it had the support, and that of
    any level as the second one.
    """
    guess = ladder.select(*TURN, F.when(F.col("level") == 0, F.col("guess") == F.col("gold")).alias("shortcut"), (F.col("guess") == F.col("gold")).alias("shortcut2"))
    r = rows.select(*TURN, "correct").join(dimensions, TURN).join(guess, TURN, "left")
    wrong, right = lambda c: c.eqNullSafe(F.lit(False)), lambda c: c.eqNullSafe(F.lit(True))
    c, m, s1, s2 = F.col("changed"), F.col("mentions"), F.col("shortcut"), F.col("shortcut2")
    flags = {
        "all": F.lit(True), "answer_changing": c, "answer_unchanged": ~c, "no_mention": ~m, "mention": m, "shortcut_wrong": wrong(s1), "shortcut_right": right(s1), "changed_and_no_mention": c & ~m,
        "local_wrong": wrong(s1) & wrong(s2), "local_right": right(s1) | right(s2), **{f"family_{f}": F.col("family") == f for f in ses.FAMILIES},
    }
    named = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
    return r.select("correct", F.explode(named).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("turns"), (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"))


def write_path(writes: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(ops, family, turns, edit_accuracy, exact_states) of predicted edits."""
    both = writes.select(*TURN, "edit_correct", "state_exact").join(dimensions.select(*TURN, "ops", "family"), TURN)
    n = F.count(F.lit(1))
    return both.groupBy("ops", "family").agg(n.alias("turns"), (F.count_if("edit_correct") / n).alias("edit_accuracy"), (F.count_if("state_exact") / n).alias("exact_states"))


def gain(rows: DataFrame, full: str, parts: list[str], least: float = 0.1) -> DataFrame:
    """(full, best_part, gain, passed): accuracy of a condition over the best of others; passed if the gain is at least ``least``."""
    acc = rows.where(F.col("condition").isin(full, *parts)).groupBy("condition").agg((F.count_if("correct") / F.count(F.lit(1))).alias("x"))
    out = acc.agg(F.max(F.when(F.col("condition") == full, F.col("x"))).alias("full"), F.max(F.when(F.col("condition") != full, F.col("x"))).alias("best_part"))
    return out.select("full", "best_part", (F.col("full") - F.col("best_part")).alias("gain"), (F.col("full") - F.col("best_part") >= least).alias("passed"))


def seed_summary(rows: DataFrame, runs: int = 3) -> DataFrame:
    """(condition, kind, mean, sd, low, high) of accuracy over runs: sessions by id modulo runs.

    sd is the sample's, null for one run. Only what every run has is summed up.
    """
    per = rows.groupBy("condition", "kind", (F.col("session_id") % runs).alias("run")).agg((F.count_if("correct") / F.count(F.lit(1))).alias("x"))
    out = per.groupBy("condition", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))
    n = rows.select((F.col("session_id") % runs).alias("run")).distinct().agg(F.count(F.lit(1)).alias("runs"))
    return out.crossJoin(n).where("n = runs").select("condition", "kind", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "low", "high")


def last_mention(asked: DataFrame) -> DataFrame:
    """(session_id, turn_index, kind, last_turn): the last turn before each at which the session asked the same kind; null if none did."""
    w = Window.partitionBy("session_id", "kind").orderBy("turn_index")
    return asked.select(*TURN, "kind", F.lag("turn_index").over(w).alias("last_turn"))


def states_seen(turns: DataFrame, g) -> DataFrame:
    """(session_id, turn_index, seen): whether the graph after a turn is one that the session has had before, the initial one included.

    A state is the set of keys that differ from the initial graph, told by sums of their hashes:
    each applied operation adds its key or takes it away.
    """
    moved = ses.intervals(turns, g).select("session_id", F.col("from_turn").alias("turn_index"), F.xxhash64("key").alias("h"), F.when(F.col("on") != F.col("begin"), 1).otherwise(-1).alias("sign"))
    moved = moved.select(*TURN, (F.col("h").cast("decimal(38,0)") * F.col("sign")).alias("d"))
    order = Window.partitionBy("session_id").orderBy("turn_index")
    each = turns.select(*TURN).join(moved, TURN, "left").withColumn("mark", F.coalesce(F.sum("d").over(order), F.lit(0).cast("decimal(38,0)")))
    first = Window.partitionBy("session_id", "mark").orderBy("turn_index")
    return each.select(*TURN, ((F.row_number().over(first) > 1) | (F.col("mark") == 0)).alias("seen"))


def graph_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(density_bin, graphs, nodes_mean, edges_mean, edges_max) of a collection."""
    d = density(nodes, edges)
    return d.groupBy("density_bin").agg(F.count(F.lit(1)).alias("graphs"), F.avg("n_nodes").alias("nodes_mean"), F.avg("n_edges").alias("edges_mean"), F.max("n_edges").alias("edges_max"))


def session_audit(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """(measure, value, n): how often each operation, kind of question and answer comes, and the counts of turns, sessions and changed answers."""
    part = lambda df, name, c: df.groupBy(F.lit(name).alias("measure"), c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = part(turns, "operation", F.col("op")).unionByName(part(answers, "kind", F.col("kind"))).unionByName(part(answers, "answer", F.col("gold")))
    whole = turns.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.count_if(F.col("op") == "NOOP").alias("noop_turns"))
    changed = answers.agg(F.count_if(F.col("gold") != F.col("stale")).alias("changed"))
    wide = whole.crossJoin(changed)
    named = F.array(*[F.struct(F.lit("all").alias("measure"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("turns", "sessions", "noop_turns", "changed")])
    return out.unionByName(wide.select(F.explode(named).alias("x")).select("x.*"))


def violations(said: DataFrame, answers: DataFrame) -> DataFrame:
    """(session_id, turn_index, rule): turns whose answer an edit leaves unchanged, and turns whose wording holds the answer as a word."""
    both = said.select(*TURN, "op", "utterance").join(answers.select(*TURN, "gold", "stale"), TURN).where("op <> 'NOOP'")
    spoken = F.regexp_extract_all(F.lower("utterance"), F.lit(r"(?U)\b([\w-]+)\b"), F.lit(1))
    rules = F.array_compact(F.array(F.when(F.col("gold") == F.col("stale"), F.lit("unchanged_answer")), F.when(F.array_contains(spoken, F.lower("gold")), F.lit("answer_in_wording"))))
    return both.select(*TURN, F.explode(rules).alias("rule"))


def chance_of_mention(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(turns, mentioned, expected): edit turns whose question names a node the edit touches, and how many would by chance.

    k named nodes drawn from n miss all t touched ones with probability C(n - t, k) / C(n, k); k is one or two.
    """
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    q = asked.where("op <> 'NOOP'").join(size, "graph_id").select("n", F.size(named_nodes()).alias("k"), F.size(F.array_distinct(touched_nodes())).alias("t"), F.arrays_overlap(named_nodes(), touched_nodes()).alias("hit"))
    n, t = F.col("n"), F.col("t")
    miss = F.when(F.col("k") == 1, (n - t) / n).otherwise(F.coalesce(F.try_divide((n - t) * (n - t - 1), n * (n - 1)), F.lit(0.0)))
    return q.agg(F.count(F.lit(1)).alias("turns"), F.count_if("hit").alias("mentioned"), F.round(F.sum(1 - miss), 6).alias("expected"))


def split_overlap(turns: DataFrame) -> DataFrame:
    """(graph_id, learn_sessions, score_sessions): graphs that sessions of both splits start from."""
    n = turns.select("graph_id", "session_id").distinct().groupBy("graph_id").agg(F.count_if(ses.learns()).alias("learn_sessions"), F.count_if(~ses.learns()).alias("score_sessions"))
    return n.where("learn_sessions > 0 and score_sessions > 0")


def structure_overlap(hashes: DataFrame, splits: DataFrame) -> DataFrame:
    """(wl_hash, learn_sessions, score_sessions): structures that graphs (graph_id, wl_hash) of both splits (graph_id, learns) have, whatever their ids."""
    n = hashes.join(splits, "graph_id").groupBy("wl_hash").agg(F.count_if("learns").alias("learn_sessions"), F.count_if(~F.col("learns")).alias("score_sessions"))
    return n.where("learn_sessions > 0 and score_sessions > 0")
