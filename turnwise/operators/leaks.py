"""Text-leak audit: whether what a prompt says gives the answer away beyond what its question does.

A rule answers a row with the commonest answer that rows of equal features had. For each task the best
rule is sought among sets of features: those of the question alone (none, each, all), and all of the
question with one or two of the nodes' texts. Rules are chosen by two-fold cross-validation on the rows
to fit, the first best set wins, and are then scored once on the others.

Rows are laid out once for every set of their task and grouped by what the set's features hold, so all
rules of all tasks come from one aggregation, pre-aggregated where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import numbered, settle

#: Features of the question itself begin so.
QUESTION = "q."


def combinations(names: Column) -> Column:
    """The sets of features to try, in order, as (ord, question, names): names is the sorted array of a task's features."""
    q = F.filter(names, lambda n: n.startswith(QUESTION))
    node = F.filter(names, lambda n: ~n.startswith(QUESTION))
    none = F.array().cast("array<array<string>>")
    own = F.concat(F.array(F.array().cast("array<string>")), F.transform(q, lambda n: F.array(n)), F.when(F.size(q) > 1, F.array(q)).otherwise(none))
    ones = F.transform(node, lambda n: F.concat(q, F.array(n)))
    twos = F.flatten(F.transform(node, lambda a, i: F.transform(F.filter(node, lambda b, j: j > i), lambda b: F.concat(q, F.array(a, b)))))
    return F.concat(F.transform(own, lambda c, i: F.struct(i.alias("ord"), F.lit(True).alias("question"), c.alias("names"))), F.transform(F.concat(ones, twos), lambda c, i: F.struct(i.alias("ord"), F.lit(False).alias("question"), c.alias("names"))))


def _first_mode(answer: str, n: Column, first: Column) -> Column:
    """The commonest answer, the one met first among equals; null where there is none."""
    return F.max_by(F.when(n > 0, F.col(answer)), F.when(n > 0, F.struct(n.alias("n"), (-first).alias("f"))))


def audit(fit: DataFrame, score: DataFrame, order: list[str], margin: float = 0.05) -> DataFrame:
    """(task, majority_accuracy, question_only_rule_accuracy, with_node_text_rule_accuracy, node_text_rule_features, leak_flag) for each task of score.

    Both frames have task, answer and features (a map of strings; a missing feature is like a null
    one); order tells the rows to fit apart and says which half of a task is which fold. A row whose
    features the rule never met counts as wrong. Without rows to fit every rule is wrong.
    """
    placed = numbered(fit.select("task", "answer", "features", *order), ["task", *order], "_at")
    of = placed.groupBy("task").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    placed = placed.join(of, "task").withColumn("_fold", ((F.col("_at") - F.col("_from")) >= F.floor(F.col("_n") / 2)).cast("int"))
    # Equal rows of a fold count as one row with a number, and the place of the first.
    cells = settle(placed.select("task", "answer", F.array_sort(F.map_entries("features")).alias("f"), "_fold", "_at").groupBy("task", "answer", "f", "_fold").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("at")), "leak-cells")
    names = cells.select("task", F.explode("f.key").alias("name")).groupBy("task").agg(F.array_sort(F.collect_set("name")).alias("names"))
    names = score.select("task").distinct().join(names, "task", "left").select("task", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    combos = settle(names.select("task", F.explode(combinations(F.col("names"))).alias("c")).select("task", "c.*"), "leak-sets")

    def laid(rows: DataFrame, features: Column) -> DataFrame:
        return rows.withColumn("_map", features).withColumn("key", F.transform("names", lambda n: F.col("_map")[n])).drop("_map", "names")

    by = ["task", "question", "ord", "key"]
    zero, one = F.col("_fold") == 0, F.col("_fold") == 1
    wide = laid(cells.join(combos, "task"), F.map_from_entries("f"))
    counts = wide.groupBy(*by, "answer").agg(
        F.coalesce(F.sum(F.when(zero, F.col("n"))), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("n1"), F.min(F.when(zero, F.col("at"))).alias("a0"), F.min(F.when(one, F.col("at"))).alias("a1"), F.min("at").alias("a")
    )
    counts = settle(counts, "leak-counts")
    rules = settle(counts.groupBy(*by).agg(_first_mode("answer", F.col("n0"), F.col("a0")).alias("r0"), _first_mode("answer", F.col("n1"), F.col("a1")).alias("r1"), _first_mode("answer", F.col("n0") + F.col("n1"), F.col("a")).alias("rule")), "leak-rules")
    there = rules.select(*[F.col(c).alias(f"_{c}") for c in by], "r0", "r1")
    same = (F.col("task") == F.col("_task")) & (F.col("question") == F.col("_question")) & (F.col("ord") == F.col("_ord")) & F.col("key").eqNullSafe(F.col("_key"))
    hit = lambda n, r: F.sum(F.when(F.col("answer") == F.col(r), F.col(n)).otherwise(0))
    cv = counts.join(there, same).groupBy("task", "question", "ord").agg((F.try_divide(hit("n1", "r0"), F.greatest(F.sum("n1"), F.lit(1))) + F.try_divide(hit("n0", "r1"), F.greatest(F.sum("n0"), F.lit(1)))).alias("cv"))
    best = combos.join(cv, ["task", "question", "ord"], "left").groupBy("task", "question").agg(F.min_by(F.struct("ord", "names"), F.struct(-F.coalesce("cv", F.lit(0.0)), F.col("ord"))).alias("b"))
    best = best.select("task", "question", "b.ord", "b.names")
    # Without node texts the question's own set stands for both.
    own = best.where("question")
    other = own.join(best.where("not question").select("task"), "task", "left_anti")
    chosen = settle(own.select("task", F.lit("q").alias("role"), "question", "ord", "names").unionByName(best.where("not question").select("task", F.lit("n").alias("role"), "question", "ord", "names")).unionByName(other.select("task", F.lit("n").alias("role"), "question", "ord", "names")), "leak-chosen")

    tried = laid(score.select("task", "answer", "features").join(chosen, "task"), F.col("features"))
    final = rules.select(*[F.col(c).alias(f"_{c}") for c in by], "rule")
    scored = tried.join(final, same, "left").groupBy("task").agg(*[
        (F.count_if((F.col("role") == r) & (F.col("rule") == F.col("answer"))) / F.count_if(F.col("role") == r)).alias(name) for r, name in (("q", "question_only_rule_accuracy"), ("n", "with_node_text_rule_accuracy"))
    ])
    each = score.groupBy("task", "answer").agg(F.count(F.lit(1)).alias("n")).groupBy("task").agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))
    said = chosen.where("role = 'n'").select("task", F.array_join("names", "+").alias("node_text_rule_features"))
    out = scored.join(each, "task").join(said, "task")
    return out.select(
        "task", "majority_accuracy", "question_only_rule_accuracy", "with_node_text_rule_accuracy", "node_text_rule_features",
        (F.col("with_node_text_rule_accuracy") > F.col("question_only_rule_accuracy") + margin).alias("leak_flag"),
    )


def prompt_features(asked: DataFrame, attrs: DataFrame, withheld: tuple[str, ...] = ("status",)) -> DataFrame:
    """asked with features: what its prompt says of the question (q.attribute, q.value, q.hops) and of its nodes (src.name, tgt.name, same_line), without withheld names and the one asked for."""
    held = attrs.groupBy("graph_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("_held"))
    q = asked.join(held.toDF("graph_id", "source", "_s"), ["graph_id", "source"], "left").join(held.toDF("graph_id", "target", "_t"), ["graph_id", "target"], "left")
    secret = F.col("kind").isin("attribute_lookup", "attribute_check", "most_common_attribute_within_hops")
    none = F.create_map().cast("map<string,string>")

    def told(c: str, role: str) -> Column:
        shown = F.map_filter(F.coalesce(c, none), lambda k, _: ~k.isin(*withheld) & ~(secret & k.eqNullSafe(F.col("attribute"))))
        return F.transform_keys(shown, lambda k, _: F.concat(F.lit(f"{role}."), k))

    q = q.withColumn("_a", told("_s", "src")).withColumn("_b", told("_t", "tgt"))
    lines = F.map_contains_key("_a", "src.line") & F.map_contains_key("_b", "tgt.line")
    line = F.when(lines, F.create_map(F.lit("same_line"), F.col("_a")["src.line"].eqNullSafe(F.col("_b")["tgt.line"]).cast("string"))).otherwise(none)
    own = F.create_map(F.lit("q.attribute"), F.col("attribute"), F.lit("q.value"), F.col("value"), F.lit("q.hops"), F.col("hops").cast("string"))
    return q.select(*asked.columns, F.map_concat(own, "_a", "_b", line).alias("features"))
