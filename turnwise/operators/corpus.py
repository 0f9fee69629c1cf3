"""Building a corpus of questions: candidates, strata, quotas, samples, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered
from . import solve
from .adjacency import degrees, hop_map


def stride_sample(df: DataFrame, order: list[str], stride: int, limit: int | None = None) -> DataFrame:
    """Every stride-th row in the given order, from the first, and at most limit of them."""
    out = numbered(df, order, "_no").where(F.col("_no") % stride == 0)
    return (out.where(F.col("_no") < stride * limit) if limit is not None else out).drop("_no")


def first_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the first n keys in order of key."""
    keys = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(keys, key, "left_semi")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the last in order."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("_r")).select(*keys, "_r.*")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the first in order, as a union of pools keeps them."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_r")).select(*keys, "_r.*")


def capped(df: DataFrame, keys: list[str], identity: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each key, drawn by a hash of the seed and the row's identity: a sample, the same on every run."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *identity), *identity)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def eligible(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, source, target, path, cycle): whether a question about a path may be asked of a pair (both ends open), and one about a cycle of its source (degree two)."""
    open_ = nodes.where("is_open").select("graph_id", "node_id")
    deg = degrees(nodes, edges).select("graph_id", F.col("node_id").alias("source"), (F.col("degree") == 2).alias("cycle"))
    s, t = open_.toDF("graph_id", "source").withColumn("_s", F.lit(True)), open_.toDF("graph_id", "target").withColumn("_t", F.lit(True))
    out = pairs.join(s, ["graph_id", "source"], "left").join(t, ["graph_id", "target"], "left").join(deg, ["graph_id", "source"])
    return out.select("graph_id", "source", "target", F.coalesce(F.col("_s") & F.col("_t"), F.lit(False)).alias("path"), "cycle")


def attribute_candidates(sources: DataFrame, attrs: DataFrame, names: list[str]) -> DataFrame:
    """(graph_id, source, attribute, token): each source with every value that its graph holds of the named attributes."""
    values = attrs.where(F.col("name").isin(*names)).select("graph_id", F.col("name").alias("attribute"), "token").distinct()
    return sources.select("graph_id", "source").join(values, "graph_id")


def unique_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) of the keys whose commonest value is commoner than any other."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("n"), F.max_by(value, "n").alias(value))
    tied = n.join(top.select(*keys, F.col("n").alias("_top")), keys).where(F.col("n") == F.col("_top")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_ties"))
    return top.join(tied, keys).where("_ties = 1").select(*keys, value, "n")


def strata(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """(graph_id, source, target, stratum): whether a pair shares a line, and both degrees up to three."""
    line = attrs.where("name = 'line'").select("graph_id", "node_id", F.col("text").alias("line"))
    deg = degrees(nodes, edges).select("graph_id", "node_id", F.concat(F.lit("deg"), F.least("degree", F.lit(3)).cast("string")).alias("deg"))
    both = line.join(deg, ["graph_id", "node_id"])
    out = pairs.join(both.toDF("graph_id", "source", "_sl", "_sd"), ["graph_id", "source"]).join(both.toDF("graph_id", "target", "_tl", "_td"), ["graph_id", "target"])
    same = F.when(F.col("_sl").eqNullSafe(F.col("_tl")), "same_line").otherwise("diff_line")
    return out.select("graph_id", "source", "target", F.concat_ws("|", same, F.concat_ws("-", "_sd", "_td")).alias("stratum"))


def bins(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, source, target, scale, hops): the size class of the graph, and local, mid or global by the steps between the ends (one, up to three, more or none)."""
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    far = hop_map(pairs.select("graph_id", "source").distinct(), edges, 3).withColumnRenamed("node_id", "target")
    out = pairs.join(size, "graph_id").join(far, ["graph_id", "source", "target"], "left")
    scale = F.when(F.col("n") <= 15, "scale_small").when(F.col("n") <= 19, "scale_medium").otherwise("scale_large")
    return out.select("graph_id", "source", "target", scale.alias("scale"), F.when(F.col("depth") == 1, "local").when(F.col("depth") <= 3, "mid").otherwise("global").alias("hops"))


def two_sided(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answers, n) of the strata that offer two answers or more."""
    out = answers.groupBy(*keys).agg(F.countDistinct("answer").alias("answers"), F.count(F.lit(1)).alias("n"))
    return out.where("answers >= 2")


def changed_questions(answers: DataFrame) -> DataFrame:
    """(session_id, turn_index, kind, before, after): the first question of each kind in a session whose answer its edit changed."""
    c = answers.where("gold <> stale").select("session_id", "turn_index", "kind", F.col("stale").alias("before"), F.col("gold").alias("after"))
    return first_wins(c, ["session_id", "kind"], "turn_index").select("session_id", "turn_index", "kind", "before", "after")


def grid(nodes: DataFrame) -> DataFrame:
    """(graph_id, kind): the full grid of graphs and kinds of question."""
    kinds = F.explode(F.array(*map(F.lit, solve.KINDS)))
    return nodes.select("graph_id").distinct().select("graph_id", kinds.alias("kind"))


def session_examples(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(example_id, graph_id, prompt, answer, split): a training example for each turn, on the graph after it."""
    both = questions.select("session_id", "turn_index", "question").join(answers.select("session_id", "turn_index", "gold"), ["session_id", "turn_index"])
    sid, turn = F.col("session_id").cast("string"), F.col("turn_index").cast("string")
    split = F.when(F.col("session_id") % 2 == 0, "train").otherwise("test")
    return both.select(F.concat(sid, F.lit("-turn-"), turn).alias("example_id"), F.concat_ws(":", sid, turn).alias("graph_id"), F.col("question").alias("prompt"), F.col("gold").alias("answer"), split.alias("split"))
