"""Static evaluation: questions stored with their graphs, answered and scored, and the gate over the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import settle
from ..sources import records
from . import solve


def evaluate(static: DataFrame) -> DataFrame:
    """(tuple_id, split, reasoning_type, topology, density_bin, hop_depth, scale_bin, gold_answer, predicted_answer, correct) of static records.

    Every tuple is a graph of its own, so records may share graph ids. The kind that answers are
    matched by is the metadata's where it names one. A tuple whose kind is unknown has no prediction.
    """
    key = F.col("tuple_id")
    g = records.collection(static, "graph", key)
    frames = [settle(df, f"static-{n}") for n, df in (("nodes", g.nodes), ("edges", g.edges), ("attributes", g.attrs))]
    said = solve.answer_queries(settle(records.record_queries(static, key), "static-queries"), *frames)
    named = F.try_variant_get(F.try_element_at("metadata", F.lit("reasoning_type")), "$", "string")
    rows = static.select("tuple_id", "split", F.coalesce(named, F.col("query.reasoning_type")).alias("reasoning_type"), "topology", "density_bin", "hop_depth", "scale_bin", "answer")
    rows = rows.join(said.select(F.col("query_id").alias("tuple_id"), F.col("answer").alias("said")), "tuple_id", "left")
    return rows.select(
        "tuple_id", "split", "reasoning_type", "topology", "density_bin", "hop_depth", "scale_bin", tx.normalize_answer(F.col("answer")).alias("gold_answer"), tx.normalize_answer(F.col("said")).alias("predicted_answer"),
        F.coalesce(tx.answers_match(F.col("reasoning_type"), F.col("answer"), F.col("said")), F.lit(False)).alias("correct"),
    )


def report(rows: DataFrame, overall: float = 0.7, each: float = 0.5) -> DataFrame:
    """(level, bucket, n, accuracy, passed): over all rows, by task and by scale.

    A task passes at ``each``; scales are told, not judged. The whole passes at ``overall`` if all
    tasks pass. Without rows the accuracy over all is 0 and nothing passes.
    """
    n = F.count(F.lit(1))
    score = [n.alias("n"), F.coalesce(F.try_divide(F.count_if("correct"), n), F.lit(0.0)).alias("accuracy")]
    sets = rows.groupingSets([["reasoning_type"], ["scale_bin"]], "reasoning_type", "scale_bin")
    parts = sets.agg(F.when(F.grouping("scale_bin") == 1, "task").otherwise("scale").alias("level"), F.coalesce("reasoning_type", "scale_bin").alias("bucket"), *score)
    out = parts.select("level", "bucket", "n", "accuracy").unionByName(rows.agg(F.lit("all").alias("level"), F.lit(None).cast("string").alias("bucket"), *score))
    failing = out.where((F.col("level") == "task") & (F.col("accuracy") < each)).agg(F.count(F.lit(1)).alias("failing"))
    judged = out.crossJoin(failing)  # one row
    passed = F.when(F.col("level") == "task", F.col("accuracy") >= each).when(F.col("level") == "all", (F.col("accuracy") >= overall) & (F.col("failing") == 0))
    return judged.select("level", "bucket", "n", "accuracy", passed.alias("passed"))
