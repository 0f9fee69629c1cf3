"""Scores over evaluation rows: rates, Wilson intervals, strata, paired differences, bootstrap."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import prepare, settle

Z = 1.96


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds at Z to nine digits, clamped to 0 and 1; (0, 0) without rows."""
    none = n == 0
    n = F.when(none, 1).otherwise(n)  # for the divisions only
    p = successes / n
    base = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / base
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / base
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(none, 0.0).otherwise(F.round(low, 9)), F.when(none, 0.0).otherwise(F.round(high, 9))


def rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, turns, sessions, accuracy, stale_rate, wilson_low, wilson_high); null strata are left out."""
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.count_if("correct").alias("right"), F.count_if("stale").alias("old"))
    lo, hi = wilson(F.col("right"), F.col("turns"))
    return out.select(*by, "turns", "sessions", (F.col("right") / F.col("turns")).alias("accuracy"), (F.col("old") / F.col("turns")).alias("stale_rate"), lo.alias("wilson_low"), hi.alias("wilson_high"))


def final_accuracy(rows: DataFrame) -> DataFrame:
    """(condition, sessions, final_accuracy): accuracy of the last turn of each session."""
    last = rows.groupBy("condition", "session_id").agg(F.max_by("correct", "turn_index").alias("right"))
    return last.groupBy("condition").agg(F.count(F.lit(1)).alias("sessions"), (F.count_if("right") / F.count(F.lit(1))).alias("final_accuracy"))


def session_totals(rows: DataFrame) -> DataFrame:
    """(condition, session_id, right, turns)."""
    return rows.groupBy("condition", "session_id").agg(F.count_if("correct").alias("right"), F.count(F.lit(1)).alias("turns"))


def paired(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, kind, n, delta, wins, losses, ties) of two conditions on the same turns."""
    key = ["session_id", "turn_index", "kind"]
    a = rows.where(F.col("condition") == left).select(*key, F.col("correct").cast("int").alias("x"))
    b = rows.where(F.col("condition") == right).groupBy(*key).agg(F.max(F.col("correct").cast("int")).alias("y"))
    both = a.join(b, key).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("x") - F.col("y")) / F.count(F.lit(1))).alias("delta"),
        F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"),
    )
    return both.select(F.lit(left).alias("left_condition"), F.lit(right).alias("right_condition"), "kind", "n", "delta", "wins", "losses", "ties")


#: The chance of at most k events where one is expected, for k from 0 until it is 1 to sixteen digits.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18))


def draw(seed: int, replicate: Column, key: Column) -> Column:
    """How often a replicate draws a key: Poisson(1), from the first 13 hexadecimal digits of an MD5.

    Nothing is shuffled to draw, any engine gives the same draws, and so does every run.
    """
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), replicate.cast("string"), key.cast("string")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    weight = F.lit(0)
    for p in POISSON:
        weight = weight + F.when(u >= p, 1).otherwise(0)
    return weight


def resampled(totals: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(label, rep, x, n): the sums of x and n over sessions, each as often as draw() says; totals has label, session_id, x and n, a row a label and session.

    A session's weights are drawn once for all labels, in the task that holds it, and a task hands
    on a row for each label and replicate, so no draw is written or shuffled.
    """
    spark = totals.sparkSession
    prepare(spark)
    per = totals.groupBy(F.col("session_id").cast("string").alias("id")).agg(F.collect_list(F.struct("label", "x", "n")).alias("cells"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            ids, cells = b.column("id").to_pylist(), b.column("cells").to_pylist()
            for at in range(0, len(ids), 64):
                w = np.array([weights(seed, replicates, x) for x in ids[at : at + 64]])
                of: dict[str, np.ndarray] = {}
                for i, listed in enumerate(cells[at : at + 64]):
                    for c in listed:
                        of.setdefault(c["label"], np.zeros((2, len(w)), np.int64))[:, i] = c["x"], c["n"]
                # Sums of whole numbers below 2 to the 53rd, so exact as doubles.
                drawn = np.concatenate(list(of.values())).astype(float) @ w.astype(float)
                for i, label in enumerate(of):
                    sums[label] = sums.get(label, 0) + drawn[2 * i : 2 * i + 2].astype(np.int64)
        for label, (x, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * replicates, pa.string()), pa.array(range(1, replicates + 1), pa.int32()), pa.array(x), pa.array(n)], ["label", "rep", "x", "n"])

    # Sessions are few bytes and much work: dealt in turn, for by key they would be left in the few tasks that their bytes fill.
    parts = per.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(each, "label string, rep int, x long, n long")
    return parts.groupBy("label", "rep").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def weights(seed: int, replicates: int, session: str) -> np.ndarray:
    """draw() of a session in all replicates."""
    digests = b"".join([hashlib.md5(f"{seed}/{r}/{session}".encode(), usedforsecurity=False).digest()[:8] for r in range(1, replicates + 1)])
    return np.searchsorted(POISSON, (np.frombuffer(digests, ">u8") >> 12) / float(1 << 52), side="right")


def bootstrap(rows: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(condition, accuracy, low, high): percentile interval from resampling whole sessions with Poisson(1) weights."""
    totals = settle(session_totals(rows), "session-totals")
    drawn = resampled(totals.select(F.col("condition").alias("label"), "session_id", F.col("right").alias("x"), F.col("turns").alias("n")), replicates, seed).where("n > 0")
    ci = drawn.groupBy(F.col("label").alias("condition")).agg(F.percentile(F.col("x") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    point = totals.groupBy("condition").agg((F.sum("right") / F.sum("turns")).alias("accuracy"))
    return point.join(ci, "condition").select("condition", "accuracy", F.round(F.col("p")[0], 9).alias("low"), F.round(F.col("p")[1], 9).alias("high"))


def paired_bootstrap(rows: DataFrame, left: str, right: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(n, sessions, mean_delta, low, high, p_value, wins, losses, ties): accuracy of left less that of right on the same turns, sessions resampled whole.

    p_value is two-sided: twice the smaller share of replicates on either side of zero, at most 1.
    Without a common turn n is 0 and p_value 1.
    """
    key = ["session_id", "turn_index"]
    a = rows.where(F.col("condition") == left).select(*key, F.col("correct").cast("int").alias("x"))
    b = rows.where(F.col("condition") == right).groupBy(*key).agg(F.max(F.col("correct").cast("int")).alias("y"))
    both = settle(a.join(b, key), "paired-turns")
    per = both.groupBy("session_id").agg(F.sum(F.col("x") - F.col("y")).alias("x"), F.count(F.lit(1)).alias("n"))
    drawn = resampled(per.select(F.lit("all").alias("label"), "session_id", "x", "n"), replicates, seed).select((F.col("x") / F.greatest("n", F.lit(1))).alias("delta"))
    many = F.count(F.lit(1))
    side = F.least(F.try_divide(F.count_if(F.col("delta") <= 0), many), F.try_divide(F.count_if(F.col("delta") >= 0), many))
    ci = drawn.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.when(many > 0, F.least(F.lit(1.0), 2 * side)).alias("p_value"))
    point = both.agg(
        many.alias("n"), F.countDistinct("session_id").alias("sessions"), F.coalesce(F.try_divide(F.sum(F.col("x") - F.col("y")), many), F.lit(0.0)).alias("mean_delta"),
        F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"),
    )
    zero = F.lit(0.0)
    out = point.crossJoin(ci)  # one row each
    return out.select("n", "sessions", "mean_delta", F.coalesce(F.round(F.col("p")[0], 9), zero).alias("low"), F.coalesce(F.round(F.col("p")[1], 9), zero).alias("high"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), "wins", "losses", "ties")


def gate(rows: DataFrame, condition: str, overall: float = 0.7, each: float = 0.5) -> DataFrame:
    """(kind, n, accuracy, passed) of one condition: overall (null kind) and for each kind, in one pass."""
    out = rows.where(F.col("condition") == condition).rollup("kind").agg(F.count(F.lit(1)).alias("n"), (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"))
    return out.withColumn("passed", F.when(F.col("kind").isNull(), F.col("accuracy") >= overall).otherwise(F.col("accuracy") >= each))


def label_audit(answered: DataFrame, top: int = 6) -> DataFrame:
    """(kind, answer, n, share, rank): the commonest answers of each kind, ties to the smaller answer."""
    n = answered.groupBy("kind", F.col("gold").alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind")
    out = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "answer")).cast("long"))
    return out.where(F.col("rank") <= top)


def lookup_ladder(learned: DataFrame, scored: DataFrame, levels: list[list[str]], min_support: int = 3) -> DataFrame:
    """(session_id, turn_index, gold, guess, level): for each scored row the modal learned answer of the finest level with enough support.

    The last level answers whatever its support; ties go to the smaller answer. Guess and level are
    null where no level knows the row.
    """
    out = scored.select("session_id", "turn_index", "gold", *{c: None for lv in levels for c in lv})
    found = []
    for i, keys in enumerate(levels):
        n = learned.groupBy(*keys, "gold").agg(F.count(F.lit(1)).alias("n"))
        mode = n.groupBy(*keys).agg(F.min_by("gold", F.struct(-F.col("n"), "gold")).alias(f"_g{i}"), F.sum("n").alias(f"_n{i}"))
        out = out.join(mode, keys, "left")
        enough = F.col(f"_g{i}").isNotNull() if i == len(levels) - 1 else F.col(f"_n{i}") >= min_support
        found.append((enough, i))
    guess = F.coalesce(*[F.when(ok, F.col(f"_g{i}")) for ok, i in found])
    level = F.coalesce(*[F.when(ok, F.lit(i)) for ok, i in found]).cast("long")
    return out.select("session_id", "turn_index", "gold", guess.alias("guess"), level.alias("level"))
