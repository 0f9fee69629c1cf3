"""Filling quotas over a distributed table: as level over the cells of a group as their sizes allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered, settle

#: Kinds of question that are answered yes or no.
YES_NO = ("reachability", "cycle_membership", "edge_exists", "link_prediction", "constrained_reachability", "attribute_check")


def _numbered_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with its rows numbered from 0 within keys, in a total order; no task sees more than a range, however many rows a key has."""
    no = numbered(df, [*keys, *order], "_all")
    first = no.groupBy(*keys).agg(F.min("_all").alias("_first"))
    return no.join(first, keys).withColumn(out, F.col("_all") - F.col("_first")).drop("_all", "_first")


def levels(sizes: DataFrame, needs: DataFrame, group: list[str]) -> DataFrame:
    """(group, level, rest): how many rows every cell gives, as far as it has them, and how many cells give one more.

    sizes (group, cell, n) are the cells, needs (group, need) what is wanted. Cells of one size
    count together, so a group of N rows has at most the square root of 2 N steps to climb.
    """
    steps = sizes.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("cells"))
    by = Window.partitionBy(*group).orderBy("n")
    below = by.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*group, "n", F.coalesce(F.sum(F.col("n") * F.col("cells")).over(below), F.lit(0)).alias("full"), F.sum("cells").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("left"), F.coalesce(F.lag("n").over(by), F.lit(0)).alias("base"))
    # Up to base all is filled; from there left cells rise together to n.
    steps = steps.join(needs, group).withColumn("filled", F.col("full") + F.col("base") * F.col("left")).where("filled <= need")
    top = steps.groupBy(*group).agg(F.max_by(F.struct("base", "filled", "left", "n", "need"), "n").alias("t")).select(*group, "t.*")
    more = F.floor((F.col("need") - F.col("filled")) / F.col("left"))
    level = F.least(F.col("base") + more, F.col("n"))
    over = F.when(level == F.col("n"), F.lit(0)).otherwise(F.col("need") - F.col("filled") - more * F.col("left"))
    return top.select(*group, level.cast("long").alias("level"), over.cast("long").alias("rest"))


def level_fill(df: DataFrame, group: list[str], cell: str, order: list[str], needs: DataFrame) -> DataFrame:
    """Of the rows of each group as many as needs (group, need) says, all if it has fewer, none if it isn't named.

    Cells give in turn, each its first row in order, then its second, and so on; in the last turn
    the smaller values of cell go first. Order has to tell the rows of a cell apart. Nulls in group
    or cell belong to no cell: such rows are not taken.
    """
    df = settle(df.dropna(subset=[*group, cell]), "quota-rows")
    sizes = settle(df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("n")), "quota-cells")
    level = settle(levels(sizes, needs, group), "quota-levels")
    taller = _numbered_within(sizes.join(level, group).where("n > level and rest > 0"), group, [cell], "_turn")
    share = sizes.join(level, group).join(taller.select(*group, cell, "_turn"), [*group, cell], "left")
    share = share.select(*group, cell, (F.col("level") + F.coalesce((F.col("_turn") < F.col("rest")).cast("long"), F.lit(0))).alias("_share"))
    return _numbered_within(df, [*group, cell], order, "_rank").join(share, [*group, cell]).where("_rank < _share").select(*df.columns)


def seeded(seed: int, *identity: str) -> Column:
    """An order by chance, the same on every run and in SQL."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))


def changed_quota(answers: DataFrame, percent: int = 45, seed: int = 0) -> DataFrame:
    """(session_id, turn_index, kind, gold, stale, changed): turns chosen so that percent of each kind's have an answer that their edit changed.

    answers has session_id, turn_index, kind, gold and stale. Of the changed and the unchanged turns
    the side that is short of its share stays whole and the other is cut to fit, rounded down; a
    kind that has one side only stays as it is. Within a side answers are filled level. In kinds
    answered yes or no the changed turns have as many of either, so asking for changes favours none.
    """
    a = answers.where("kind is not null and gold is not null and stale is not null").select("session_id", "turn_index", "kind", "gold", "stale", (F.col("gold") != F.col("stale")).alias("changed"))
    a = settle(a.withColumn("_by", seeded(seed, "session_id", "turn_index")), "quota-answers")
    n = a.groupBy("kind").agg(F.count_if("changed").alias("c"), F.count_if(~F.col("changed")).alias("u"), F.count_if(F.col("changed") & (F.col("gold") == "yes")).alias("yes"), F.count_if(F.col("changed") & (F.col("gold") == "no")).alias("no"))
    n = n.withColumn("c", F.when(F.col("kind").isin(*YES_NO), 2 * F.least("yes", "no")).otherwise(F.col("c")))
    either = (F.col("c") == 0) | (F.col("u") == 0)
    fit = lambda side, other, own, rest: F.when(either, F.col(side)).otherwise(F.least(F.col(side), F.floor(F.col(other) * own / rest)))
    both = F.array(F.struct(F.lit(True).alias("changed"), fit("c", "u", percent, 100 - percent).cast("long").alias("need")), F.struct(F.lit(False).alias("changed"), fit("u", "c", 100 - percent, percent).cast("long").alias("need")))
    needs = settle(n.select("kind", F.explode(both).alias("x")).select("kind", "x.*"), "quota-needs")
    return level_fill(a, ["kind", "changed"], "gold", ["_by", "session_id", "turn_index"], needs).drop("_by")
