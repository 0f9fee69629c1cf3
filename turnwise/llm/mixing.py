"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

A document may belong to several sources. Documents are added up by the set of their sources, the
pattern; a pattern supplies its words once at no repetition, once more as a second copy, and so on,
each copy dearer than the one before. Sources demand quotas. Words flow from patterns to any of
their sources so that the quotas are met as far as they can be, at the least total cost: as costs
lie on the patterns' supply alone and rise with the copy, a flow that is greatest with first copies
stays while second copies extend it, so each copy is one maximum flow that goes on from the last.

Quotas are a water level: sources share a budget by weight, no source over a number of copies of
what it has. The level is found from running totals over the sources by size for weight. Patterns
that share no source are separate networks, so each connected group of sources is solved by itself,
and only sums by pattern enter it. Within a pattern documents stand in a seeded order; the words
that flow to a source are a stretch of the pattern's copies, laid end to end, and a document takes
what it has in that stretch. Only documents at the ends of stretches are taken in part, so that
sources meet their quotas to the word.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import numbered
from . import _common as C

WEIGHTS = (5, 2, 1)
BUDGET, COPIES, SEED = 1.5, 2, 7
WORD = r"[^\x20\x09-\x0D]+"


def routed(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], copies: int) -> dict[tuple[int, str], int]:
    """Words from each pattern, by its place, to each source: maximum flow at least repetition cost.

    One maximum flow for each copy, by shortest augmenting levels, over the residual network that
    the copies before left. Places and names are visited in order, so reruns agree.
    """
    flow = {(p, s): 0 for p, (members, _) in enumerate(patterns) for s in members}
    room = dict(quotas)
    holders: dict[str, list[int]] = {}
    for p, s in flow:
        holders.setdefault(s, []).append(p)
    for _ in range(copies):
        supply = [words for _, words in patterns]
        while True:
            # Levels from all patterns with supply; sources reach patterns whose flow they can give back.
            level: dict[int | str, int] = {p: 0 for p in range(len(patterns)) if supply[p] > 0}
            queue, found = deque(level), False
            while queue:
                x = queue.popleft()
                onward = patterns[x][0] if isinstance(x, int) else [p for p in holders.get(x, ()) if flow[p, x] > 0]
                for y in onward:
                    if y not in level:
                        level[y] = level[x] + 1
                        queue.append(y)
                        found |= isinstance(y, str) and room.get(y, 0) > 0
            if not found:
                break
            used: dict[int | str, int] = {}
            for start in [p for p in range(len(patterns)) if supply[p] > 0]:
                path: list[int | str] = [start]
                while path and supply[start] > 0:
                    x = path[-1]
                    if isinstance(x, str) and room.get(x, 0) > 0:
                        steps = list(zip(path[:-1], path[1:], strict=True))
                        push = min([supply[start], room[x], *[flow[b, a] for a, b in steps if isinstance(b, int)]])
                        for a, b in steps:
                            if isinstance(b, str):
                                flow[a, b] += push
                            else:
                                flow[b, a] -= push
                        supply[start] -= push
                        room[x] -= push
                        path = [start]
                        continue
                    onward = patterns[x][0] if isinstance(x, int) else holders.get(x, ())
                    i = used.get(x, 0)
                    while i < len(onward) and not (level.get(onward[i], -1) == level[x] + 1 and (isinstance(x, int) or flow[onward[i], x] > 0)):
                        i += 1
                    used[x] = i
                    if i < len(onward):
                        path.append(onward[i])
                    else:
                        path.pop()
                        if path:
                            used[path[-1]] = used.get(path[-1], 0) + 1
    return {k: v for k, v in flow.items() if v}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A name that is never null and keeps the order of code points: null is the empty one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, copies: int) -> DataFrame:
    """(source, source_size, target) from (source key, source_size): the sources in order get the weights, repeating, and share the budget.

    budget: words in all. A source gets level * weight, at most copies * source_size.
    """
    keyed = numbered(sizes.withColumn("_null", (F.col("source") == "").cast("int")), ["_null", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = keyed.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * copies).withColumn("_ratio", F.col("_most") / F.col("_weight"))
    filled = C.running_total(ranked, [], ["_ratio", "_rank"], "_most", "_filled", "mix-filled")
    filled = C.running_total(filled, [], ["_ratio", "_rank"], "_weight", "_taken", "mix-weights")
    filled = C.materialize(filled, "mix-level")
    total = ranked.agg(F.sum("_weight")).first()[0] or 0
    # The level is set by the first source, by ratio, that it does not fill.
    open_ = filled.where(F.col("_ratio") > (F.lit(budget) - F.col("_filled")) / (F.lit(total) - F.col("_taken"))).orderBy("_ratio", "_rank").select("_filled", "_taken", "_ratio", "_rank").limit(1).collect()
    if open_:
        at = open_[0]
        above = (F.col("_ratio") > F.lit(at._ratio)) | ((F.col("_ratio") == F.lit(at._ratio)) & (F.col("_rank") >= F.lit(at._rank)))
        target = F.when(above, F.col("_weight") * F.lit(budget - at._filled) / F.lit(total - at._taken)).otherwise(F.col("_most").cast("double"))
    else:
        target = F.col("_most").cast("double")
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def _solve(copies: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pattern", "quota"])
        supply = rows[rows.quota.isna()]
        quotas = {m[0]: int(q) for m, q in zip(rows.members[rows.quota.notna()], rows.quota[rows.quota.notna()], strict=True)}
        flow = routed([(tuple(m), int(w)) for m, w in zip(supply.members, supply.words, strict=True)], quotas, copies)
        names = supply.pattern.tolist()
        return pd.DataFrame([(names[p], s, v) for (p, s), v in flow.items()], columns=["pattern", "source", "flow"])

    return each


def mix(
    docs: DataFrame,
    members: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    copies: int = COPIES,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, members, size, taken, parts) for every row of docs; parts: words by source, as (source, source_size, target, taken).

    members: the array of a document's sources; by default the column source alone. A null source is
    one source, the last in order; a null or empty array is that source. budget: the words to take
    in all, as a multiple of the words there are. copies: a document is taken that often at most.
    Texts that are null or have no word have size 0 and are taken 0 times. Rows of one doc_id are
    rows of their own. A quota that the documents of a source can't fill, as they also fill others,
    is filled as far as it can be. An empty table gives no rows. Other columns are ignored. Reruns
    over the same rows agree (rows alike in doc_id stand in the order of the files).
    """
    C.prepare(docs.sparkSession)
    given = F.array(F.col("source")) if members is None else members
    given = F.when(given.isNull() | (F.size(given) == 0), F.array(F.lit(None).cast("string"))).otherwise(given)
    keys = F.array_sort(F.array_distinct(F.transform(given, source_key)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), keys.alias("members"), word_count(F.col("text").cast("string")).alias("size"))
    rows = rows.withColumn("pattern", F.to_json("members")).withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = C.materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-documents")
    patterns = C.materialize(rows.groupBy("pattern", "members").agg(F.sum("size").alias("words")), "mix-patterns")
    sizes = patterns.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    total = patterns.agg(F.sum("words")).first()[0] or 0
    goals = C.materialize(targets(sizes, weights, budget * total, copies), "mix-targets")

    shared = patterns.where(F.size("members") > 1).select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, F.size("members") - 1)).alias("b"))
    groups = C.connected_components(shared, "mix-groups")
    network = patterns.select("pattern", "members", "words", F.lit(None).cast("double").alias("quota"))
    network = network.unionByName(goals.select(F.lit("").alias("pattern"), F.array("source").alias("members"), F.lit(0).cast("long").alias("words"), F.floor(F.col("target") + 0.5).cast("double").alias("quota")))
    network = network.join(groups.withColumnRenamed("node", "_node"), F.col("members")[0] == F.col("_node"), "left").withColumn("group", F.coalesce("component", F.col("members")[0])).drop("_node", "component")
    flow = network.groupBy("group").applyInPandas(_solve(copies), "pattern string, source string, flow long")
    flow = C.materialize(flow, "mix-flow")

    # A pattern's copies, end to end, are cut into one stretch for each of its sources.
    cut = F.expr("""aggregate(flows, cast(array() as array<struct<source:string, begin:bigint, end:bigint>>), (done, x) ->
        concat(done, array(named_struct('source', x.source, 'begin', coalesce(try_element_at(done, -1).end, 0L), 'end', coalesce(try_element_at(done, -1).end, 0L) + x.flow))))""")
    stretches = flow.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("source", "flow"))).alias("flows"))
    facts = F.map_from_entries(F.collect_list(F.struct(F.col("source"), F.struct("source_size", "target"))))
    known = patterns.select("pattern", F.explode("members").alias("source"), "words").join(goals, "source").groupBy("pattern", "words").agg(facts.alias("facts"))
    known = known.join(stretches.select("pattern", cut.alias("stretches")), "pattern", "left")
    known = C.materialize(known, "mix-known")

    placed = C.running_total(rows.select("_row", "doc_id", "members", "pattern", "order", "size"), ["pattern"], ["order", "doc_id", "_row"], "size", "ahead", "mix-order")
    joined = placed.join(known.withColumnRenamed("pattern", "_pattern"), F.col("pattern") == F.col("_pattern"))

    def took(source: Column) -> Column:
        own = F.filter(F.coalesce("stretches", F.array().cast("array<struct<source:string,begin:bigint,end:bigint>>")), lambda x: x["source"] == source)
        begin, end = F.coalesce(F.get(own, F.lit(0))["begin"], F.lit(0)), F.coalesce(F.get(own, F.lit(0))["end"], F.lit(0))
        out = F.lit(0).cast("long")
        for r in range(copies):
            at = F.col("words") * r + F.col("ahead")
            out += F.greatest(F.lit(0).cast("long"), F.least(at + F.col("size"), end) - F.greatest(at, begin))
        return out

    part = lambda s: F.struct(F.when(s != "", F.substring(s, 2, 1 << 30)).alias("source"), F.col("facts")[s]["source_size"].alias("source_size"), F.col("facts")[s]["target"].alias("target"), took(s).alias("taken"))
    out = joined.select("doc_id", F.transform("members", lambda s: F.when(s != "", F.substring(s, 2, 1 << 30))).alias("members"), "size", F.transform("members", part).alias("parts"))
    return out.select("doc_id", "members", "size", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["taken"]).alias("taken"), "parts")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13_source_mix over the whole documents table; a document has one source."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", F.col("parts")[0]["source_size"].alias("source_size"), F.col("parts")[0]["target"].alias("target"), "taken")


#: The same for documents of one source each, by windows: a source's flow is its own quota.
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, {COPIES} * source_size AS most, rank,
    CASE rank % {len(WEIGHTS)} {" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))} END AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)),
f AS (
  SELECT *, most / weight AS ratio,
    CAST(coalesce(sum(most) OVER before, 0) AS BIGINT) AS filled,
    CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS gone,
    CAST(sum(weight) OVER () AS BIGINT) AS weights, {BUDGET} * CAST(sum(source_size) OVER () AS DOUBLE) AS budget
  FROM w WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT filled AS at_filled, gone AS at_gone, ratio AS at_ratio, rank AS at_rank FROM f WHERE ratio > (budget - filled) / (weights - gone) ORDER BY ratio, rank LIMIT 1),
t AS (
  SELECT f.source, source_size,
    CASE WHEN at_rank IS NOT NULL AND (ratio > at_ratio OR (ratio = at_ratio AND rank >= at_rank)) THEN weight * CAST(budget - at_filled AS DOUBLE) / (weights - at_gone) ELSE CAST(most AS DOUBLE) END AS target
  FROM f LEFT JOIN o ON TRUE),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST({" + ".join(f"greatest(0, least(size, quota - {r} * source_size - ahead))" for r in range(COPIES))} AS BIGINT) AS taken
FROM p
"""
