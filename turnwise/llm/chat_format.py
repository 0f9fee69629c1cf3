"""Multi-party perspective rotation of conversations.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; system turns stay as they are and speak for nobody. The
mask marks the characters to train on: the assistant's turns, text and end marker, not headers.

Turns are numbered with block-wise running totals and rendered in parts of ``part_turns`` turns, so
that a conversation of any length is spread over tasks and never gathered whole; ``part`` numbers
them, and joining the parts of a perspective in order gives the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

PART_TURNS = 64
END = "<|end|>\n"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask, target_chars) from (conv_id, turn, role, text).

    mask lists the trained spans of text as "begin-end" in characters, joined by commas. Turns
    stand in the order (turn, role, text), null turn numbers last; repeated rows are said twice. A
    null role is the participant ``unknown``, a null text is empty, rows with a null conv_id form
    one conversation. A conversation of system turns alone has no participant and gives no rows.
    """
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit((1 << 62))).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = C.materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "chat-turns")
    numbered = C.running_total(said.select("conv_id", "turn", "role", "text", "_row", F.lit(1).cast("long").alias("_one")), ["conv_id"], ["turn", "role", "text", "_row"], "_one", "nth", "chat-order")
    people = C.materialize(said.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct(), "chat-people")
    each = numbered.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.col("role") == F.col("perspective")
    header = F.when(F.col("role") == "system", F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    piece = F.struct("nth", header.alias("header"), F.concat("text", F.lit(END)).alias("body"), own.alias("own"))
    parts = each.groupBy("conv_id", "perspective", F.floor(F.col("nth") / part_turns).alias("part")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.length(p.header) + F.length(p.body))
    begins = F.transform("pieces", lambda p, i: F.aggregate(F.slice(F.col("sizes"), 1, i), F.lit(0), lambda a, x: a + x) + F.length(p.header))
    spans = F.transform(F.filter(F.arrays_zip("pieces", "begins"), lambda x: x.pieces.own), lambda x: F.concat(x.begins.cast("string"), F.lit("-"), (x.begins + F.length(x.pieces.body)).cast("string")))
    return parts.withColumn("sizes", sizes).withColumn("begins", begins).select(
        "conv_id",
        "perspective",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p.header, p.body)), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.when(p.own, F.length(p.body)).otherwise(0).cast("long")).alias("target_chars"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8_perspective_rotation over the whole conversations table."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
with t as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by coalesce(turn, 4611686018427387904), coalesce(role, 'unknown'), coalesce(text, '')) - 1 as nth
  from conversations
), p as (
  select distinct conv_id, role as perspective from t where role <> 'system'
), x as (
  select t.conv_id, p.perspective, nth // 64 as part, nth, role = perspective as own,
         case when role = 'system' then '<|system|>' || chr(10)
              when role = perspective then '<|assistant|>' || chr(10)
              else '<|user name=' || role || '|>' || chr(10) end as header,
         text || '<|end|>' || chr(10) as body
  from t join p on t.conv_id is not distinct from p.conv_id
), y as (
  select *, sum(length(header) + length(body)) over (partition by conv_id, perspective, part order by nth)
            - length(body) as b
  from x
)
select conv_id, perspective, cast(part as bigint) as part, count(*) as n_turns,
       string_agg(header || body, '' order by nth) as text,
       coalesce(string_agg(case when own then cast(b as bigint) || '-' || cast(b + length(body) as bigint) end, ',' order by nth), '') as mask,
       cast(sum(case when own then length(body) else 0 end) as bigint) as target_chars
from y group by conv_id, perspective, part
"""
