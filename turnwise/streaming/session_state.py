"""Session state kept up to date from a stream of edits.

SET, ADD and DEL are idempotent, so a session's state is the last operation on each key: one
streaming aggregation, whose state Spark keeps by session and key and checkpoints in the shared
folder. The same plan over a table gives the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_operations(edits: DataFrame) -> DataFrame:
    """(session_id, key, on, turn_index): the last operation on every node or pair that a session has touched.

    edits has session_id, turn_index, op, a, lo and hi. key is ``n:node`` for a SET, ``e:lo-hi`` for an
    ADD or DEL; on is whether the node is open or the pair joined. NOOP and null operations touch
    nothing. An edit that comes late or twice changes nothing that a later turn has set.
    """
    node, pair = F.col("op").isin("SET_OPEN", "SET_CLOSED"), F.col("op").isin("ADD", "DEL")
    key = F.when(node, F.concat(F.lit("n:"), F.col("a"))).when(pair, F.concat(F.lit("e:"), F.col("lo"), F.lit("-"), F.col("hi")))
    keyed = edits.select("session_id", "turn_index", key.alias("key"), F.col("op").isin("SET_OPEN", "ADD").alias("on")).where("key is not null")
    last = keyed.groupBy("session_id", "key").agg(F.max(F.struct("turn_index", "on")).alias("last"))
    return last.select("session_id", "key", "last.on", "last.turn_index")


def late_edits(edits: DataFrame, event_time: str, delay: str) -> DataFrame:
    """edits with a watermark, repeats of one session's turn within the delay dropped."""
    return edits.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["session_id", "turn_index"])


def keep_state(edits: DataFrame, checkpoint: str, upsert, trigger: dict | None = None) -> StreamingQuery:
    """Run last_operations on a stream; upsert(rows, batch_id) gets the keys that changed in each batch.

    A batch may be sent again after a failure, with the same batch_id: upserts by (session_id, key)
    are idempotent.
    """
    out = last_operations(edits).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return out.foreachBatch(upsert).trigger(**(trigger or {"availableNow": True})).start()
