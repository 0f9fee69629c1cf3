"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents in doc_id order. In round r source s has earned
floor(r * Q_s) tokens, Q_s = share_s * window being its quantum, and serves what it has earned and
not yet served: the fraction of a token it may not cut is the deficit it carries on. A source that
earns less than MIN_SEGMENT tokens a round is served every k-th round only, and carries what it
earns between; such sources take turns. Documents are cut wherever a round's service ends, so every
round holds every source's share and its ``window`` tokens fill one sequence, up to fractions.

A queue's service up to round r is a closed form, so the schedule needs no loop: the place of a
token in its queue names its round, the packed stream is the segments in the order (round, source,
place in queue), and its running total gives every segment's place. Deficits so carry across
windows and partitions exactly. The stream is cut every ``window`` tokens: only the last sequence
is padded.

Running totals are taken in blocks (see running_total), so a source that holds most rows is spread
over as many tasks as any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import tokens

WINDOW = 1024
#: A source is served when it has earned this many tokens, every k-th round.
MIN_SEGMENT = 16
EOS_ID = 0


def tokenized(docs: DataFrame, tokenizer_path: str, eos_id: int = EOS_ID) -> DataFrame:
    """(doc_id, source, n_tokens, ids): ids as little-endian unsigned 32-bit numbers, eos_id last."""
    C.prepare(docs.sparkSession)
    end = np.array([eos_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(tokens.bpe_bytes(t, tokenizer_path) + end, "<u4") for t in b.column(2).to_pylist()]
            small = [x.astype("<u2") if len(x) and x.max() < 1 << 16 else x for x in ids]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in small], pa.binary())], names=["doc_id", "source", "n_tokens", "ids"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(each, "doc_id long, source string, n_tokens long, ids binary")


def round_robin(meta: DataFrame, window: int, min_segment: int, shares: dict[str, float] | None) -> DataFrame:
    """(_row, source, start, length, position) of each segment: position is its place in the packed stream.

    shares: target token proportions by source; by default those of the tokens at hand, so that all
    queues last to the end. A source without a share gets the smallest share named. A queue that
    runs dry leaves its place to the others, whose relative proportions stay.
    """
    queued = C.running_total(meta, ["source"], ["doc_id", "_row"], "n_tokens", "_ahead", "pack-queues")
    totals = meta.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("_share"))
    if shares:
        least = min(shares.values())
        named = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        totals = totals.withColumn("_share", F.coalesce(named[F.coalesce("source", F.lit(""))], F.lit(float(least))))
        quantum = F.col("_share") * F.lit(float(window))
    else:
        total = meta.agg(F.sum("n_tokens")).first()[0] or 1
        quantum = F.col("_share") * F.lit(float(window) / total)
    totals = totals.select(F.col("source").alias("_source"), F.greatest(quantum, F.lit(1e-6)).alias("_quantum"))
    every = F.greatest(F.ceil(F.lit(float(min_segment)) / F.col("_quantum")), F.lit(1)).cast("long")
    totals = totals.withColumn("_every", every).withColumn("_turn", F.pmod(F.xxhash64("_source"), F.col("_every")))
    served = queued.join(totals, F.col("source").eqNullSafe(F.col("_source")))

    def earned(visit):  # tokens served up to a visit; the visit's round is visit * every - turn
        return F.floor(F.greatest(visit * F.col("_every") - F.col("_turn"), F.lit(0)).cast("double") * F.col("_quantum")).cast("long")

    at = lambda place: F.floor((F.col("_ahead") + place).cast("double") / (F.col("_quantum") * F.col("_every"))).cast("long")
    # Visits whose service may touch the document: one more on either side covers turns and rounding.
    visits = F.explode(F.sequence(F.greatest(at(F.lit(0)) - 1, F.lit(0)), at(F.col("n_tokens")) + 3))
    begin, end = F.greatest(F.col("_ahead"), earned(F.col("_visit") - 1)), F.least(F.col("_ahead") + F.col("n_tokens"), earned(F.col("_visit")))
    parts = (
        served.withColumn("_visit", visits)
        .withColumn("start", begin - F.col("_ahead"))
        .withColumn("length", end - begin)
        .where("length > 0")
        .select("_row", "source", "start", "length", (F.col("_visit") * F.col("_every") - F.col("_turn")).alias("_round"), (F.col("_ahead") + F.col("start")).alias("_place"))
    )
    return C.running_total(parts, [], ["_round", "source", "_place", "_row"], "length", "position", "pack-stream").select("_row", "source", "start", "length", "position")


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    min_segment: int = MIN_SEGMENT,
    shares: dict[str, float] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is its token ids and one end id; a null or empty text is the end id alone. Every id
    of every row lies in exactly one piece, repeated rows and null ids or sources included (rows are
    told apart by a row number of their own). with_ids adds the ids of the piece. An empty table
    gives no pieces. Other columns of docs are ignored.
    """
    path = tokenizer_path or tokens.default_path()
    toks = C.materialize(tokenized(docs, path).withColumn("_row", F.monotonically_increasing_id()), "pack-tokens")
    segments = round_robin(toks.select("_row", "doc_id", "source", "n_tokens"), window, min_segment, shares)
    w = F.lit(window).cast("long")
    first, last = F.floor(F.col("position") / w), F.floor((F.col("position") + F.col("length") - 1) / w)
    cut = segments.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("position"), F.col("sequence_id") * w)
    end = F.least(F.col("position") + F.col("length"), (F.col("sequence_id") + 1) * w)
    piece = F.struct((F.col("start") + begin - F.col("position")).alias("start"), (end - begin).alias("length"), F.col("sequence_id"), (begin - F.col("sequence_id") * w).alias("offset"))
    lists = cut.groupBy("_row").agg(F.collect_list(piece).alias("pieces"))
    joined = toks.join(lists, "_row").select("doc_id", "source", "n_tokens", "ids", "pieces")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, flat = pc.list_value_length(b.column(4)).to_numpy(), b.column(4).flatten()
            own = pa.array(np.repeat(np.arange(b.num_rows), count))
            long = {k: pc.struct_field(flat, k) for k in ("start", "length", "sequence_id", "offset")}
            begin = long["start"].to_numpy() * 4
            stop = begin + long["length"].to_numpy() * 4
            crc, ids, at = [], [], 0
            for n, raw, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), count.tolist(), strict=True):
                x = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes())
                parts = [x[s:e] for s, e in zip(begin[at : at + k].tolist(), stop[at : at + k].tolist(), strict=True)]
                crc += map(zlib.crc32, parts)
                if with_ids:
                    ids += [np.frombuffer(p, "<u4").astype(np.int64) for p in parts]
                at += k
            cols = {"doc_id": b.column(0).take(own), "start": long["start"], "length": long["length"], "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": b.column(2).take(own), "sequence_id": long["sequence_id"], "offset": long["offset"], "source": b.column(1).take(own)}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.record_batch(list(cols.values()), names=list(cols))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<long>" * with_ids
    return joined.mapInArrow(each, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1_mixture_packing over the whole documents table."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
