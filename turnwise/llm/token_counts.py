"""Delta-maintained token rollups by source, language and tokenizer version.

A change feed carries before and after images: an insert has only an after image, a delete only a
before image, a revision both. Each image becomes a signed row, +1 or -1 times its document and its
tokens. A batch is summed to one row per key and written as the folder of its batch id; totals are
the sums over all committed folders. A folder counts once its success marker stands, a batch that
is sent again is skipped, and one that broke off is overwritten, so commits are idempotent.
Additive totals need no ledger of documents and no ordering between batches.

compact() folds committed batches into a snapshot, which names the batches it holds, so that the
state does not grow with its history and a batch that is sent again later is still skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from . import tokens

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions: a byte-level BPE vocabulary and runs of characters other than white space.
VERSIONS = ("byte_bpe_50k", "spaced_words_v1")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counted(docs: DataFrame, bpe_path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): a row per document and tokenizer version.

    A null or empty text counts 0 tokens; null ids, sources and languages pass through, repeated
    rows repeat, an empty table gives no rows and other columns are ignored.
    """
    C.prepare(docs.sparkSession)
    path = bpe_path or tokens.default_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            for version, count in ((VERSIONS[0], lambda t: len(tokens.bpe_ids(t, path))), (VERSIONS[1], lambda t: sum(1 for _ in _WORDS.finditer(t or "")))):
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([version] * len(texts), pa.string()), pa.array([count(t) for t in texts], pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]]
    return docs.select(*cols).mapInArrow(each, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of a feed with struct columns before and after, each (source, lang, tokenizer, n_tokens) or null."""
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("image")))
    rows = changes.select(F.explode(both).alias("x")).where("x.image is not null")
    return rows.select(*[F.col(f"x.image.{k}").alias(k) for k in KEYS], F.col("x.sign").cast("long").alias("n_docs"), (F.col("x.sign") * F.coalesce(F.col("x.image.n_tokens"), F.lit(0))).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """A feed that inserts every row of counts."""
    image = F.struct(*KEYS, "n_tokens")
    return counts.select(F.lit(None).cast(_IMAGE).alias("before"), image.cast(_IMAGE).alias("after"))


def deletes(counts: DataFrame) -> DataFrame:
    """A feed that deletes every row of counts."""
    image = F.struct(*KEYS, "n_tokens")
    return counts.select(image.cast(_IMAGE).alias("before"), F.lit(None).cast(_IMAGE).alias("after"))


_IMAGE = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("n_tokens", T.LongType())])


_TOTALS = T.StructType([*_IMAGE.fields[:3], T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
_HELD = T.StructType([*_TOTALS.fields, T.StructField("batches", T.ArrayType(T.LongType()))])


def _snapshot(spark: SparkSession, state_dir: str) -> tuple[int, str | None]:
    """The number and folder of the newest whole snapshot: (0, None) without one."""
    n = 0
    while C.exists(spark, f"{state_dir}/snapshot={n + 1}/_SUCCESS"):
        n += 1
    return n, f"{state_dir}/snapshot={n}" if n else None


def _held(spark: SparkSession, state_dir: str) -> set[int]:
    """The batches that the newest snapshot holds."""
    _, folder = _snapshot(spark, state_dir)
    rows = spark.read.schema(_HELD).parquet(folder).where("batches is not null").select("batches").collect() if folder else []
    return {b for r in rows for b in r["batches"]}


def commit(spark: SparkSession, state_dir: str, batch_id: int, changes: DataFrame) -> bool:
    """Add a batch to the state; False, and nothing done, if that batch is already committed."""
    folder = f"{state_dir}/batch={int(batch_id)}"
    if C.exists(spark, f"{folder}/_SUCCESS") or int(batch_id) in _held(spark, state_dir):
        return False
    sums = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.write.mode("overwrite").parquet(folder)
    return True


def _sums(spark: SparkSession, state_dir: str, batches: list[int]) -> DataFrame:
    """Totals of the snapshot and of those of the batches that it does not hold."""
    _, folder = _snapshot(spark, state_dir)
    held = _held(spark, state_dir)
    done = [f"{state_dir}/batch={b}" for b in sorted(set(batches) - held) if C.exists(spark, f"{state_dir}/batch={b}/_SUCCESS")]
    paths = [*[folder] * bool(folder), *done]
    rows = spark.read.schema(_TOTALS).parquet(*paths) if paths else spark.createDataFrame([], _TOTALS)
    return rows.where("n_docs is not null").groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def totals(spark: SparkSession, state_dir: str, batches: list[int]) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) over the snapshot, if there is one, and the given committed batches; keys that net to nothing go.

    Null sources and languages are keys of their own. No batches, or none committed, give no rows.
    """
    return _sums(spark, state_dir, batches)


def compact(spark: SparkSession, state_dir: str, batches: list[int]) -> int:
    """Write the totals over the given committed batches as the next snapshot and return its number.

    The snapshot counts once its success marker stands, and only then the folders that it holds are
    deleted, so a compaction that breaks off loses nothing and can be repeated. Older snapshots stay.
    """
    n, _ = _snapshot(spark, state_dir)
    done = [b for b in sorted(set(batches)) if C.exists(spark, f"{state_dir}/batch={b}/_SUCCESS")]
    held = sorted({*done, *_held(spark, state_dir)})
    names = spark.createDataFrame([(None, None, None, None, None, held)], _HELD)
    rows = _sums(spark, state_dir, batches).withColumn("batches", F.lit(None).cast(T.ArrayType(T.LongType()))).unionByName(names)
    rows.write.mode("overwrite").parquet(f"{state_dir}/snapshot={n + 1}")
    for b in done:
        C.delete(spark, f"{state_dir}/batch={b}")
    return n + 1


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3_token_counts: batch 0 inserts all documents, batch 1 takes down those labelled low
    quality, batch 2 gives those labelled toxic the source ``quarantine`` (a revision: before and
    after image). Batches 0 and 1 are folded into a snapshot, and batch 0 is sent again, which must change
    nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counts = C.materialize(counted(docs), "token-counts")
    state = f"{C.table_dir(spark)}/token-state-{counts._turnwise_path.rpartition('-')[2]}"
    down = counts.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    moved = counts.join(labels.where("toxic = 1 and (quality is null or quality <> 0)").select("doc_id"), "doc_id", "left_semi")
    image = F.struct(*KEYS, "n_tokens").cast(_IMAGE)
    shifted = F.struct(F.lit("quarantine").alias("source"), "lang", "tokenizer", "n_tokens").cast(_IMAGE)
    commit(spark, state, 0, inserts(counts))
    commit(spark, state, 1, deletes(down))
    compact(spark, state, [0, 1])
    commit(spark, state, 2, moved.select(image.alias("before"), shifted.alias("after")))
    commit(spark, state, 0, inserts(counts))
    return totals(spark, state, [0, 1, 2])
