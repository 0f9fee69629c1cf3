"""Line dedup by a deletion-neighbourhood join.

Lines are compared after trimming; those under ``min_chars`` characters are left alone. A line is
dropped if an earlier line, in the order (doc_id, hash of the text, line number), equals it or is
one edit away (insertion, deletion or substitution of one character).

Deleting each character in turn gives a line's deletion neighbourhood. Two lines of equal length
are a substitution apart exactly if they share a variant with the same place deleted; two lines are
an insertion apart exactly if one is a variant of the other. Variants are joined as 128-bit hashes
with the place in the key, so every member of a key is within one edit of every other, and each
only has to look at the earliest: no pairs are formed, however many lines share a key. The edit
distance of a line and the earlier one it met is then verified on the lines themselves.

Variants of all lines would be as many as the characters of the corpus. A line is cut into PIECES
pieces, and an edit leaves all of them but one untouched. So lines are first filed under what each
piece leaves over (for both lengths that a partner may agree on), and only a line that shares such
a remainder with a different line spells out its variants, and of these only the ones with a place
of that piece deleted. This loses nothing: it is the pigeonhole rule on pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MIN_CHARS, PIECES = 20, 3
_LINE_SCHEMA = "ha long, hb long, doc_id long, text_hash long, line int, rests array<long>"
#: A line is named by its document, told from others of the same id by its text, and its number.
_AT = ["doc_id", "text_hash", "line"]


def _hash128(data: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(data)
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _slots(n: int) -> list[tuple[int, int, int, int]]:
    """(key seed, characters before the piece, characters after it, last place in it) for a line of n characters.

    The first PIECES slots are for partners of n characters or one more, the others for those of one
    fewer: the piece then has one character more than the partner's.
    """
    out = []
    for m in (n, n - 1):
        for q in range(PIECES):
            begin, end = m * q // PIECES, m * (q + 1) // PIECES
            out.append((m * PIECES + q, begin, m - end, end - (m == n)))
    return out


def _rest_keys(line: str) -> list[int]:
    """Hashes of what is left of a line without each of its pieces."""
    import xxhash

    out = []
    for seed, before, after, _ in _slots(len(line)):
        rest = line[:before] + "\n" + line[len(line) - after :]
        x = xxhash.xxh3_64_intdigest(rest.encode("utf-8", "surrogatepass"), seed)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text is not None else []


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of the rows whose lines are compared."""
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def compared_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(ha, hb, doc_id, text_hash, line, rests) of every line long enough to be compared."""
    C.prepare(docs.sparkSession)
    names = ["ha", "hb", "doc_id", "text_hash", "line", "rests"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for no, raw in enumerate(lines_of(t)):
                    line = raw.strip()
                    if len(line) >= min_chars:
                        for c, x in zip(cols, (*_hash128(line.encode("utf-8", "surrogatepass")), i, h, no, _rest_keys(line)), strict=True):
                            c.append(x)
                if len(cols[0]) > 20000:
                    yield batch(cols)
                    cols = [[] for _ in names]
            yield batch(cols)

    return _rows(docs).mapInArrow(each, _LINE_SCHEMA)


def _variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(va, vb, place, doc_id, text_hash, line, content) of wanted lines (doc_id, text_hash, line, slot).

    place is the deleted one, or -1 for the whole line, which alone carries its content.
    """
    C.prepare(docs.sparkSession)
    names = ["va", "vb", "place", "doc_id", "text_hash", "line", "content"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for i, h, t, nos in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                all_lines = lines_of(t)
                slots: dict[int, set[int]] = {}
                for x in nos:
                    slots.setdefault(x // (2 * PIECES), set()).add(x % (2 * PIECES))
                for no, own in slots.items():
                    line = all_lines[no].strip()
                    ranges = _slots(len(line))
                    for place in sorted({-1}.union(*(range(ranges[k][1], ranges[k][3] + 1) for k in own))):
                        v = line if place < 0 else line[:place] + line[place + 1 :]
                        for c, x in zip(cols, (*_hash128(v.encode("utf-8", "surrogatepass")), place, i, h, no, line if place < 0 else None), strict=True):
                            c.append(x)
                    if len(cols[0]) > 50000:
                        yield batch(cols)
                        cols = [[] for _ in names]
            yield batch(cols)

    lists = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.col("line") * F.lit(2 * PIECES) + F.col("slot")).alias("lines"))
    src = _rows(docs)
    src = src.join(lists, (src.doc_id == F.col("_doc")) & (src.text_hash == F.col("_hash"))).select("doc_id", "text_hash", "text", "lines")
    return src.mapInArrow(each, "va long, vb long, place int, doc_id long, text_hash long, line int, content string")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, dropped, text_hash): the numbers of the lines to drop from each document that loses any, from 0, sorted.

    text_hash is Spark's xxhash64 of the text. Rows with a null doc_id or text lose nothing. Rows
    that share a doc_id are documents of their own if their texts differ, in the order of the hash;
    repeated rows count as one document and lose the same lines. An empty table gives no rows.
    """
    lines = C.materialize(compared_lines(docs, min_chars), "lines")
    at = F.struct(*_AT)
    kinds = lines.groupBy("ha", "hb").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), F.first("rests").alias("rests"))
    kinds = C.materialize(kinds, "line-kinds")
    # Lines that share a remainder with a different line.
    rests = kinds.select(F.posexplode("rests").alias("slot", "rest"), "ha", "first")
    shared = rests.groupBy("rest").agg(F.min("ha").alias("lo"), F.max("ha").alias("hi")).where("lo <> hi").select("rest")
    shared = C.materialize(shared, "line-rests")  # as a table of its own, so that the join can split a hot remainder
    wanted = rests.join(shared, "rest", "left_semi").select("first.*", "slot")
    variants = C.materialize(_variants(docs, wanted), "line-variants")
    # Same place deleted from lines of one length: all are within a substitution of the earliest.
    places = variants.where("place >= 0")
    met = places.groupBy("va", "vb", "place").agg(F.min(at).alias("lead"), F.max(at).alias("last")).where("lead <> last").select("va", "vb", "place", "lead")
    met = C.materialize(met, "line-met")
    substituted = places.join(met, ["va", "vb", "place"]).where(at > F.col("lead")).select(at.alias("later"), F.col("lead").alias("earlier"))
    # A whole line that is another's variant: the later of the two goes.
    whole = variants.where("place < 0").select(F.col("va").alias("wa"), F.col("vb").alias("wb"), at.alias("whole"))
    inserted = places.join(whole, (F.col("va") == F.col("wa")) & (F.col("vb") == F.col("wb"))).select(F.greatest(at, F.col("whole")).alias("later"), F.least(at, F.col("whole")).alias("earlier"))
    pairs = C.materialize(substituted.unionByName(inserted).distinct(), "line-pairs")
    # The edit distance of each pair, on the lines themselves.
    content = variants.where("place < 0").select(at.alias("named"), "content")
    one, two = content.toDF("later", "x"), content.toDF("earlier", "y")
    near = pairs.join(one, "later").join(two, "earlier").where(F.levenshtein("x", "y", 1) >= 0).select("later").distinct()
    near = C.materialize(near.select(F.col("later").alias("near_line")), "line-near")
    # Every copy of a line but the first goes; of a line that is near an earlier one, the first as well.
    marked = kinds.join(near, F.col("first") == F.col("near_line"), "left")
    marked = marked.select("ha", "hb", "first", "n", F.col("near_line").isNotNull().alias("near")).where("n > 1 or near")
    gone = lines.select("ha", "hb", *_AT).join(marked, ["ha", "hb"]).where(F.col("near") | (at > F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("dropped")).select("doc_id", "dropped", "text_hash")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines dropped_lines() names; all rows stay, with their columns and kept lines as they were.

    n_chars, if docs has it, is set anew for the rows that change.
    """
    own_id, own_hash, own = (C.own_name(docs, x) for x in ("_gone_id", "_gone_hash", "_dropped"))
    gone = dropped_lines(docs, min_chars).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("dropped").alias(own))
    both = docs.join(gone, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_hash)), "left")
    kept = F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains(F.col(own), i))
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    both = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return both.select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2_line_dedup over the whole documents table: doc_id, n_lines, n_dropped and the dropped line numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = dropped_lines(docs).toDF("_doc", "dropped", "_hash")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_lines"))
    both = sizes.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", F.size(dropped).alias("n_dropped"), F.array_join(dropped.cast("array<string>"), ",").alias("dropped"))
