"""Vector code compression: product codebooks in integers, entries filtered by segment-mean lower bounds.

Vectors become integers floor(scale * x) and are cut into PARTS equal parts; each part position has
a codebook of up to ENTRIES integer entries, refined by a fixed number of rounds. A part's nearest
entry is found coarse to fine. With a part cut into blocks of b components,

    |x - c|^2 >= sum over blocks of (sum_x - sum_c)^2 / b + (sqrt(R_x) - sqrt(R_c))^2

where R is what the block means leave of the squared norm. The bound is taken with one block, then
with twice as many as long as blocks stay whole; each level looks only at entries that the one
before left. An entry goes only if its bound, lowered by more than the doubles can err, is above
the exact distance of the entry that looked nearest; what is left gets exact integer distances, and
ties go to the lower index. So the filter never changes a result.

Rounds are Spark jobs: tasks assign their vectors and give one partial sum for each entry and
component, which Spark adds up; the driver holds the codebooks only, ENTRIES * length integers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers of this size or more are computed with Python's integers instead of 64 bits.
WIDE = 1 << 24
#: Integers end here: the largest size of which sums of any number of rows fit into 38 digits.
END = 1 << 62


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, ending at END on either side."""
    with np.errstate(over="ignore"):
        x = np.floor(values * float(scale))
    return np.where(x >= float(END), END, np.where(x <= -float(END), -END, np.where(np.abs(x) < float(END), x, 0.0).astype(np.int64)))


def integers(column: pa.ListArray, length: int, scale: int = SCALE) -> np.ndarray:
    """(rows, length) integers of a list column; shorter vectors are filled with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def levels(length: int) -> list[int]:
    """Numbers of blocks from coarse to fine that cut a part of this length into equal blocks of two or more."""
    out, n = [], 1
    while length and length % n == 0 and length // n >= 2:
        out.append(n)
        n *= 2
    return out


def _means(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block sums, scaled so that squared differences are those of block means, and the square root of what they leave."""
    b = x.shape[1] // blocks
    sums = x.reshape(len(x), blocks, b).sum(2).astype(np.float64)
    rest = (x.astype(np.float64) ** 2).sum(1) - (sums**2).sum(1) / b
    return sums / np.sqrt(b), np.sqrt(np.maximum(rest, 0))


def _bounds(x: np.ndarray, entries: np.ndarray, rows: np.ndarray, cols: np.ndarray, blocks: int) -> np.ndarray:
    """Lower bounds of the squared distances of the pairs (rows, cols), below the true ones whatever the rounding."""
    mx, rx = _means(x, blocks)
    mc, rc = _means(entries, blocks)
    bound = ((mx[rows] - mc[cols]) ** 2).sum(1) + (rx[rows] - rc[cols]) ** 2
    # Square roots of cancelling sums err by up to the root of a rounding error of the squared norms.
    size = (x.astype(np.float64) ** 2).sum(1)[rows] + (entries.astype(np.float64) ** 2).sum(1)[cols]
    slack = 1e-7 * size + 1.0
    return bound - slack


def _exact(x: np.ndarray, entries: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), x.dtype)
    for s in range(0, len(rows), 200_000):
        d = x[rows[s : s + 200_000]] - entries[cols[s : s + 200_000]]
        out[s : s + 200_000] = (d * d).sum(1)
    return out


def nearest(x: np.ndarray, entries: np.ndarray, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) for each row; ties go to the lower index. tally counts exact distances."""
    n, k = len(x), len(entries)
    if max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) >= WIDE or x.shape[1] > 1 << 12:
        x, entries = x.astype(object), entries.astype(object)
    if not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    first = np.zeros(n, np.int64)
    best = None
    if x.dtype != object:
        for blocks in levels(x.shape[1]):
            low = _bounds(x, entries, rows, cols, blocks)
            if best is None:
                first = low.reshape(n, k).argmin(1)
                best = _exact(x, entries, np.arange(n), first)
            stay = low <= best[rows]
            rows, cols = rows[stay], cols[stay]
    if tally is not None:
        tally["exact"] = tally.get("exact", 0) + len(rows) + n * (best is not None)
        tally["pairs"] = tally.get("pairs", 0) + n * k
    dist = _exact(x, entries, rows, cols)
    order = np.lexsort((cols, dist, rows)) if x.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], dist[i], cols[i])), np.int64)
    at = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
    return cols[at], dist[at]


def _parts(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, components, code, distance) of whole vectors; books: (parts, entries, length of a part)."""
    width = books.shape[2]
    for p in range(books.shape[0]):
        own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        yield p, own, *nearest(own, books[p])


def _batches(rows: int, step: int = 4096) -> Iterator[slice]:
    return (slice(s, s + step) for s in range(0, rows, step))


def _sums(books: np.ndarray, scale: int):
    """Partial sums of a task's parts by (part, entry): one row for each component, counts at place -1."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        total, count = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for b in batches:
            for at in _batches(b.num_rows):
                x = integers(b.column(0)[at], parts * width, scale)
                for p, own, code, _ in _parts(x, books):
                    count[p] += np.bincount(code, minlength=k)
                    if np.abs(own).max(initial=0) < WIDE:
                        part = np.zeros((k, width), np.int64)
                        np.add.at(part, code, own)
                        total[p] = total[p] + part
                    else:
                        for c, row in zip(code, own.astype(object), strict=True):
                            total[p, c] = total[p, c] + row
        p, c = np.nonzero(count)
        for part, entry in zip(p.tolist(), c.tolist(), strict=True):
            cols = [pa.array([part] * (width + 1), pa.int32()), pa.array([entry] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32())]
            values = [int(count[part, entry]), *map(int, total[part, entry])]
            yield pa.record_batch([*cols, pa.array([str(v) for v in values])], names=["part", "entry", "place", "total"])

    return each


def _coded(books: np.ndarray, scale: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _batches(b.num_rows):
                x = integers(b.column(2)[at], books.shape[0] * books.shape[2], scale)
                code, error = np.empty((len(x), books.shape[0]), np.uint8), np.zeros(len(x), object)
                for p, _, own, dist in _parts(x, books):
                    code[:, p] = own
                    error = error + dist.astype(object)
                errors = [int(e) if int(e) < 1 << 63 else None for e in error]
                yield pa.record_batch([b.column(0)[at], b.column(1)[at], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return each


def finite(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & ~bad)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, length of a part) after the rounds, from (vec_id, embedding) of finite vectors.

    Entries start as the parts of the smallest distinct vec_ids, ascending (null ids last; of rows
    that share an id, the least vector). Each round adds up all parts by their nearest entry and
    replaces it by the floor of the mean; an entry without parts stays.
    """
    C.prepare(vectors.sparkSession)
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts)
    start = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    first = np.zeros((len(start), parts * width), np.int64)
    for i, r in enumerate(start):
        first[i, : len(r.embedding)] = whole_numbers(np.asarray(r.embedding, np.float64), scale)
    books = np.ascontiguousarray(first.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        partial = vectors.select("embedding").mapInArrow(_sums(books, scale), "part int, entry int, place int, total string")
        found = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # at most entries * (length + parts) rows
        count = {(r.part, r.entry): int(r.total) for r in found if r.place < 0}
        for r in found:
            if r.place >= 0:
                books[r.part, r.entry, r.place] = int(r.total) // count[r.part, r.entry]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of finite vectors; an error that a long can't hold is null."""
    C.prepare(vectors.sparkSession)
    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(_coded(books, scale), f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row with a finite vector.

    Rows whose vector is null or holds null or non-finite components go. Vectors shorter than the
    longest, rounded up to a multiple of parts, count as filled with zeros; an empty one is coded
    like zeros. Components beyond 2^62 end there. Repeated rows are coded each; rows of null id or
    label are kept, null labels form one group. An empty table gives no rows. Fewer ids than entries
    give smaller codebooks. Other columns are ignored.
    """
    rows = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("embedding")))
    books = fit(rows.select("vec_id", "embedding"), parts, entries, rounds, scale)
    coded = C.materialize(encode(rows, books, scale), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11_vector_codes over the whole embeddings table."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@functools.lru_cache(maxsize=1)
def op11_sql() -> str:
    """The same by plain exhaustive distances, one round after the other."""
    ctes = [
        f"""x AS MATERIALIZED (
  SELECT vec_id, label, (u.i - 1) // (n // {PARTS}) AS part, (u.i - 1) % (n // {PARTS}) AS place, CAST(floor(u.v * {SCALE}) AS BIGINT) AS v
  FROM (SELECT vec_id, label, len(embedding) AS n, unnest(list_transform(embedding, lambda e, i: {{'i': i, 'v': CAST(e AS DOUBLE)}})) AS u
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0))""",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM x) ORDER BY vec_id LIMIT {ENTRIES})""",
        "book0 AS MATERIALIZED (SELECT part, entry, place, v AS c FROM x JOIN first USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, part, min({{'d': d, 'e': entry}}) AS m
  FROM (SELECT vec_id, any_value(label) AS label, x.part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN book{r} b ON x.part = b.part AND x.place = b.place GROUP BY vec_id, x.part, entry)
  GROUP BY vec_id, label, part)""")
        if r < ROUNDS:
            ctes.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(s.c, b.c) AS c
  FROM book{r} b LEFT JOIN (
    SELECT x.part, n.m.e AS entry, place, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS c
    FROM x JOIN near{r} n ON x.vec_id = n.vec_id AND x.part = n.part GROUP BY x.part, n.m.e, place) s
  ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)""")
    last = f"near{ROUNDS}"
    ctes.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM {last} GROUP BY vec_id, label)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM book{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest"
