"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). At most two
differing bits leave at least one segment untouched (pigeonhole), and the two bits then lie in the
other segments. A key therefore pairs one segment taken exactly with the next segment decoded by
the binary Golay code (23, 12, 7): the indices of all codewords within four bits of it, six at
most. Two words at distance two or less have a midpoint within one bit of both, the code covers
every word within three bits, so both lie within four bits of one codeword: they share a key.
Documents that share a key are candidates and are linked after counting the differing bits.

Fingerprints are collapsed to distinct values before the join, so copies never form pairs. A key
that gathers more than ``bucket_limit`` distinct fingerprints is split by the codeword indices of
the third segment as well, which any two members within two bits share too. What is still that
large is a dense ball around one codeword: there each member names the points within one bit of it
in the two decoded segments; two members meet in one such point exactly if they differ in two bits
at most, and every point needs only a star of links, not all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the perfect Golay code (fixed value).
GOLAY_GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LINK_BITS = 2
#: A-Z to a-z, and nothing else, is lower-cased.
_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: str | None) -> list[str]:
    """Words are maximal runs of characters other than space and U+0009 to U+000D."""
    t = (text or "").translate(_LOWER)
    for c in _SPACE[1:]:
        if c in t:
            t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 (seed 42) of the text's word shingles."""
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    # Joined words; a shingle is a slice of the bytes between word starts.
    data = " ".join(w).encode("utf-8", "surrogatepass")
    if n == 1:
        return xxhash.xxh64_intdigest(data, 42)
    lens = np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in w), np.int64, len(w)) if not data.isascii() else np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lens + 1) - 1
    starts, stops = (ends - lens)[:n].tolist(), ends[shingle - 1 :].tolist()
    h64 = xxhash.xxh64_digest
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        raw = b"".join([h64(data[i:j], 42) for i, j in zip(starts[at : at + 65536], stops[at : at + 65536])])
        bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of docs; fp is the fingerprint as a signed long."""
    C.prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(each, "doc_id long, fp long")


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2^11 syndromes: the error patterns of weight four or less (padded), and how many."""
    errors: list[list[int]] = [[] for _ in range(2048)]
    one = [0] * 23
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY_GENERATOR << (k - 11)
        one[i] = r

    def grow(start: int, left: int, word: int, syn: int) -> None:
        errors[syn].append(word)
        for i in range(start, 23) if left else ():
            grow(i + 1, left - 1, word | 1 << i, syn ^ one[i])

    grow(0, 4, 0, 0)
    most = max(map(len, errors))
    table = np.zeros((2048, most), np.int32)
    for s, e in enumerate(errors):
        table[s, : len(e)] = e
    return table, np.array([len(e) for e in errors], np.int32)


def golay_syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = v.astype(np.int32).copy()
    for k in range(22, 10, -1):
        r ^= np.where(r >> k & 1, np.int32(GOLAY_GENERATOR << (k - 11)), np.int32(0))
    return r


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _decoded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all codewords within four bits of each word, by their twelve message bits (the code is systematic)."""
    table, count = golay_tables()
    syn = golay_syndromes(words)
    n = count[syn]
    row = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (words[row] ^ table[syn[row], nth]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys: table number, exact segment and codeword index of the next segment."""
    seg = _segments(fps)
    rows, keys = [], []
    for i in range(3):
        row, index = _decoded(seg[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 40) | (seg[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _split_keys(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of keys split by the codeword indices of the segment they leave open."""
    seg = np.stack(_segments(fps))
    row, index = _decoded(seg[((keys >> 40) + 2) % 3, np.arange(len(fps))])
    return row, (keys[row] << 12) | index


def _points(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, point): each fingerprint and its one-bit neighbours outside the segment that its split key holds exact."""
    rows, points = [], []
    exact = keys >> 52
    for i, (at, n) in enumerate(SEGMENTS):
        own = np.flatnonzero(exact == i)
        free = [b for b in range(64) if not at <= b < at + n]
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.array(free, np.uint64)])
        rows.append(np.repeat(own, len(flips)))
        points.append((fps[own].view(np.uint64)[:, None] ^ flips).view(np.int64).ravel())
    return np.concatenate(rows), np.concatenate(points)


def _keyed(df: DataFrame, f, name: str) -> DataFrame:
    """(key, fp) from (fp) or (fp, key) by f, in batches."""
    C.prepare(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.slice(at, 8192).columns]
                row, key = f(*cols)
                yield pa.record_batch([pa.array(key), pa.array(cols[0][row])], names=["key", "fp"])

    return C.materialize(df.mapInArrow(each, "key long, fp long"), name)


def _small_and_hot(keyed: DataFrame, limit: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of the keys with at most limit members, and the rows of the others."""
    sizes = C.materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    small = keyed.join(sizes.where(F.col("n") <= limit).select("key"), "key", "left_semi")
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS)).select("a", "b")
    return pairs, keyed.join(sizes.where(F.col("n") > limit).select("key"), "key", "left_semi").select("fp", "key")


def fingerprint_links(distinct: DataFrame, bucket_limit: int = 32) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to reach all at LINK_BITS bits or less.

    Every link is real, and any two fingerprints at that distance are connected by the links.
    """
    pairs, hot = _small_and_hot(_keyed(distinct.select("fp"), golay_keys, "golay-keys"), bucket_limit, "golay-sizes")
    more, dense = _small_and_hot(_keyed(hot, _split_keys, "golay-split"), bucket_limit, "golay-split-sizes")
    # A star's centre is any one member: all members of a point are linked with each other.
    near = dense.select("fp", F.shiftleft(F.shiftright("key", 52), 52).alias("key")).distinct()
    met = _keyed(near, _points, "golay-points")
    centre = met.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("key", "a")
    stars = met.join(centre, "key").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(more).unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Null and blank texts have fingerprint zero and are linked like any other. Rows with a null
    doc_id are returned with a null component_id and link with nothing. Repeated rows repeat.
    An empty table gives no rows. Other columns of docs are ignored.
    """
    fps = C.materialize(fingerprints(docs, shingle), "simhash")
    groups = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = C.materialize(groups, "simhash-groups")
    links = fingerprint_links(groups)
    comps = C.connected_components(links, "simhash")
    reach = groups.join(comps, groups.fp == comps.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    reach = C.materialize(reach, "simhash-reach")
    lowest = C.materialize(reach.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-lowest")
    named = reach.join(lowest, "component").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, fps.fp == F.col("_fp"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def near_dedup(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Of repeated rows of that doc_id one stays. Rows with a null doc_id stay. Columns are those of docs.
    """
    own, nth = C.own_name(docs, "_keep"), C.own_name(docs, "_nth")
    keep = simhash_components(docs, shingle).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text").cast("string")))
    kept = docs.join(keep, F.col("doc_id").cast("long") == F.col(own)).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6_simhash_near_dedup over the whole documents table."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
