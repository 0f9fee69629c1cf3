"""Near-dedup by SimHash with Golay keys, verified by the true similarity of word shingles.

Two documents are linked if the Jaccard similarity of their sets of word shingles is at least
``SIMILARITY``. A fingerprint of 64 bits then differs in about ten bits, more than Golay keys that
decode its bits as they are can bridge. Two things carry them to 0.8. The fingerprint is longer: 34
segments of 23 bits, two for each of TABLES tables. And it is decoded softly: a bit is the sign of a
sum over the shingles, bits of small sums are the ones that change, so each segment names the
codewords of the binary Golay code (23, 12, 7) that agree best with its sums. A document is filed in
each table under the CELLS pairs of codewords that agree best with both segments. At 0.8 one table
finds a pair with probability 0.35, seventeen miss it with 0.0006, and less above.

Documents that share a key are candidates if 128 further bits of their fingerprints differ in at most
CHECK: 19 are expected at 0.8, 64 of unlike texts. Candidates are verified on the sets themselves.
Documents with the same shingle set are collapsed before that.

A key's bucket need not be spelled out in pairs. First each member is held against the bucket's
leader, and what is linked so far is put into components. A bucket within one component has nothing
left to say; of the others only pairs of different components are verified. The components are
those of all candidate pairs, and a hot bucket of true copies costs a star.

A bucket that still holds more than BUCKET documents of several components is a crowd of texts that
resemble each other, but mostly less than SIMILARITY. Its members are dealt into blocks, and each
pair of blocks is a unit of work that compares its sets as one product of matrices: no pairs are
formed as rows, and a unit gives a star for each group of similar sets that it finds.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from .embedding_dedup import stars
from .simhash import golay_syndromes, words_of

SIMILARITY, SHINGLE = 0.8, 5
#: Tables, the keys of a document in each, and the bits that may differ in the further ones.
TABLES, CELLS, CHECK = 17, 4, 44
#: Bits of a segment, words of 64 bits of a fingerprint, and the bit from which on it is compared.
SEGMENT, WORDS, FURTHER = 23, 15, 832
#: The size from which a bucket is a crowd, members of a block, and entries of a matrix that a unit holds at a time.
BUCKET, BLOCK, MATRIX = 64, 128, 4_000_000
#: Texts, sets or pairs of sets that go to a Python worker at a time.
ROWS = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """XXH64 of words, remembered up to a number of them."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, a blank one has none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = _mix(x * _MULTIPLIER + h[i : i + n])
    return np.unique(x)


def bit_sums(x: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint of a set of shingle hashes: how many of them set it, less those that don't."""
    word = np.arange(1, WORDS + 1, dtype=np.uint64) * _MULTIPLIER
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(x), 255):  # so many fit a byte
        bits = np.unpackbits(_mix(x[at : at + 255, None] + word).view(np.uint8), axis=1)
        total += bits.sum(axis=0, dtype=np.uint8)
    return 2 * total - len(x)


@functools.lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """(23, 4096): the words of the Golay code as signs, in the order of their message bits."""
    word = np.arange(4096, dtype=np.int32) << 11
    word ^= golay_syndromes(word)
    return ((word >> np.arange(SEGMENT)[:, None] & 1) * 2 - 1).astype(np.float32)


def golay_keys(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(documents, TABLES * CELLS): table number and codeword indices of its two segments, best agreement first.

    sums: bit_sums by document, n: sizes of their sets. Sums are rounded to whole numbers that
    single precision adds up exactly, so that keys don't depend on what is computed together.
    """
    m = np.rint(sums[:, : 2 * TABLES * SEGMENT] * (1024 / np.sqrt(n))[:, None]).clip(-8192, 8192).astype(np.float32)
    one, two = np.array([0, 0, 0, 0, 1, 1, 2, 3]), np.array([0, 1, 2, 3, 0, 1, 0, 0])  # no other pair can be among the best four
    out = []
    for at in range(0, len(m), 16):
        agree = m[at : at + 16].reshape(-1, SEGMENT) @ codewords()
        every = np.arange(len(agree))
        best, score = np.empty((len(agree), CELLS), np.int64), np.empty((len(agree), CELLS), np.float32)
        for i in range(CELLS):
            best[:, i] = agree.argmax(1)
            score[:, i] = agree[every, best[:, i]]
            agree[every, best[:, i]] = -np.inf
        best, score = best.reshape(-1, TABLES, 2, CELLS), score.reshape(-1, TABLES, 2, CELLS)
        both = score[:, :, 0, one] + score[:, :, 1, two]
        index = best[:, :, 0, one] << 12 | best[:, :, 1, two]
        pick = np.argsort(-both, axis=2, kind="stable")[:, :, :CELLS]
        key = np.arange(TABLES)[None, :, None] << 24 | np.take_along_axis(index, pick, 2)
        out.append(key.reshape(len(key), -1).astype(np.int32))
    return np.concatenate(out)


def further_bits(sums: np.ndarray) -> np.ndarray:
    """(documents, 2): the bits of the fingerprints that no key holds."""
    return np.packbits(sums[:, FURTHER:] > 0, axis=1).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n, keys, s0, s1) of every row with a doc_id: node names the shingle set, n counts it."""
    C.prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                node, n, sums = [], [], np.zeros((b.num_rows, 64 * WORDS), np.int64)
                for i, t in enumerate(b.column(2).to_pylist()):
                    x = shingles(t)
                    h = xxhash.xxh64_intdigest(x.tobytes(), 42)
                    node.append(h - (1 << 64) if h >> 63 else h)
                    n.append(len(x))
                    sums[i] = bit_sums(x)
                size = np.array(n)
                keys = golay_keys(sums, np.maximum(size, 1))
                ends = np.concatenate([[0], np.cumsum((size > 0) * keys.shape[1])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[size > 0].ravel()))
                more = further_bits(sums)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int32()), lists, pa.array(more[:, 0]), pa.array(more[:, 1])], names=["doc_id", "text_hash", "node", "n", "keys", "s0", "s1"])

    text = F.col("text").cast("string")
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return src.mapInArrow(each, "doc_id long, text_hash long, node long, n int, keys array<int>, s0 long, s1 long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes (node, doc_id, text_hash)."""
    C.prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                hashes = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])

    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    src = src.join(wanted, (F.col("_doc") == F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("node", "text")
    return src.mapInArrow(each, "node long, hashes array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least SIMILARITY."""
    C.prepare(pairs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                near = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    both = np.intersect1d(x, y, assume_unique=True).size
                    near.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
                yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def similar_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes (node, n, keys, s0, s1, doc_id, text_hash), enough to connect all candidate pairs that are similar."""
    keyed = C.materialize(nodes.select(F.explode("keys").alias("key"), "node"), "shingle-keys")
    leaders = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "lead")
    # Few keys are shared: what else is known of a node is sent for those alone.
    met = C.materialize(keyed.join(leaders, "key").join(nodes.select("node", "n", "s0", "s1"), "node"), "shingle-met")
    other = lambda df: df.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("s0").alias("t0"), F.col("s1").alias("t1"), *[F.col(c).alias("other") for c in df.columns if c == "part"])
    # One set must have this share of the other's size.
    alike = F.least("n", "m") >= F.greatest("n", "m") * F.lit(SIMILARITY) - 1e-9
    alike &= F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) <= CHECK

    star = met.where("node = lead").join(other(met.where("node <> lead")), "key").where(alike).select(F.col("node").alias("a"), "b").distinct()
    star = C.materialize(star, "shingle-star-pairs")
    named = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    held = C.materialize(nodes.join(named, "node", "left_semi").select("node", "doc_id", "text_hash"), "shingle-held")
    sets = C.materialize(_sets(docs, held), "shingle-sets")
    links = C.materialize(_verified(star, sets), "shingle-star")
    parts = C.connected_components(links, "shingle-star")
    placed = met.join(parts, "node", "left").select("key", "node", "n", "s0", "s1", "lead", F.coalesce("component", "node").alias("part"))
    placed = C.materialize(placed, "shingle-placed")
    torn = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("key", "members")
    torn = C.materialize(torn, "shingle-torn")
    left = placed.join(torn.where(F.col("members") <= BUCKET).select("key"), "key", "left_semi")
    # Pairs with the leader were verified above.
    rest = left.where("node <> lead").join(other(left.where("node <> lead")), "key").where((F.col("node") < F.col("b")) & (F.col("part") != F.col("other")) & alike)
    rest = C.materialize(rest.select(F.col("node").alias("a"), "b").distinct(), "shingle-rest-pairs")
    crowd = C.materialize(placed.join(torn.where(F.col("members") > BUCKET), "key").select("key", "node", "part", "members"), "shingle-crowd")
    named = rest.select(F.col("a").alias("node")).unionByName(rest.select(F.col("b").alias("node"))).unionByName(crowd.select("node")).distinct()
    more = nodes.join(named, "node", "left_semi").join(held.select("node"), "node", "left_anti").select("node", "doc_id", "text_hash")
    sets = sets.unionByName(C.materialize(_sets(docs, C.materialize(more, "shingle-more")), "shingle-more-sets"))
    return links.unionByName(_verified(rest, sets)).unionByName(_crowd_links(crowd, sets))


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """For each two of a list of sorted sets, whether they have at least SIMILARITY."""
    size = np.array([len(x) for x in sets])
    whole, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # What one set alone holds is in no two of them; the rest is added up some columns at a time.
    column, row = (np.cumsum(times > 1) - 1)[at], np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    order = order[times[at[order]] > 1]
    column, row = column[order], row[order]
    width = max(1, MATRIX // len(sets))
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, column[-1] + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [first, first + width])
        held = np.zeros((len(sets), min(width, column[-1] + 1 - first)), np.float32)
        held[row[s:e], column[s:e] - first] = 1
        both += held @ held.T
    np.fill_diagonal(both, size)
    return both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9


def _crowd_links(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what is similar in each bucket of a crowd (key, node, part, members) and not yet in one part."""
    C.prepare(crowd.sparkSession)
    blocks = F.ceil(F.col("members") / BLOCK)
    spread = crowd.withColumn("side", F.pmod(F.xxhash64("node"), blocks)).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    work = spread.select("key", F.least("side", "_with").alias("i"), F.greatest("side", "_with").alias("j"), "node", "part", "side").join(sets, "node")
    dealt = work.select("key", "i", "j", "node", "part", "side", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def unit(t: pa.Table) -> pa.RecordBatch:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        node, part, side = (t.column(c).to_numpy() for c in ("node", "part", "side"))
        near = similar_pairs([x.values.to_numpy() for x in t.column("hashes")])
        near &= np.triu(part[:, None] != part[None, :])
        if i != j:
            near &= side[:, None] != side[None, :]
        low = stars(len(node), *np.nonzero(near))
        (hung,) = np.nonzero(low != np.arange(len(node)))
        return pa.record_batch([pa.array(node[low[hung]], pa.int64()), pa.array(node[hung], pa.int64())], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for s, e in itertools.pairwise(cut):
                if held and tuple(k[s]) != last:
                    yield unit(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = tuple(k[s])
        if held:
            yield unit(pa.Table.from_batches(held))

    return dealt.mapInArrow(each, "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar documents: the one with the smallest doc_id.

    Groups are the components of the links. Blank and null texts are one group. Rows with a null
    doc_id stay; of repeated rows one stays. Columns are those of docs.
    """
    with C.small_batches(docs.sparkSession, ROWS):
        return _kept(docs)


def _kept(docs: DataFrame) -> DataFrame:
    """The rows of near_dedup; all that runs in Python is settled when it returns."""
    rows = C.materialize(signatures(docs), "shingle-signatures")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    nodes = C.materialize(nodes.select("node", "n", "keys", "s0", "s1", "first.doc_id", "first.text_hash"), "shingle-nodes")
    links = C.materialize(similar_links(docs, nodes), "shingle-links")
    parts = C.connected_components(links, "shingle")
    named = nodes.join(parts, "node", "left").select(F.coalesce("component", "node").alias("part"), F.struct("doc_id", "text_hash").alias("first"))
    own, own_hash, nth = (C.own_name(docs, x) for x in ("_keep", "_keep_hash", "_nth"))
    keep = named.groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(own), F.col("first.text_hash").alias(own_hash))
    keep = C.materialize(keep, "shingle-keep")
    same = (F.col("doc_id").cast("long") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_hash))
    order = Window.partitionBy(own, own_hash).orderBy(own)
    kept = docs.join(keep, same).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
