"""Cross-tokenizer alignment: two tokenisations of every text meet where tokens of both end.

A text is cut into chunks where both tokenisers must cut: before a single blank between other
characters. Chunks recur, so a task remembers what a chunk gives (tokens, groups, links) and a text
is a sequence of chunks. Documents come in blocks; a block gives one row for each id pair that its
links hold, with postings (document, multiplicity) in four bytes each.

Postings are shuffled by the id of side B, in sorted runs that Spark spills. An id with many
postings is spread over shards by block. With the postings of an id travel the counts of its pairs,
added up from the blocks, and the highest of them: sorted, a pair's count lies before its postings
in every shard, so a task reads its stream once and holds one batch. It emits what each document
gets, added up by block in packed rows; a second shuffle by block sums them by document. All rows
grow with the postings, none with the square of anything.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import tokens

#: Documents of a block at most, and chunks after which a block ends.
BLOCK_DOCS, BLOCK_CHUNKS = 4096, 600_000
#: Bytes and documents whose new chunks are read together.
READ, READ_DOCS = 1_000_000, 1024
#: Chunks that a task remembers, up to this many characters each.
MEMORY, MEMORY_CHARS = 250_000, 64
#: Rows of a side id in one shard, about.
SHARD_ROWS = 2048
#: Postings that a task of the cogroup adds up before it emits.
FLUSH = 1_000_000

_CHUNK = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def _plain(path: str):
    """The reference library, with special tokens read as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.lru_cache(maxsize=4)
def _bytes_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    byte_of = {c: b for b, c in tokens._byte_chars().items()}
    vocab = _plain(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


@functools.lru_cache(maxsize=4)
def _pieces(path: str):
    """(processor, bytes of each id, whether no piece holds a blank after another character)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    out = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return sp, out, not any(re.search("[^▁]▁", p) for p in names)


def ids_a(text: str, path: str) -> list[int]:
    """Ids of blank + text by the byte-level vocabulary; special tokens' strings are ordinary text."""
    if tokens._PLAIN.search(text):
        return _plain(path).encode(f" {text}", add_special_tokens=False).ids
    return tokens._fast(path).encode_ordinary(f" {text}")


def groups_of(a: list[int], b: list[int], len_a: list[int], len_b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(ends, links): ends of each group as (tokens of A, tokens of B) so far, and (index in A, index in B) of each link.

    A token without bytes belongs to the group that ends where it does; all tokens that end at one
    place are linked with each other.
    """
    i = j = at_a = at_b = 0
    ends, links = [], []
    while i < len(a) and j < len(b):
        if at_a + len_a[i] < at_b + len_b[j]:
            at_a += len_a[i]
            i += 1
        elif at_b + len_b[j] < at_a + len_a[i]:
            at_b += len_b[j]
            j += 1
        else:
            at_a, at_b = at_a + len_a[i], at_b + len_b[j]
            first_i, first_j = i, j
            i, j = i + 1, j + 1
            while i < len(a) and not len_a[i]:
                i += 1
            while j < len(b) and not len_b[j]:
                j += 1
            links += [(x, y) for x in range(first_i, i) for y in range(first_j, j)]
            ends.append((i, j))
    return ends, links


def align_text(text: str, path_a: str, path_b: str) -> tuple[int, int, int, str, list[int]] | None:
    """(tokens of A, of B, groups, groups as text, links as B id << 32 | A id); None if the bytes of A or B differ from blank + text."""
    sp, bytes_b, _ = _pieces(path_b)
    bytes_a = _bytes_a(path_a)
    a, b = ids_a(text, path_a), sp.encode(text)
    raw, of_a, of_b = f" {text}".encode(), [bytes_a[i] for i in a], [bytes_b[i] for i in b]
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    ends, links = groups_of(a, b, [len(x) for x in of_a], [len(x) for x in of_b])
    said, pi, pj = [], 0, 0
    sa, sb = list(map(str, a)), list(map(str, b))
    for i, j in ends:
        said.append(f"{','.join(sa[pi:i])}|{','.join(sb[pj:j])}")
        pi, pj = i, j
    return len(a), len(b), len(ends), ";".join(said), [b[y] << 32 | a[x] for x, y in links]


def _clean(chunk: str) -> bool:
    """Whether a chunk neither is empty nor begins or ends with white space, so that blanks beside it are cuts."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


class _Memory:
    """What chunks give, numbered in the order they were first seen.

    Chunks that are new are read together: joined by blanks they are a text that is cut where they
    meet, so both libraries are called once for many of them.
    """

    def __init__(self, path_a: str, path_b: str):
        self.paths, self.cut = (path_a, path_b), _pieces(path_b)[2]
        self.size_a, self.size_b = (np.array([len(x) for x in b], np.int64) for b in (_bytes_a(path_a), _pieces(path_b)[1]))
        n = max(len(self.size_a), len(self.size_b))
        self.text = {end: np.array([f"{i}{end}" for i in range(n)], object) for end in ",|;"}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        self._counts: list[np.ndarray] = []
        self._keys: list[np.ndarray] = []

    @property
    def counts(self) -> np.ndarray:
        """(tokens of A, of B, groups, links, whether bytes agree) of each chunk."""
        self._counts = [np.concatenate([np.zeros((0, 5), np.int64), *self._counts])]
        return self._counts[0]

    @property
    def keys(self) -> np.ndarray:
        """The links of all chunks, chunk by chunk, as B id << 32 | A id."""
        self._keys = [np.concatenate([np.zeros(0, np.int64), *self._keys])]
        return self._keys[0]

    def number(self, texts: list[str]) -> list[list[int]]:
        """Numbers of each text's chunks."""
        parts, new = [], set()
        for t in texts:
            part = t.split(" ") if self.cut else [t]
            missing = set(part).difference(self.known)
            if not all(map(_clean, missing)) and self.cut:
                part = _CHUNK.split(t)
                missing = set(part).difference(self.known)
            parts.append(part)
            new |= missing
        here = self._learn(sorted(new))
        return [[here[c] if n is None else n for c, n in zip(p, map(self.known.get, p), strict=True)] for p in parts]

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        """Numbers of new chunks; short clean ones are remembered."""
        whole = [c for c in chunks if self.cut and _clean(c)]
        here: dict[str, int] = {}
        for plain in (True, False):
            part = [c for c in whole if bool(tokens._PLAIN.search(c)) is not plain]
            if part and self._together(part):
                here |= dict(zip(part, range(len(self.said) - len(part), len(self.said)), strict=True))
        for c in chunks:
            if c not in here:
                here[c] = len(self.said)
                found = align_text(c, *self.paths)
                self.said.append(found[3] if found else "")
                self._counts.append(np.array([(*found[:3], len(found[4]), 1) if found else (0, 0, 0, 0, 0)], np.int64))
                self._keys.append(np.array(found[4] if found else [], np.int64))
        self.known.update((c, n) for c, n in here.items() if len(c) <= MEMORY_CHARS and (_clean(c) or not self.cut))
        return here

    def _together(self, chunks: list[str]) -> bool:
        """Read clean chunks as one text; false, with nothing kept, if bytes differ anywhere or a token has none."""
        text = " ".join(chunks)
        sp, bytes_b, _ = _pieces(self.paths[1])
        bytes_a, raw = _bytes_a(self.paths[0]), f" {text}".encode()
        ids_of_a, ids_of_b = ids_a(text, self.paths[0]), sp.encode(text)
        if b"".join([bytes_a[i] for i in ids_of_a]) != raw or b"".join([bytes_b[i] for i in ids_of_b]) != raw:
            return False
        a, b = np.array(ids_of_a, np.int64), np.array(ids_of_b, np.int64)
        if not self.size_a[a].all() or not self.size_b[b].all():
            return False
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        cut = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in chunks), np.int64, len(chunks)))
        at = np.searchsorted(both, cut)
        if (both[np.minimum(at, len(both) - 1)] != cut).any():
            return False
        # Tokens in order of groups, A's before B's, each with the mark that follows it.
        say_a, say_b = self.text[","][a], self.text[","][b]
        say_a[last_a], say_b[last_b] = self.text["|"][a[last_a]], self.text[";"][b[last_b]]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = say_a
        said[np.arange(len(b)) + (last_a + 1)[group_b]] = say_b
        stop_a, stop_b = last_a[at] + 1, last_b[at] + 1
        stop = (stop_a + stop_b).tolist()
        said, begin = said.tolist(), 0
        for e in stop:
            self.said.append("".join(said[begin:e])[:-1])
            begin = e
        groups = np.diff(at + 1, prepend=0)
        self._counts.append(np.stack([np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0), groups, groups, np.ones(len(chunks), np.int64)], 1))
        self._keys.append(b[last_b] << 32 | a[last_a])
        return True


def _postings(doc: np.ndarray, chunk: np.ndarray, memory: _Memory, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, multiplicity), sorted, of documents that are sequences of chunks."""
    width = np.int64(len(memory.said) or 1)
    seen, times = np.unique(doc.astype(np.int64) * width + chunk, return_counts=True)
    d, c = seen // width, seen % width
    links = memory.counts[:, 3]
    n, first = links[c], (np.cumsum(links) - links)[c]
    flat = memory.keys[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    pairs, index = np.unique(flat, return_inverse=True)
    key = index * np.int64(docs) + np.repeat(d, n)
    order = np.argsort(key, kind="stable")
    key, m = key[order], np.repeat(times, n)[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(m, begin) if len(begin) else m
    key = key[begin]
    return pairs[key // docs], key % docs, total


def _packed(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, links, postings) for each pair: postings as document and multiplicity of 16 bits each, a larger one in several."""
    more = (times - 1) // 0xFFFF
    if more.any():
        n = more + 1
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair, doc = np.repeat(pair, n), np.repeat(doc, n)
        times = np.minimum(np.repeat(times, n) - own * 0xFFFF, 0xFFFF)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    raw = np.stack([doc.astype("<u2"), times.astype("<u2")], 1)
    offsets = np.append(first, len(pair)).astype(np.int32) * 4
    column = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
    return pair[first], np.add.reduceat(times, first) if len(first) else times, column


_BLOCKS = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, a int, links long, postings binary"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds by block: documents (place is set) and pairs with their postings (b is set)."""
    C.prepare(docs.sparkSession)

    def block_rows(block: int, ids: list, chunks: list[list[int]], blank: list[bool], memory: _Memory) -> pa.RecordBatch:
        n = len(ids)
        counts = memory.counts
        size = np.array([len(x) for x in chunks], np.int64)
        flat = np.fromiter((x for c in chunks for x in c), np.int64, int(size.sum()))
        of = np.repeat(np.arange(n), size)
        bad = np.zeros(n, bool)
        bad[of[counts[flat, 4] == 0]] = True
        bad |= np.array(blank, bool)
        keep = ~bad[of]
        flat, of = flat[keep], of[keep]
        sums = np.zeros((n, 3), np.int64)
        np.add.at(sums, of, counts[flat, :3])
        said = memory.said
        sha = ["" if bad[i] else hashlib.sha256(";".join([said[x] for x in chunks[i]]).encode()).hexdigest() for i in range(n)]
        pair, links, packed = _packed(*_postings(of, flat, memory, n))
        linked = np.zeros(n, np.int64)
        _, raw = _binary(packed)
        raw = np.frombuffer(raw.tobytes(), "<u2").reshape(-1, 2)
        np.add.at(linked, raw[:, 0], raw[:, 1])
        k = len(pair)
        none = lambda m, kind: pa.nulls(m, kind)
        join = lambda left, right: pa.concat_arrays([left, right])
        cols = [
            pa.array(np.full(n + k, block), pa.int64()),
            join(pa.array(np.arange(n), pa.int32()), none(k, pa.int32())),
            join(pa.array(ids, pa.int64()), none(k, pa.int64())),
            *[join(pa.array(sums[:, i], pa.int64()), none(k, pa.int64())) for i in range(3)],
            join(pa.array(linked, pa.int64()), none(k, pa.int64())),
            join(pa.array(sha, pa.string()), none(k, pa.string())),
            join(none(n, pa.int32()), pa.array(pair >> 32, pa.int32())),
            join(none(n, pa.int32()), pa.array(pair & 0xFFFFFFFF, pa.int32())),
            join(none(n, pa.int64()), pa.array(links, pa.int64())),
            join(none(n, pa.binary()), packed),
        ]
        return pa.record_batch(cols, names=[x.split()[0] for x in _BLOCKS.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, memory = TaskContext.get().partitionId() << 33, _Memory(path_a, path_b)
        ids, chunks, blank, held = [], [], [], 0

        for b in batches:
            size = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff((np.cumsum(size) - size) // READ + np.arange(b.num_rows) // READ_DOCS * (1 << 40))) + 1):
                if not len(rows):
                    continue
                texts = b.column(1)[int(rows[0]) : int(rows[-1]) + 1].to_pylist()
                ids += b.column(0)[int(rows[0]) : int(rows[-1]) + 1].to_pylist()
                blank += [not t for t in texts]
                chunks += memory.number([t or "" for t in texts])
                held += sum(map(len, chunks[-len(texts) :]))
                if len(ids) >= BLOCK_DOCS - READ_DOCS or held >= BLOCK_CHUNKS:
                    yield block_rows(block, ids, chunks, blank, memory)
                    block, ids, chunks, blank, held = block + 1, [], [], [], 0
                    if len(memory.said) > MEMORY:
                        memory.clear()
        if ids:
            yield block_rows(block, ids, chunks, blank, memory)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, _BLOCKS)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of a binary column."""
    column = pa.concat_arrays([column]) if column.offset else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    return np.diff(offsets), data


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each document gets from a sorted stream in which a pair's count lies before its postings."""
    carried = (0, 0)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def emit() -> pa.RecordBatch:
        block, doc, best, total = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, block))
        block, doc = block[order], doc[order]
        first = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        best, total = np.add.reduceat(best[order], first), np.add.reduceat(total[order], first)
        block, doc = block[first], doc[first]
        cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        raw = np.stack([doc, best, total], 1).astype("<i8")
        packed = [raw[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
        return pa.record_batch([pa.array(block[cut[:-1]], pa.int64()), pa.array(packed, pa.binary())], names=["block", "sums"])

    for b in batches:
        count, top = (pc.fill_null(b.column(i), -1).to_numpy(zero_copy_only=False) for i in (0, 1))
        head = count >= 0
        at = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
        count = np.where(at >= 0, count[np.maximum(at, 0)], carried[0])
        top = np.where(at >= 0, top[np.maximum(at, 0)], carried[1])
        if len(count):
            carried = (int(count[-1]), int(top[-1]))
        rows = np.flatnonzero(~head)
        size = pc.binary_length(b.column(3)).fill_null(0).to_numpy(zero_copy_only=False)[rows] // 4
        part = (np.cumsum(size) - size) // FLUSH  # rows are read some FLUSH postings at a time
        for own_rows in np.split(rows, np.flatnonzero(np.diff(part)) + 1) if len(rows) else []:
            sizes, data = _binary(b.column(3).take(pa.array(own_rows)))
            own = np.repeat(own_rows, sizes // 4)
            raw = np.frombuffer(data.tobytes(), "<u2").reshape(-1, 2).astype(np.int64)
            block = pc.fill_null(b.column(2), -1).to_numpy(zero_copy_only=False)[own]
            held.append((block, raw[:, 0], np.where(count[own] == top[own], raw[:, 1], 0), raw[:, 1] * count[own]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield emit()
    if held:
        yield emit()


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with the sum of what was emitted for them."""
    place = left.column("place").to_numpy()
    best, total = np.zeros(int(place.max(initial=-1)) + 1, np.int64), np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    for raw in right.column("sums"):
        x = np.frombuffer(raw.as_py(), "<i8").reshape(-1, 3)
        best[x[:, 0]] += x[:, 1]
        total[x[:, 0]] += x[:, 2]
    out = left.drop_columns(["block", "place"]).append_column("n_best", pa.array(best[place], pa.int64())).append_column("count_sum", pa.array(total[place], pa.int64()))
    return out


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    A null or empty text, or one whose bytes by either vocabulary differ from blank + text, has no
    tokens: zeros and an empty groups_sha256. Repeated rows and null ids are rows of their own, and
    count each. Of pairs with the same count, all are the best of their B id. An empty table gives no
    rows. Other columns are ignored. Multiplicities of any size are kept.
    """
    import public_tokenizers

    path_a, path_b = path_a or tokens.default_path(), path_b or public_tokenizers.path("piece_bpe_32k.model")
    blocks = C.materialize(aligned_blocks(docs, path_a, path_b), "alignment-blocks")
    posts = blocks.where("b is not null").select("b", "a", "block", "links", "postings")
    # An id of side B has as many shards as its rows ask for; there are no more ids than the vocabulary has.
    counts = C.materialize(posts.groupBy("b", "a").agg(F.sum("links").alias("count"), F.count(F.lit(1)).alias("rows")), "alignment-counts")
    ids = counts.groupBy("b").agg(F.max("count").alias("top"), F.ceil(F.sum("rows") / F.lit(SHARD_ROWS)).cast("int").alias("shards"))
    ids = F.broadcast(C.materialize(ids, "alignment-ids"))
    long = lambda c: F.col(c).cast("long").alias(c)
    heads = counts.join(ids, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "a", long("count"), long("top"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("postings"))
    spread = posts.join(ids, "b").select("b", F.pmod(F.xxhash64("block"), F.col("shards")).cast("int").alias("shard"), "a", F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("top"), "block", "postings")
    stream = heads.unionByName(spread).repartition("b", "shard").sortWithinPartitions("b", "shard", "a", F.col("block").asc_nulls_first())
    given = stream.select("count", "top", "block", "postings").mapInArrow(_contributions, "block long, sums binary")
    known = blocks.where("place is not null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return known.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_summed, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12_tokenizer_alignment over the whole documents table."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
