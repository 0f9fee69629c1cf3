"""Benchmark decontamination by the CGK random-walk embedding and bit-sampling LSH.

Texts are lower-cased word sequences. A benchmark item of n words is held against passages of every
document, up to edit distance floor(MAX_EDIT_SHARE * n) in words. The CGK embedding walks through a
sequence of n words, writes the word it stands on and moves on by a random bit that depends on the
step and the word; sequences a few edits apart soon walk in step again, so edit distance becomes
Hamming distance. Of WALKS such walks each of REPEATS tables samples BITS places; a window and an
item that agree on one table's sample are a candidate, and candidates are verified by exact edit
distance.

Not every window need be embedded. One within the bound keeps at least one word triple of its item
(n - 2 triples, of which an edit spoils three at most), and the triple's place in the item names
where the window starts. So the item-sized windows of a text are those at the starts that its word
triples imply, of whichever item; the tables alone decide which of them are candidates, and for
which item. REPEATS is chosen so that a window at the bound is found with TARGET_RECALL or more
(measured in the tests); closer ones are found more surely, exact ones always.

With free ends, as op10 and the pipeline search, a passage may be shorter or longer than the item:
a candidate's place is held against the item by an edit distance with free start and end, so an
inserted or deleted word costs one edit. A passage with several surviving triples has a window at
each start that they imply, and needs only one of them to be found.

Items under EXACT_WORDS words count only where they stand word for word, those under GRAM words by
a look-up of their own, as they have no triple. Whole texts are searched within map tasks and
nothing but matches leaves them. Items are sent to the tasks in blocks of a fixed size, one after
the other, so the benchmark may grow without bound; windows are embedded in groups of a fixed
number of places, so an item may be as long as it likes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MAX_EDIT_SHARE, TARGET_RECALL = 0.2, 0.95
REPEATS, BITS, WALKS, SEED = 192, 3, 64, 97
#: Items under EXACT_WORDS words count only where they stand word for word.
EXACT_WORDS, GRAM = 8, 3
#: Items are searched in blocks of at most this many characters, windows embedded in groups of this many places.
BLOCK_CHARS, GROUP_PLACES = 2_000_000, 300_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def edit_bound(n: int) -> int:
    return 0 if n < EXACT_WORDS else int(MAX_EDIT_SHARE * n)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1; only a band of the table is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    prev = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(lo, hi + 1):
            row[j] = min(prev[j - 1] + (x != b[j - 1]), prev[j] + 1, row[j - 1] + 1)
        if min(row[max(0, lo - 1) : hi + 1]) > most:
            return far
        prev = row
    return min(prev[len(b)], far)


def end_distances(item: list[int], words: list[int], anchored: bool = False) -> list[int]:
    """For each place j of words: the least edit distance of item to any stretch that ends before j, wherever it starts, or from the first word if anchored.

    Myers' bit-parallel form of the table, one big integer a column.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    same: dict[int, int] = defaultdict(int)
    for i, x in enumerate(item):
        same[x] |= 1 << i
    up, down, d = full, 0, n
    out = [n]
    for x in words:
        eq = same.get(x, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(h | up)) & full, up & h
        d += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | anchored, minus << 1
        up, down = (minus | ~(v | plus)) & full, plus & v & full
        out.append(d)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk_keys(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(rows, REPEATS) LSH keys of word sequences: samples of their CGK embeddings.

    Rows are padded to one width; sequences of different length share no key. Samples come from
    the first 2n of 3n steps: beyond, most walks stand past the end and agree by default.
    """
    m, width = rows.shape
    out = np.zeros((m, REPEATS), np.uint64)
    rng = np.random.default_rng(SEED)
    share = rng.random((REPEATS, BITS))
    walk_of = np.arange(REPEATS) % WALKS
    step_seed = np.random.default_rng([SEED, 1]).integers(1, 1 << 62, size=2 * width + 1).astype(np.uint64)
    x = np.hstack([np.where(np.arange(width) < lengths[:, None], rows.astype(np.int64), -1), np.full((m, 1), -1)]).astype(np.uint64)
    spread = x * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(lengths, kind="stable")
    s = 0
    while s < m:
        # As many rows as fit the group with the steps of the longest.
        e = s + 1
        while e < m and (e + 1 - s) * 2 * int(lengths[order[e]]) <= GROUP_PLACES:
            e += 1
        some = order[s:e]
        own, mixed, n = x[some], spread[some], lengths[some]
        steps = int(2 * n.max())
        line = np.arange(len(own))[:, None]
        at = np.zeros((len(own), WALKS), np.int32)
        path = np.empty((steps, len(own), WALKS), np.int32)
        walk = np.arange(WALKS, dtype=np.uint64)
        for step in range(steps):
            path[step] = at
            with np.errstate(over="ignore"):
                bit = (_mix(mixed[line, at] + step_seed[step]) >> walk) & np.uint64(1)
            at = np.minimum(at + bit.astype(np.int32), n[:, None].astype(np.int32))
        keys = np.repeat(n.astype(np.uint64)[:, None], REPEATS, axis=1)
        for k in range(BITS):
            place = (share[:, k] * 2 * n[:, None]).astype(np.int64)
            with np.errstate(over="ignore"):
                keys = _mix(keys * np.uint64(31) + own[line, path[place, line, walk_of]] + np.uint64(1) + np.arange(REPEATS, dtype=np.uint64))
        out[some] = keys
        s = e
    return out


class Items:
    """One block of benchmark items, ready to search: vocabulary, word triples and LSH keys."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        #: Items too short for a triple, by their words.
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            if len(w) >= GRAM:
                self.items.append((item_id, w))
            elif w:
                self.short[tuple(w)].append(item_id)
        self.base = len(self.vocab) + 1
        grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            for i in range(len(w) - GRAM + 1):
                grams[self._code(w[i], w[i + 1], w[i + 2])].append((k, i))
        self.codes = np.array(sorted(grams), np.int64)
        rows = [grams[c] for c in self.codes.tolist()]
        self.first = np.cumsum([0, *map(len, rows)])
        self.item_of = np.array([k for r in rows for k, _ in r], np.int64)
        self.offset_of = np.array([i for r in rows for _, i in r], np.int64)
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        self.bound = np.array([edit_bound(len(w)) for _, w in self.items], np.int64)
        keys = []
        for at in range(0, len(self.items), 1000):
            some = self.items[at : at + 1000]
            width = max(len(w) for _, w in some)
            keys.append(cgk_keys(np.array([w + [-1] * (width - len(w)) for _, w in some], np.int64), self.length[at : at + 1000]))
        keys = np.concatenate(keys).ravel() if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_item = keys[order], (order // REPEATS).astype(np.int32)

    def _code(self, a, b, c):
        return (a * self.base + b) * self.base + c

    def words(self, text: str | None) -> np.ndarray:
        """The text's words as numbers of the vocabulary, 0 for others."""
        get = self.vocab.get
        return np.array([get(x, 0) for x in words_of(text)], np.int64)

    def starts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and starts of the item-sized windows that the word triples of w imply."""
        none = np.zeros(0, np.int64)
        if not len(self.codes) or len(w) < GRAM:
            return none, none
        (known,) = np.nonzero((w[:-2] > 0) & (w[1:-1] > 0) & (w[2:] > 0))
        code = self._code(w[known], w[known + 1], w[known + 2])
        at = np.searchsorted(self.codes, code)
        hit = self.codes[np.minimum(at, len(self.codes) - 1)] == code
        place, at = known[hit], at[hit]
        if not len(place):
            return none, none
        n = self.first[at + 1] - self.first[at]
        own = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(self.first[at], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        size, start = self.length[self.item_of[entry]], place[own] - self.offset_of[entry]
        return np.unique(np.stack([size, np.clip(start, 0, len(w) - 1)], axis=1), axis=0).T

    def candidates(self, texts: list[str | None], around: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """The texts' words, and rows (text, start, item) of windows that share a key with an item.

        around: also windows up to the item's bound before and after the implied starts.
        """
        parts = [self.words(t) for t in texts]
        rows = []
        for t, w in enumerate(parts):
            size, start = self.starts(w)
            if around and len(size):
                bound = np.where(size < EXACT_WORDS, 0, (MAX_EDIT_SHARE * size).astype(np.int64))
                reach = 2 * bound + 1
                row = np.repeat(np.arange(len(size)), reach)
                start = start[row] - bound[row] + np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
                size, start = np.unique(np.stack([size[row], np.clip(start, 0, len(w) - 1)], axis=1), axis=0).T
            rows.append(np.stack([np.full(len(size), t), size, start], axis=1))
        rows = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        rows = rows[np.argsort(rows[:, 1], kind="stable")]
        out = [np.zeros((0, 3), np.int64)]
        at = 0
        while at < len(rows):
            some = rows[at : at + max(1, min(4000, GROUP_PLACES // int(rows[at, 1])))]
            at += len(some)
            n = some[:, 1]
            windows = np.full((len(some), int(n.max())), -2, np.int64)
            for r, (t, size, start) in enumerate(some.tolist()):
                x = parts[t][start : start + size]
                windows[r, : len(x)] = x
            # One embedding for windows of the same words.
            kinds, back = np.unique(np.column_stack([n, windows]), axis=0, return_inverse=True)
            keys = cgk_keys(kinds[:, 1:], kinds[:, 0]).ravel()
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            (met,) = np.nonzero(hi > lo)
            times = hi[met] - lo[met]
            entry = np.repeat(lo[met], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs = np.unique(np.stack([np.repeat(met // REPEATS, times), self.key_item[entry]], axis=1), axis=0)
            # Every window of a kind has the kind's candidates.
            first, last = np.searchsorted(pairs[:, 0], back.ravel(), "left"), np.searchsorted(pairs[:, 0], back.ravel(), "right")
            times = last - first
            row = np.repeat(np.arange(len(some)), times)
            entry = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append(np.stack([some[row, 0], some[row, 2], pairs[entry, 1]], axis=1))
        found = np.concatenate(out)
        # A key also holds the length, but may be shared by chance.
        return parts, found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]

    def _short(self, w: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, first word, words, 0) wherever an item of fewer than GRAM words stands."""
        out = []
        for size in {len(k) for k in self.short}:
            for at in range(len(w) - size + 1) if len(w) >= size else ():
                for item_id in self.short.get(tuple(w[at : at + size].tolist()), ()):
                    out.append((item_id, at, size, 0))
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, first word, words, distance) of each verified window of as many words as the item.

        Of windows of one item that overlap the closest is given, the first among equals.
        """
        parts, rows = self.candidates(texts, around=True)
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for t, start, k in rows.tolist():
            size, bound = int(self.length[k]), int(self.bound[k])
            window = parts[t][start : start + size].tolist()
            d = edit_distance(self.items[k][1], window + [-2] * (size - len(window)), bound)
            if d <= bound:
                found[t].append((d, start, k, len(window)))
        return [sorted(self._apart(f) + self._short(w)) for f, w in zip(found, parts, strict=True)]

    def search_free(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, first word, words, distance) of each stretch within the bound, of whatever length.

        A stretch starts at most as many words from a start that one of its triples implies as the
        bound has edits, so the region about a candidate window holds it, and the edit distance
        with free ends finds it there. Of stretches of one item that overlap the closest is given,
        the first among equals.
        """
        parts, rows = self.candidates(texts)
        out: list[list[tuple[int, int, int, int]]] = [self._short(w) for w in parts]
        regions: list[list[int]] = []
        for t, s, k in rows.tolist():
            slack = 2 * int(self.bound[k])
            lo, hi = max(0, s - slack), min(len(parts[t]), s + int(self.length[k]) + slack)
            if regions and regions[-1][:2] == [t, k] and lo <= regions[-1][3]:
                regions[-1][3] = max(hi, regions[-1][3])
            else:
                regions.append([t, k, lo, hi])
        for t, k, lo, hi in regions:
            own, bound, words = self.items[k][1], int(self.bound[k]), parts[t][lo:hi].tolist()
            ends = sorted((d, j) for j, d in enumerate(end_distances(own, words)) if d <= bound)
            taken: list[tuple[int, int]] = []
            for d, end in ends:
                if any(a < end <= b for a, b in taken):
                    continue
                # Of the stretches with this end and distance, the one whose length is closest to the item's.
                sizes = end_distances(own[::-1], words[max(0, end - len(own) - d) : end][::-1], anchored=True)
                size = min((m for m, x in enumerate(sizes) if x == d and m), key=lambda m: abs(m - len(own)))
                if all(end - size >= b or end <= a for a, b in taken):
                    taken.append((end - size, end))
                    out[t].append((self.items[k][0], lo + end - size, size, d))
        return [sorted(x) for x in out]

    def _apart(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        out = []
        taken: dict[int, list[int]] = defaultdict(list)
        for d, s, k, size in sorted(found):
            if all(abs(s - t) >= len(self.items[k][1]) for t in taken[k]):
                taken[k].append(s)
                out.append((self.items[k][0], s, size, d))
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters, one after the other: the benchmark is the query set."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(chars) // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in sorted(rows.where(part == i).collect())]


def contaminated(docs: DataFrame, benchmark: DataFrame, free_ends: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): a row for each passage of docs within the edit bound of an item.

    A passage has as many words as the item; with ``free_ends`` it may have any number of words.
    Every item with a word is searched, one under EXACT_WORDS words word for word. A benchmark of
    several blocks is searched block by block, and a block's matches are written before the next.

    Null and empty texts on either side match nothing; rows of docs with a null doc_id are searched
    and keep it; repeated documents and items give repeated rows. Empty tables give no rows, other
    columns are ignored.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts: list[DataFrame] = []
    held = None
    for block in item_blocks(benchmark, block_chars):
        if held is not None:
            parts[-1] = C.materialize(parts[-1], "leaks-block")
            held.destroy()
        held = spark.sparkContext.broadcast(Items(block))

        def each(batches: Iterator[pa.RecordBatch], shared=held) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    hits = (items.search_free if free_ends else items.search)(part.column(1).to_pylist())
                    rows = [(i, *hit) for i, own in zip(part.column(0).to_pylist(), hits, strict=True) for hit in own]
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "first_word", "n_words", "distance"])

        parts.append(src.mapInArrow(each, "doc_id long, item_id long, first_word long, n_words long, distance long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, free_ends: bool = False) -> DataFrame:
    """docs without the documents that hold a passage of the benchmark. Rows with a null doc_id stay."""
    own = C.own_name(docs, "_leak")
    leaks = contaminated(docs.select("doc_id", "text"), benchmark, free_ends).where("doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(C.materialize(leaks, "leaks"), F.col("doc_id").cast("long") == F.col(own), "left_anti")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10_benchmark_decontamination over the whole documents and benchmark tables."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), free_ends=True)
