"""Near-dedup of the pipeline against a comparison of all pairs of shingle sets."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from turnwise.llm import _common as common
from turnwise.llm import shingle_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def smallest_of_each_group(texts):
    """The smallest number of each component of the pairs of similarity 0.8 or more."""
    part = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if part[i] != part[j] and jaccard(texts[i], texts[j]) >= 0.8:
            low, high = sorted((part[i], part[j]))
            part = [low if p == high else p for p in part]
    return set(part)


def test_documents_of_similarity_0_8_go(spark):
    rng = random.Random(4)
    texts = []
    for size in [12, 30, 60, 120, 250] * 12:
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(3):  # 0 to 6 % of the words changed: similarities on both sides of 0.8
            own = [f"x{rng.randrange(3000)}" if rng.random() < rng.choice([0.005, 0.02, 0.06]) else w for w in base]
            texts.append(" ".join(own))
    rng.shuffle(texts)
    want = smallest_of_each_group(texts)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert len(want) < 0.7 * len(texts)
    assert len(kept ^ want) <= 0.01 * len(texts)


def test_a_bucket_of_many_copies_and_a_chain_beside_it(spark):
    """Neighbours of the chain are similar and its ends are not, so that one leader cannot link them all."""
    rng = random.Random(5)
    w = [f"w{i}" for i in range(400)]
    chain = [" ".join(w[k : k + 200]) for k in range(0, 200, 10)]
    copies = [" ".join([*(f"c{i}" for i in range(150)), f"end{k}"]) for k in range(300)]
    texts = [*chain, *copies]
    rng.shuffle(texts)
    want = smallest_of_each_group(texts)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(1000, None, "en", "a", 0), (1001, " ", "en", "a", 1), (None, texts[0], "en", "a", 1), (0, texts[0], "en", "a", 1), (0, "another text under the same number", "en", "a", 1)]
    kept = shingle_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept)
    assert len(want) == 2 and ids == sorted([*want, 0, 1000, -1])
    assert shingle_dedup.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_crowd_of_texts_below_the_bound(spark):
    """Copies of one text with words changed: most pairs of them are less than similar, some are not."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{rng.randrange(3000)}" if rng.random() < rng.choice([0.01, 0.03, 0.04]) else w for w in base) for _ in range(220)]
    want = smallest_of_each_group(texts)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in shingle_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 10 < len(want) < 200 and kept == want


def test_keys_are_the_golay_codewords_that_agree_best_with_the_sums():
    """Held against all 4,096 codewords, made from the generator polynomial, and against sums bit by bit."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    sums = shingle_dedup.bit_sums(x)
    for i in (0, 63, 64, 500, 959):
        word = np.uint64((i // 64 + 1) * int(shingle_dedup._MULTIPLIER) % (1 << 64))
        h = shingle_dedup._mix(x + word).view(np.uint8).reshape(-1, 8)
        assert sums[i] == sum(1 if h[k, i % 64 // 8] >> (7 - i % 8) & 1 else -1 for k in range(len(x)))
    words = {0}
    for i in range(12):
        words |= {w ^ (0b101011100011 << i) for w in words}
    by_index = {w >> 11: w for w in words}
    assert len(by_index) == 4096
    sign = np.array([[1 if by_index[i] >> b & 1 else -1 for b in range(23)] for i in range(4096)])
    keys = shingle_dedup.golay_keys(sums[None].repeat(20, 0), np.full(20, 40))[11]
    m = np.rint(sums * 1024 / 40**0.5)
    for t in range(shingle_dedup.TABLES):
        one, two = (sign @ m[46 * t + at : 46 * t + at + 23] for at in (0, 23))
        best = np.sort((one[:, None] + two[None, :]).ravel())[-4:][::-1]
        got = keys[4 * t : 4 * t + 4]
        assert (got >> 24 == t).all() and (one[got >> 12 & 4095] + two[got & 4095] == best).all()


def test_golay_keys_find_nearly_all_pairs_at_0_8():
    """Sets of equal and unequal size at the bound and of few and many shingles; hardly any pair of unlike sets meets."""
    rng = np.random.default_rng(5)
    for shared, left, right in ((8, 1, 1), (4, 0, 1), (80, 10, 10), (80, 0, 20), (400, 50, 50)):
        sets = []
        for _ in range(1000):
            x = rng.integers(0, 1 << 64, shared + left + right, dtype=np.uint64)
            sets += [x[: shared + left], np.concatenate([x[:shared], x[shared + left :]])]
        sums = np.stack([shingle_dedup.bit_sums(x) for x in sets])
        keys = shingle_dedup.golay_keys(sums, np.array([len(x) for x in sets]))
        more = np.unpackbits(shingle_dedup.further_bits(sums).view(np.uint8), axis=1)

        def met(a, b):
            return (keys[a][:, :, None] == keys[b][:, None, :]).any((1, 2)) & ((more[a] != more[b]).sum(1) <= shingle_dedup.CHECK)  # noqa: B023

        assert met(slice(0, None, 2), slice(1, None, 2)).mean() >= 0.997
        assert met(slice(0, -2, 2), slice(3, None, 2)).mean() <= 0.001


def test_workers_get_few_texts_at_a_time(spark, monkeypatch):
    """All tables of the stage are written under the small batches, and the session's own size is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, materialize = spark.conf.get(name), {}, common.materialize

    def noted(df, table, *args):
        seen[table] = int(spark.conf.get(name))
        return materialize(df, table, *args)

    monkeypatch.setattr(common, "materialize", noted)
    rows = [(i, f"one text of some few words under the number {i // 2}", "en", "a", 1) for i in range(40)]
    assert shingle_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).count() == 20
    assert {"shingle-signatures", "shingle-sets", "shingle-star", "shingle-links"} <= set(seen)
    assert set(seen.values()) == {256} and spark.conf.get(name) == before

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    with common.small_batches(spark, 256):
        got = [r.n for r in spark.range(0, 2000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 2000 and max(got) <= 256


def test_a_unit_of_a_crowd_takes_little_memory(monkeypatch):
    """256 sets of which few hashes are shared, and sets that need several tiles, against a comparison set by set."""
    rng = np.random.default_rng(7)
    wide = [np.unique(rng.integers(0, 1 << 63, 700, dtype=np.uint64)) for _ in range(254)]
    wide += [wide[0][:600], np.concatenate([wide[1][70:], wide[2][:5]])]
    wide[-1].sort()
    tracemalloc.start()
    got = shingle_dedup.similar_pairs(wide)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    assert {(i, j) for i, j in zip(*np.nonzero(got), strict=True) if i < j} == {(0, 254), (1, 255)}

    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < share, rng.integers(0, 1 << 63, 300, dtype=np.uint64), base)) for share in np.linspace(0, 0.3, 40)]
    want = [[len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) for y in sets] for x in sets]
    for entries in (1, 1000, 4_000_000):
        monkeypatch.setattr(shingle_dedup, "MATRIX", entries)
        assert (shingle_dedup.similar_pairs(sets) == want).all()
