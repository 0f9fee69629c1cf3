"""Vector codes against exhaustive integers: the filter, the rounds, odd rows."""

import hashlib
import math

import numpy as np

from turnwise.llm import vector_codes as V


def exhaustive(x, entries):
    """(index, distance) by Python's integers."""
    out = []
    for row in x.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in entries.tolist()]
        out.append((d.index(min(d)), min(d)))
    return out


def test_nearest_equals_exhaustive_search_with_ties_and_large_integers():
    rng = np.random.default_rng(1)
    for length in (1, 2, 3, 6, 8, 16, 24):
        for spread in (2, 50, 4096, 1 << 23, 1 << 40, V.END):
            x = rng.integers(-spread, spread + 1, (60, length))
            entries = rng.integers(-spread, spread + 1, (16, length))
            entries[9] = entries[4]  # a tie goes to the lower index
            x[:8] = entries[4:12]
            x[8] = 0
            index, dist = V.nearest(x, entries)
            assert list(zip(index.tolist(), [int(v) for v in dist], strict=True)) == exhaustive(x, entries)


def test_bounds_stay_below_exact_distances_and_spare_most_of_them():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4096, 4097, (16, 8))
    x = centres[rng.integers(0, 16, 500)] + rng.integers(-300, 301, (500, 8))
    rows, cols = np.repeat(np.arange(500), 16), np.tile(np.arange(16), 500)
    exact = V._exact(x, centres, rows, cols)
    assert V.levels(8) == [1, 2, 4]
    for blocks in V.levels(8):
        assert (V._bounds(x, centres, rows, cols, blocks) <= exact).all()
    tally = {}
    V.nearest(x, centres, tally)
    assert tally["exact"] < tally["pairs"] * 0.3


def test_bounds_hold_for_near_equal_vectors_far_from_zero():
    base = np.full((1, 16), (1 << 23) - 5)
    x = base + np.arange(40)[:, None] % 3
    entries = base + np.arange(16)[:, None] % 5
    rows, cols = np.repeat(np.arange(40), 16), np.tile(np.arange(16), 40)
    for blocks in V.levels(16):
        assert (V._bounds(x, entries, rows, cols, blocks) <= V._exact(x, entries, rows, cols)).all()


def plain(rows, parts, entries, rounds, scale):
    """What compress() promises, by loops over (vec_id, label, vector)."""
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    ints = [[math.floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for _, _, v in kept]
    least = {}
    for (i, _, v), x in zip(kept, ints, strict=True):
        if i not in least or v < least[i][0]:
            least[i] = (v, x)
    first = [least[i][1] for i in sorted(least, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)]

    def assign():
        return [[(e := exhaustive(np.array([x[p * width : (p + 1) * width]], object), np.array(books[p], object))[0]) for p in range(parts)] for x in ints]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for c in range(len(first)):
                own = [x[p * width : (p + 1) * width] for x, code in zip(ints, codes, strict=True) if code[p][0] == c]
                if own:
                    books[p][c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes, by_label = assign(), {}
    errors = [sum(d for _, d in c) for c in codes]
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c, _ in code), e, by_label[label], sha) for (i, label, _), code, e in zip(kept, codes, errors, strict=True)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")
    return sorted((tuple(r) for r in V.compress(df, **more).collect()), key=str)


def test_rows_equal_a_plain_fit_with_odd_rows_among_them(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 3, int(rng.integers(0, 4)) or None, rng.normal(size=16).tolist()) for i in range(80)]
    rows += [(500, 1, None), (501, 1, [None] * 16), (502, 2, [float("nan")] + [0.0] * 15), (503, 2, [float("-inf")] * 16)]
    rows += [rows[0], rows[5], (0, 3, [0.5] * 16), (None, None, [0.25] * 16), (504, 3, [1.0, -1.0, 0.5]), (505, 3, []), (-7, 3, [0.0] * 16)]
    assert run(spark, rows, rounds=3) == plain(rows, 8, 16, 3, 4096)


def test_large_components_are_exact_and_end_where_said(spark):
    rows = [(i, 0, [(i + 1) * 1e5, -3.0, 2.0, 1.0] * 2) for i in range(6)]
    assert run(spark, rows, rounds=2) == plain(rows, 8, 16, 2, 4096)
    got = run(spark, [(1, 0, [1e300, -1e300]), (2, 0, [1e-300, -1e-300])], parts=2, entries=1, rounds=0)
    assert [r[:3] for r in got] == [(1, "0000", 0), (2, "0000", None)]  # 2 * 2^124 is no long


def test_empty_table_and_no_finite_vector(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, None), (2, 1, [float("nan")])]) == []


def test_float_vectors_as_in_the_table(spark):
    df = spark.createDataFrame([(i, i % 2, [0.1 * i, -0.1 * i, 0.3, 0.7] * 2) for i in range(30)], "vec_id long, label int, embedding array<float>")
    rows = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in df.collect()]
    assert sorted((tuple(r) for r in V.compress(df).collect()), key=str) == plain(rows, 8, 16, 6, 4096)
