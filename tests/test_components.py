"""Connected components against union-find on chains, stars and grids, with and without keys."""

import random

import pytest

from turnwise.shared import linked_components


def plain(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def chain(n, seed):
    ids = list(range(n + 1))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:], strict=False))


def grid(n):
    return [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + n + j) for i in range(n - 1) for j in range(n)]


@pytest.mark.parametrize("links", [chain(300, 1), chain(1000, 2), chain(5000, 3), [(7, i) for i in range(400)], grid(20), [(1, 1), (2, 3), (3, 2)], []], ids=["300", "1000", "5000", "star", "grid", "loops", "none"])
def test_components_equal_union_find(spark, links):
    got = linked_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = plain([x for x in links if x[0] != x[1]])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_keys_keep_components_apart(spark):
    rows = [("x", *e) for e in chain(60, 4)] + [("y", *e) for e in chain(60, 5) if e[0] % 7]
    got = {(r.k, r.node): r.component for r in linked_components(spark.createDataFrame(rows, "k string, a long, b long"), ("k",)).collect()}
    want = {(k, n): c for k in "xy" for n, c in plain([(a, b) for kk, a, b in rows if kk == k]).items()}
    assert got == want
