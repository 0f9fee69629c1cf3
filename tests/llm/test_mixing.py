"""Source mixing: the flow against a plain min-cost flow, water levels, quotas met to the word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from turnwise.llm import mixing


def least_cost(patterns, quotas, copies):
    """(flow, cost) of a greatest flow of least cost, one cheapest path after the other by Bellman-Ford."""
    edges = []  # from, to, room, cost

    def edge(a, b, room, cost):
        edges.append([a, b, room, cost])
        edges.append([b, a, 0, -cost])

    for p, (members, words) in enumerate(patterns):
        for r in range(copies):
            edge("S", p, words, (r + 1) ** 2 - r**2)
        for s in members:
            edge(p, s, 1 << 40, 0)
    for s, q in quotas.items():
        edge(s, "T", q, 0)
    flow = cost = 0
    while True:
        dist, back = {"S": 0}, {}
        for _ in range(len(patterns) + len(quotas) + 2):
            for i, (a, b, room, c) in enumerate(edges):
                if room and a in dist and dist[a] + c < dist.get(b, 1 << 60):
                    dist[b], back[b] = dist[a] + c, i
        if "T" not in dist:
            return flow, cost
        path, x = [], "T"
        while x != "S":
            path.append(back[x])
            x = edges[back[x]][0]
        push = min(edges[i][2] for i in path)
        for i in path:
            edges[i][2] -= push
            edges[i ^ 1][2] += push
        flow, cost = flow + push, cost + push * dist["T"]


def test_flow_is_greatest_at_least_cost():
    for seed in range(150):
        rng = random.Random(seed)
        names = "abcde"[: rng.randint(1, 5)]
        patterns = [(tuple(sorted(rng.sample(names, rng.randint(1, len(names))))), rng.randint(0, 20)) for _ in range(rng.randint(1, 7))]
        quotas, copies = {s: rng.randint(0, 30) for s in names}, rng.randint(1, 3)
        got = mixing.routed(patterns, quotas, copies)
        by_pattern, by_source = [0] * len(patterns), dict.fromkeys(names, 0)
        for (p, s), v in got.items():
            assert v > 0 and s in patterns[p][0]
            by_pattern[p] += v
            by_source[s] += v
        assert all(by_source[s] <= quotas[s] for s in names)
        assert all(v <= copies * w for v, (_, w) in zip(by_pattern, patterns, strict=True))
        cost = sum(((r + 1) ** 2 - r**2) * max(0, min(w, v - r * w)) for v, (_, w) in zip(by_pattern, patterns, strict=True) for r in range(copies))
        assert (sum(got.values()), cost) == least_cost(patterns, quotas, copies)


def levelled(sizes, weights, budget, copies):
    """Targets by sharing out again and again what is above."""
    target, open_, left = {}, dict(zip(sizes, weights, strict=True)), budget
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > copies * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = copies * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 0) for i, s, t in rows], "doc_id long, source string, text string, size string, taken int")


def test_one_source_a_document(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["web", "web", "web", "é", "Zeta", "a", None, "b", "c"]), " ".join("w" * rng.randint(1, 40))) for i in range(400)]
    rows += [(900, "web", None), (901, "only null", None), (902, "a", "  "), (903, "b", ""), (904, "c", "one"), (904, "c", "one"), (None, "b", "x y"), (905, "long", "w " * 30_000)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = levelled({s: size[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2)
    taken = dict.fromkeys(size, 0)
    for r in got:
        (part,) = r.parts
        assert part.source == r.members[0] and part.source_size == size[part.source] and part.taken == r.taken
        assert part.target == pytest.approx(want[part.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[part.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mixing.mix(table(spark, rows).repartition(9)).collect()
    assert sorted(str((r.doc_id, r["size"], r.taken)) for r in again if r.doc_id != 904) == sorted(str((r.doc_id, r["size"], r.taken)) for r in got if r.doc_id != 904)


def test_overlapping_sources_fill_quotas_and_repeat_as_little_as_they_can(spark):
    rng = random.Random(5)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["c", "a", "b"], ["d"], ["e", "f"], None, []]
    rows = [(i, rng.choice(kinds), "w " * rng.randint(0, 30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, text string")
    got = mixing.mix(docs, F.col("sources"), weights=(3, 1)).collect()
    patterns, by_pattern, by_source, target = {}, {}, {}, {}
    for r in got:
        key = tuple(sorted((f"={s}" if s is not None else "") for s in r.members))
        patterns[key] = patterns.get(key, 0) + r["size"]
        by_pattern[key] = by_pattern.get(key, 0) + r.taken
        assert sum(p.taken for p in r.parts) == r.taken <= 2 * r["size"]
        for p in r.parts:
            s = f"={p.source}" if p.source is not None else ""
            by_source[s] = by_source.get(s, 0) + p.taken
            target[s] = p.target
    quotas = {s: int(t + 0.5) for s, t in target.items()}
    flow, cost = least_cost(sorted(patterns.items()), quotas, 2)
    assert sum(by_source.values()) == flow and all(by_source[s] <= quotas[s] for s in quotas)
    assert sum(min(v, patterns[k]) + 3 * max(0, v - patterns[k]) for k, v in by_pattern.items()) == cost


def test_everything_is_taken_where_the_budget_allows(spark):
    rows = [(1, "a", "x y z"), (2, "b", "x"), (3, None, "x y")]
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(table(spark, rows), budget=5.0).collect()) == [(1, 6), (2, 2), (3, 4)]


def test_empty_table_and_texts_without_words(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    assert [(r.taken, r.parts[0].target) for r in mixing.mix(table(spark, [(1, "a", None), (2, "b", " \t")])).collect()] == [(0, 0.0), (0, 0.0)]
