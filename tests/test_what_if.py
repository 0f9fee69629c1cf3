"""The index of edits that change answers, against solving every edited graph."""

import random

from turnwise.operators import paths, quota, what_if

KINDS = what_if.KINDS


def graph(rng, n, m, parallel):
    nodes = {f"n{i}": rng.random() < 0.8 for i in range(n)}
    ends = [tuple(sorted(rng.sample(sorted(nodes), 2))) for _ in range(m)] if n > 1 else []
    edges = {(a, b, "track"): rng.choice((1.0, 1.0, 2.0, 0.1, 0.2, 0.3)) for a, b in ends}
    edges |= {(a, b, "transfer"): rng.choice((1.0, 2.0)) for a, b in ends[:parallel]}
    return nodes, edges


def answer(kind, s, t, nodes, edges):
    if kind == "node_degree":
        return sum((a == s) + (b == s) for a, b, _ in edges)
    if kind == "edge_exists":
        return any({a, b} == {s, t} for a, b, _ in edges)
    near = {}
    for (a, b, _), w in edges.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    if kind == "cycle_membership":
        for first in {y for y, _ in near.get(s, ())}:
            seen, walk = {s, first}, [first]
            while walk:
                for y, _ in near[walk.pop()]:
                    if y not in seen:
                        seen.add(y)
                        walk.append(y)
            if any(y in seen and y != first for y, _ in near[s]):
                return True
        return False
    if not (nodes[s] and nodes[t]):
        return False if kind == "reachability" else None
    live = {x: [(y, w) for y, w in ys if nodes[y]] for x, ys in near.items() if nodes[x]}
    cost = paths.nearest(live, s, {t}).get(t, (None,))[0]
    return cost is not None if kind == "reachability" else None if cost is None else round(cost, 6)


def edits(nodes, edges):
    for v, up in nodes.items():
        yield ("SET_CLOSED" if up else "SET_OPEN", v, None, None), {**nodes, v: not up}, edges
    for e in edges:
        yield ("DEL", *e), nodes, {k: w for k, w in edges.items() if k != e}
    joined = {k[:2] for k in edges}
    for a in nodes:
        for b in nodes:
            if a < b and (a, b) not in joined:
                yield ("ADD", a, b, None), nodes, {**edges, (a, b, "new"): 1.0}


def frames(spark, graphs):
    nodes = [(g, v, up) for g, (ns, _) in graphs.items() for v, up in ns.items()]
    rows = [(g, a, b, r, w) for g, (_, es) in graphs.items() for (a, b, r), w in es.items()]
    return spark.createDataFrame(nodes, "graph_id string, node_id string, is_open boolean"), spark.createDataFrame(rows, "graph_id string, src string, dst string, relation string, weight double")


def queries(graphs):
    return [(f"{g}/{k}/{s}/{t}", k, g, s, t) for g, (ns, _) in graphs.items() for k in KINDS for s in ns for t in ([None] if k in ("cycle_membership", "node_degree") else ns)]


SCHEMA = "query_id string, kind string, graph_id string, source string, target string"


def test_index_equals_solving_every_edited_graph(spark):
    rng = random.Random(3)
    sizes = [(1, 0, 0), (2, 1, 1), (4, 3, 0), (6, 5, 1), (7, 7, 0), (7, 9, 2), (8, 8, 0), (8, 12, 0), (9, 10, 1), (9, 7, 0)]
    graphs = {f"g{i}": graph(rng, *size) for i, size in enumerate(sizes)}
    ring = {f"n{i}": True for i in range(7)}  # a cycle with a chord and a tail: series of several edges
    graphs["ring"] = ring, {(a, b, "track"): 1.0 for a, b in [("n0", "n1"), ("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("n0", "n4"), ("n0", "n2"), ("n4", "n5"), ("n5", "n6")]}
    want = set()
    asked = queries(graphs)
    for g, (ns, es) in graphs.items():
        mine = [q for q in asked if q[2] == g]
        before = {q[0]: answer(q[1], q[3], q[4], ns, es) for q in mine}
        for edit, n2, e2 in edits(ns, es):
            want |= {(q[0], *edit) for q in mine if answer(q[1], q[3], q[4], n2, e2) != before[q[0]]}
    nodes, edges = frames(spark, graphs)
    extra = [("x1", "reachability", "g4", "n0", None), ("x2", "reachability", "g4", "zz", "n0"), ("x3", "path_cost", "g4", "n0", "zz"), ("x4", "node_count", "g4", "n0", None), ("x5", "node_degree", "none", "n0", None), ("x6", "node_degree", "g4", None, None)]
    rows = [tuple(r) for r in what_if.changing_edits(spark.createDataFrame(asked + extra, SCHEMA), nodes, edges).collect()]
    assert len(rows) == len(set(rows))
    got = set(rows)
    assert {k: sorted(map(repr, (x for x in want ^ got if f"/{k}/" in x[0])))[:5] for k in KINDS} == {k: [] for k in KINDS}
    assert got == want
    kinds = {(q.split("/")[1], op) for q, op, *_ in got}
    assert len(kinds) == 4 + 2 + 4 + 2 + 2


def test_no_queries_no_rows(spark):
    nodes, edges = frames(spark, {"g": ({"a": True}, {("a", "a", "r"): 1.0})})
    assert what_if.changing_edits(spark.createDataFrame([], SCHEMA), nodes, edges).count() == 0


def test_pairs_change_the_answer(spark):
    rng = random.Random(5)
    graphs = {f"g{i}": graph(rng, *size) for i, size in enumerate([(1, 0, 0), (6, 5, 1), (8, 9, 0), (9, 7, 0)])}
    nodes, edges = frames(spark, graphs)
    q = spark.createDataFrame(queries(graphs), SCHEMA)
    pairs = what_if.counterfactual_pairs(q, nodes, edges, 5, seed=1)
    rows = pairs.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, what_if.counterfactual_pairs(q, nodes, edges, 5, seed=1).collect()))
    said = lambda kind, x: {True: "yes", False: "no", None: "unreachable"}.get(x) if kind != "node_degree" and not isinstance(x, float) else f"{x:g}"
    n = {}
    for r in rows:
        ns, es = graphs[r.graph_id]
        n2, e2 = next((b, c) for e, b, c in edits(ns, es) if e == (r.op, r.a, r.b, r.relation))
        if r.kind in ("reachability", "path_cost"):
            assert ns[r.source] and ns[r.target]
        assert r.before == said(r.kind, answer(r.kind, r.source, r.target, ns, es))
        assert r.after == said(r.kind, answer(r.kind, r.source, r.target, n2, e2)) != r.before
        n[r.graph_id, r.kind] = n.get((r.graph_id, r.kind), 0) + 1
    assert max(n.values()) == 5 and len(n) >= 12
    both = {(r.before, r.after) for r in rows if r.kind == "reachability"}
    assert both == {("yes", "no"), ("no", "yes")}


def dealt(rows, needs):
    """The same fill by dealing row after row."""
    out = set()
    for g, need in needs.items():
        cells = {}
        for r in sorted(r for r in rows if r[0] == g and r[1] is not None):
            cells.setdefault(r[1], []).append(r)
        turn = 0
        while need > 0 and any(len(c) > turn for c in cells.values()):
            for k in sorted(cells):
                if need > 0 and len(cells[k]) > turn:
                    out.add(cells[k][turn])
                    need -= 1
            turn += 1
    return out


def test_levels_equal_dealing_in_turn(spark):
    rng = random.Random(7)
    rows = [(f"g{g}", rng.choice("aaaabbcd") if g else "a", i) for g in range(6) for i in range(g * 9 + 4)] + [("g1", None, 99), (None, "a", 98)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, c string, i int, _rank_of string")
    for k in (0, 1, 2, 3, 7, 13, 30, 48, 100):
        needs = {f"g{g}": k for g in range(5)}
        got = quota.level_fill(df, ["g"], "c", ["i"], spark.createDataFrame(list(needs.items()), "g string, need long"))
        assert got.columns == df.columns
        assert sorted(r[:3] for r in map(tuple, got.collect())) == sorted(dealt([r for r in rows if r[0]], needs))


def test_changed_quota_is_met(spark):
    rng = random.Random(9)
    rows = []
    for kind, changed, all_ in [("reachability", 30, 200), ("path_cost", 150, 200), ("node_count", 0, 20), ("edge_exists", 9, 9)]:
        for i in range(all_):
            new = i < changed
            gold = rng.choice(("yes", "yes", "yes", "no")) if kind in quota.YES_NO else str(rng.randrange(4))
            rows.append((len(rows) // 10, len(rows) % 10, kind, gold, gold + "!" if new else gold))
    rows.append((None, None, "path_cost", None, "1"))
    a = spark.createDataFrame(rows, "session_id long, turn_index long, kind string, gold string, stale string")
    out = quota.changed_quota(a).collect()
    side = lambda kind, ch: [r for r in out if r.kind == kind and r.changed == ch]
    for kind in ("reachability", "path_cost"):
        c, u = len(side(kind, True)), len(side(kind, False))
        assert c and abs(c - 0.45 * (c + u)) <= 1
    assert len(side("path_cost", False)) == 50 and len(side("node_count", False)) == 20
    for kind in ("reachability", "edge_exists"):
        golds = [r.gold for r in side(kind, True)]
        assert golds.count("yes") == golds.count("no")
    assert quota.changed_quota(a.limit(0)).count() == 0
