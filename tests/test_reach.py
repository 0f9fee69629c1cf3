"""Directed graphs: strong components, closures, and all sixteen kinds on a mixed collection, against plain searches."""

import random

from turnwise.operators import adjacency, local, paths, reach, solve


def closed(pairs, nodes):
    far = {n: {n} for n in nodes}
    while True:
        new = {n: set().union(*(far[y] for x, y in pairs if x == n), far[n]) for n in nodes}
        if new == far:
            return far
        far = new


def sample(seed, n, m):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    return nodes, [tuple(rng.sample(nodes, 2)) for _ in range(m)]


def test_components_searched_and_divided_equal_closures(spark):
    want, nodes, edges = {}, [], []
    for g, (n, m) in enumerate([(1, 0), (2, 2), (12, 10), (12, 16), (20, 30), (30, 35), (30, 90)]):
        ns, es = sample(g, n, m if n > 2 else 0)
        if n == 2:
            es = [("n0", "n1"), ("n1", "n0")]
        far = closed(es, ns)
        want |= {(g, x): min(y for y in ns if y in far[x] and x in far[y]) for x in ns}
        nodes += [(g, x) for x in ns]
        edges += [(g, *e) for e in es]
    chain = [f"c{i:03d}" for i in range(60)]  # of loops of two, linked in order
    edges += [(9, a, b) for i in range(0, 60, 2) for a, b in ((chain[i], chain[i + 1]), (chain[i + 1], chain[i]))] + [(9, chain[i], chain[i + 1]) for i in range(1, 59)]
    nodes += [(9, x) for x in chain]
    want |= {(9, x): chain[i // 2 * 2] for i, x in enumerate(chain)}
    node = spark.createDataFrame(nodes, "graph_id int, node_id string")
    adj = spark.createDataFrame([*edges, (0, "n0", "n0"), (1, "n0", "unlisted")], "graph_id int, src string, dst string")
    for held in (1000, 0):
        got = reach.strong_components(node, adj, ["graph_id"], held).collect()
        assert {(r.graph_id, r.node_id): r.component for r in got} == want and len(got) == len(nodes)


def test_long_cycle_and_long_chain_by_search():
    n = 50_000
    ring = low = reach.low_links([f"{i:06d}" for i in range(n)], [f"{(i + 1) % n:06d}" for i in range(n)])
    assert set(ring.values()) == {"000000"}
    low = reach.low_links([f"{i:06d}" for i in range(n)], [f"{i + 1:06d}" for i in range(n)])
    assert all(k == v for k, v in low.items()) and len(low) == n + 1


def test_closure_from_asked_nodes_only(spark):
    links = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "a"), (0, "d", "a"), (1, "a", "z")], "g int, a string, b string")
    starts = spark.createDataFrame([(0, "b"), (0, "b"), (1, "q"), (1, "a")], "g int, a string")
    assert sorted(map(tuple, reach.closure(starts, links, ["g"]).collect())) == [(0, "b", "a"), (0, "b", "b"), (0, "b", "c"), (1, "a", "a"), (1, "a", "z"), (1, "q", "q")]


def test_hops_beyond_three_are_all_counted(spark):
    nodes = spark.createDataFrame([("g", f"n{i}", f"N{i}", True) for i in range(8)], "graph_id string, node_id string, label string, is_open boolean")
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}", "r", 1.0) for i in range(7)], "graph_id string, src string, dst string, relation string, weight double")
    attrs = spark.createDataFrame([("g", f"n{i}", "c", "s:x" if i == 6 else "s:y", "x" if i == 6 else "y") for i in range(8)], "graph_id string, node_id string, name string, token string, text string")
    q = [(k, kind, "g", "n0", None, a, t, h) for k, (kind, a, t, h) in enumerate([
        ("within_hops_count", None, None, 4), ("within_hops_count", None, None, 6), ("within_hops_count", "c", "s:x", 5), ("within_hops_count", "c", "s:x", 60), ("within_hops_list", None, None, 5),
        ("most_common_attribute_within_hops", "c", None, 7), ("within_hops_count", None, None, 0), ("within_hops_count", None, None, None),
    ])]
    asked = spark.createDataFrame(q, "query_id int, kind string, graph_id string, source string, target string, attribute string, token string, hops int")
    got = {r.query_id: r.answer for r in solve.answer_queries(asked, nodes, edges, attrs).collect()}
    assert got == {0: "4", 1: "6", 2: "0", 3: "1", 4: "N1, N2, N3, N4, N5", 5: "y", 6: "2", 7: "2"}
    assert local.within_hops_count(asked.where("query_id = 0").drop("hops"), nodes, edges, hops=6).first().answer == "6"
    assert adjacency.hop_map(asked.select("graph_id", "source").distinct(), edges, None).count() == 7


def test_directed_and_undirected_graphs_side_by_side(spark):
    # The same edges in two graphs, one of them directed; c is closed.
    names = "abcde"
    es = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "e"), ("e", "d")]
    nodes = spark.createDataFrame([(g, n, n.upper(), n != "c") for g in "du" for n in names], "graph_id string, node_id string, label string, is_open boolean")
    edges = spark.createDataFrame([(g, x, y, "r", 1.0, g == "d") for g in "du" for x, y in es], "graph_id string, src string, dst string, relation string, weight double, directed boolean")
    attrs = spark.createDataFrame([(g, n, "k", "n:1" if n in "be" else "n:0", "1" if n in "be" else "0") for g in "du" for n in names], "graph_id string, node_id string, name string, token string, text string")
    asks = [
        ("reachability", "a", "d", None, None, None), ("reachability", "d", "a", None, None, None), ("reachability", "a", "c", None, None, None), ("shortest_path", "b", "e", None, None, None), ("path_cost", "e", "b", None, None, None),
        ("constrained_reachability", "a", "c", "k", "n:1", None), ("constrained_reachability", "c", "e", "k", "n:1", None), ("cycle_membership", "b", None, None, None, None), ("node_degree", "d", None, None, None, None),
        ("edge_exists", "b", "a", None, None, None), ("within_hops_list", "b", None, None, None, 2), ("filtered_neighbor_count", "d", None, "k", "n:1", None), ("reachability", "x", "a", None, None, None),
    ]
    rows = [(f"{g}{i}", kind, g, s, t, a, v, h) for g in "du" for i, (kind, s, t, a, v, h) in enumerate(asks)]
    got = {r.query_id: r.answer for r in solve.answer_queries(spark.createDataFrame(rows, "query_id string, kind string, graph_id string, source string, target string, attribute string, token string, hops int"), nodes, edges, attrs).collect()}
    assert [got[f"d{i}"] for i in range(len(asks))] == ["yes", "no", "no", "unreachable", "2", "no", "no", "no", "1", "no", "C, D", "1", "invalid"]
    assert [got[f"u{i}"] for i in range(len(asks))] == ["yes", "yes", "no", "3", "2", "no", "yes", "yes", "3", "yes", "A, C, D, E", "2", "invalid"]
    assert paths.cycle_membership(spark.createDataFrame([("d", "b")], "graph_id string, source string"), nodes, edges).first().answer == "no"
