"""All sixteen kinds of question over a collection of graphs, each kind (or several that share their work) as one plan for all its queries."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settle, shared_dir
from . import local, paths

#: The kinds of question.
KINDS = (
    "shortest_path", "reachability", "filtered_neighbor_count", "filtered_path_count", "cycle_membership", "edge_exists", "node_degree", "node_count",
    "path_cost", "link_prediction", "constrained_reachability", "within_hops_count", "within_hops_list", "most_common_attribute_within_hops", "attribute_lookup", "attribute_check",
)
#: Kinds that ask about a pair of nodes, and those that must name an attribute.
PAIRS = frozenset({"shortest_path", "reachability", "filtered_path_count", "edge_exists", "path_cost", "link_prediction", "constrained_reachability"})
NAMED = frozenset({"filtered_neighbor_count", "filtered_path_count", "constrained_reachability", "most_common_attribute_within_hops", "attribute_lookup", "attribute_check"})

_PLANS = {
    "shortest_path filtered_path_count path_cost": paths.path_questions,
    "reachability": lambda q, n, e, a: paths.reachability(q, n, e),
    "filtered_neighbor_count": local.filtered_neighbor_count,
    "cycle_membership": lambda q, n, e, a: paths.cycle_membership(q, n, e),
    "edge_exists link_prediction": lambda q, n, e, a: local.edge_exists(q, n, e),
    "node_degree": lambda q, n, e, a: local.node_degree(q, n, e),
    "node_count": lambda q, n, e, a: local.node_count(q, n),
    "constrained_reachability": paths.constrained_reachability,
    "within_hops_count": local.within_hops_count,
    "within_hops_list": local.within_hops_list,
    "most_common_attribute_within_hops": local.most_common_attribute,
    "attribute_lookup": lambda q, n, e, a: local.attribute_lookup(q, n, a),
    "attribute_check": lambda q, n, e, a: local.attribute_check(q, n, a),
}


def answer_queries(queries: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(query_id, answer) of every query (query_id, kind, graph_id, source, target, attribute, token, hops).

    Each kind sees only the graphs that its queries ask about, and all kinds are answered side by side. A query that lacks the target or the
    attribute its kind needs is invalid, and so is one whose source is not in its graph. With kinds
    given, queries are of these only, and nothing is planned for others.
    """
    plans = {k: f for k, f in _PLANS.items() if set(kinds) & set(k.split())}

    def one(kinds: str, plan) -> DataFrame:
        q = queries.where(F.col("kind").isin(*kinds.split()))
        about = q.select("graph_id").distinct()
        n, e, a = (t.join(about, "graph_id", "left_semi") for t in (nodes, edges, attrs))
        answer = F.when(F.col("attribute").isNull() & F.col("kind").isin(*NAMED), "invalid").otherwise(F.col("answer"))
        return settle(plan(q, n, e, a).select("query_id", answer.alias("answer")), "kind-answers")

    # The plans don't depend on each other, and the rounds of one leave executors idle that another can use.
    shared_dir(spark := queries.sparkSession)
    with ThreadPoolExecutor(len(plans)) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(one), plans, plans.values()))
    return functools.reduce(DataFrame.unionByName, parts)
