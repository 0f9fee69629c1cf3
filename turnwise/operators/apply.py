"""Edit programs applied to graphs edit by edit, for programs that a window over keys cannot express.

A node that is added or deleted changes what later edits may touch, so a program is a fold. Each
graph is folded in one task together with its program; graphs and programs are small, and there are
many. Where the node set is fixed, sessions.states gives the same states without a fold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import prepare

_ROW = "what string, pos long, node_id string, label string, name string, token string, text string, src string, dst string, relation string, weight double, applied boolean, error string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


class Held:
    """One graph in memory: nodes by id, their attributes, undirected edges by ends and relation."""

    def __init__(self, rows: list[dict]):
        self.nodes = {r["node_id"]: r["label"] for r in rows if r["what"] == "node"}
        self.attrs: dict[str, dict[str, tuple[str | None, str | None]]] = {}
        for r in rows:
            if r["what"] == "attribute":
                self.attrs.setdefault(r["node_id"], {})[r["name"]] = (r["token"], r["text"])
        self.edges = {edge_key(r["src"], r["dst"], r["relation"]): (r["src"], r["dst"], r["weight"]) for r in rows if r["what"] == "edge"}
        self.near: dict[str, set[tuple[str, str, str]]] = {}
        for k in self.edges:
            for end in k[:2]:
                self.near.setdefault(end, set()).add(k)

    def has_node(self, node: str) -> bool:
        return node in self.nodes

    def add_node(self, node: str, label: str) -> None:
        self.nodes[node] = label

    def drop_node(self, node: str) -> None:
        for k in list(self.near.get(node, ())):
            self.drop_edge(k)
        self.attrs.pop(node, None)
        del self.nodes[node]

    def token(self, node: str, name: str) -> str | None:
        return self.attrs.get(node, {}).get(name, (None, None))[0]

    def set_attribute(self, node: str, name: str, token: str | None, text: str | None) -> None:
        self.attrs.setdefault(node, {})[name] = (token, text)

    def has_edge(self, key: tuple[str, str, str]) -> bool:
        return key in self.edges

    def add_edge(self, key: tuple[str, str, str], src: str, dst: str, weight: float) -> None:
        self.edges[key] = (src, dst, weight)
        for end in key[:2]:
            self.near.setdefault(end, set()).add(key)

    def drop_edge(self, key: tuple[str, str, str]) -> None:
        del self.edges[key]
        for end in key[:2]:
            self.near[end].discard(key)


def edge_key(a: str, b: str, relation: str) -> tuple[str, str, str]:
    return min(a, b), max(a, b), relation


def carry_out(g: Held, e: dict) -> str | None:
    """Carry out an edit (operation, target, first, second, attribute, token, value, label, relation) on a graph held as Held holds it; what keeps it from being applied, or null."""
    if e["operation"] == "NOOP":
        return "noop"
    return _on_node(g, e) if e["target"] == "NODE" else _on_edge(g, e)


def _on_node(g: Held, e: dict) -> str | None:
    op, node = e["operation"], e["first"]
    if op == "ADD":
        if g.has_node(node):
            return "node_exists"
        g.add_node(node, e["label"] or node)
        return None
    if not g.has_node(node):
        return "unknown_node"
    if op == "DEL":
        g.drop_node(node)
        return None
    # A missing attribute equals a null one.
    if g.token(node, e["attribute"]) == e["token"]:
        return "no_state_change"
    g.set_attribute(node, e["attribute"], e["token"], e["value"])
    return None


def _on_edge(g: Held, e: dict) -> str | None:
    op, a, b = e["operation"], e["first"], e["second"]
    if a == b:
        return "self_loop"
    if not g.has_node(a) or not g.has_node(b):
        return "unknown_end"
    key = edge_key(a, b, e["relation"])
    if (op == "ADD") == g.has_edge(key):
        return "edge_exists" if op == "ADD" else "unknown_edge"
    if op == "ADD":
        g.add_edge(key, a, b, 1.0)
    else:
        g.drop_edge(key)
    return None


def apply_programs(nodes: DataFrame, edges: DataFrame, attrs: DataFrame, edits: DataFrame, strict: bool = False) -> DataFrame:
    """The graphs after their programs, and what each edit did, as rows of four kinds in column what.

    edits: (graph_id, pos, operation, target, first, second, attribute, token, value, label,
    relation), a graph's in order of pos. Rows of kind node, attribute and edge are the graph as it
    ends; rows of kind effect have pos, applied and error. An edit that is not possible is not
    applied and says why; in strict mode it fails the job, but one that changes nothing does not.
    NOOP is never applied and has no error. Deleting a node deletes its edges.
    """
    prepare(nodes.sparkSession)
    null = F.lit(None)

    def row(df: DataFrame, what: str, **cols) -> DataFrame:
        kinds = dict(x.split() for x in _ROW.split(", "))
        return df.select("graph_id", *[(F.lit(what) if c == "what" else cols.get(c, null)).cast(kinds[c]).alias(c) for c in _NAMES])

    c = F.col
    rows = row(nodes, "node", node_id=c("node_id"), label=c("label"))
    rows = rows.unionByName(row(attrs, "attribute", node_id=c("node_id"), name=c("name"), token=c("token"), text=c("text")))
    rows = rows.unionByName(row(edges, "edge", src=c("src"), dst=c("dst"), relation=c("relation"), weight=c("weight")))
    rows = rows.unionByName(row(edits, "edit", pos=c("pos"), label=c("operation"), name=c("target"), src=c("first"), dst=c("second"), token=c("token"), text=F.coalesce("value", "label"), relation=F.coalesce("attribute", "relation")))

    def each(t: pa.Table) -> pa.Table:
        given = t.to_pylist()
        g, out = Held(given), []
        for r in sorted((r for r in given if r["what"] == "edit"), key=lambda r: r["pos"]):
            # value and label share a column, attribute and relation another.
            error = carry_out(g, {"operation": r["label"], "target": r["name"], "first": r["src"], "second": r["dst"], "attribute": r["relation"], "token": r["token"], "value": r["text"], "label": r["text"], "relation": r["relation"]})
            if strict and error not in (None, "noop", "no_state_change"):
                raise ValueError(f"{r['graph_id']}, edit {r['pos']}: {error}")
            out.append({"what": "effect", "pos": r["pos"], "applied": error is None, "error": None if error == "noop" else error})
        out += [{"what": "node", "node_id": n, "label": x} for n, x in g.nodes.items()]
        out += [{"what": "attribute", "node_id": n, "name": a, "token": k, "text": x} for n, held in g.attrs.items() for a, (k, x) in held.items()]
        out += [{"what": "edge", "src": a, "dst": b, "relation": k[2], "weight": x} for k, (a, b, x) in g.edges.items()]
        return pa.Table.from_pylist([{"graph_id": given[0]["graph_id"], **r} for r in out], schema=t.schema)

    return rows.groupBy("graph_id").applyInArrow(each, f"graph_id string, {_ROW}")
