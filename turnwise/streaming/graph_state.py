"""Graphs kept up to date from a stream of edits, node edits with their cascades included.

Each graph is keyed state: maps of its nodes, attributes and edges, which Spark keeps in a store on
each executor, checkpoints in the shared folder and hands to another executor where one is lost. An
edit touches the entries it names; deleting a node touches the edges at it, which its entry lists. So
the cost of an edit does not grow with the graph. Edits are carried out by the same rules as in
operators.apply, and give what they did and what changed, so that a sink can hold the graphs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.apply import carry_out
from ..shared import prepare

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EDIT = "graph_id string, pos long, operation string, target string, first string, second string, attribute string, token string, value string, label string, relation string"
_OUT = "graph_id string, what string, pos long, seq int, applied boolean, error string, node_id string, label string, name string, token string, text string, src string, dst string, relation string, weight double, gone boolean"
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


class _Stored:
    """One graph in keyed state, with the methods of operators.apply.Held; changes are listed as they happen."""

    def __init__(self, nodes, attrs, edges):
        self.nodes, self.attrs, self.edges = nodes, attrs, edges
        self.changes: list[dict] = []

    def _node(self, node: str) -> tuple[str, list[str], list[list[str]]]:
        row = self.nodes.getValue((node,))
        return row[0], json.loads(row[1]), json.loads(row[2])

    def _put(self, node: str, label: str, names: list[str], near: list[list[str]]) -> None:
        self.nodes.updateValue((node,), (label, json.dumps(names), json.dumps(near)))

    def has_node(self, node: str) -> bool:
        return self.nodes.containsKey((node,))

    def add_node(self, node: str, label: str) -> None:
        self._put(node, label, [], [])
        self.changes.append({"what": "node", "node_id": node, "label": label, "gone": False})

    def drop_node(self, node: str) -> None:
        _, names, near = self._node(node)
        for key in near:
            self.drop_edge(tuple(key))
        for name in names:
            self.attrs.removeKey((node, name))
            self.changes.append({"what": "attribute", "node_id": node, "name": name, "gone": True})
        self.nodes.removeKey((node,))
        self.changes.append({"what": "node", "node_id": node, "gone": True})

    def token(self, node: str, name: str) -> str | None:
        return self.attrs.getValue((node, name))[0] if self.attrs.containsKey((node, name)) else None

    def set_attribute(self, node: str, name: str, token: str | None, text: str | None) -> None:
        if not self.attrs.containsKey((node, name)):
            label, names, near = self._node(node)
            self._put(node, label, [*names, name], near)
        self.attrs.updateValue((node, name), (token, text))
        self.changes.append({"what": "attribute", "node_id": node, "name": name, "token": token, "text": text, "gone": False})

    def has_edge(self, key: tuple[str, str, str]) -> bool:
        return self.edges.containsKey(key)

    def add_edge(self, key: tuple[str, str, str], src: str, dst: str, weight: float) -> None:
        self.edges.updateValue(key, (src, dst, weight))
        for end in key[:2]:
            label, names, near = self._node(end)
            self._put(end, label, names, [*near, list(key)])
        self.changes.append({"what": "edge", "src": src, "dst": dst, "relation": key[2], "weight": weight, "gone": False})

    def drop_edge(self, key: tuple[str, str, str]) -> None:
        src, dst, weight = self.edges.getValue(key)
        self.edges.removeKey(key)
        for end in key[:2]:
            label, names, near = self._node(end)
            self._put(end, label, names, [k for k in near if tuple(k) != key])
        self.changes.append({"what": "edge", "src": src, "dst": dst, "relation": key[2], "weight": weight, "gone": True})


class GraphProcessor(StatefulProcessor):
    """State of each graph and what an edit does to it."""

    def __init__(self, live_ms: int | None):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", "node_id string", "label string, names string, near string", self.live_ms)
        self.attrs = handle.getMapState("attributes", "node_id string, name string", "token string, text string", self.live_ms)
        self.edges = handle.getMapState("edges", "a string, b string, relation string", "src string, dst string, weight double", self.live_ms)
        self.last = handle.getValueState("last", "pos long", self.live_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        g, r = _Stored(self.nodes, self.attrs, self.edges), initialState
        if r["what"] == "node":
            if not g.has_node(r["node_id"]):
                g.add_node(r["node_id"], r["label"])
            return
        for end in filter(None, (r["node_id"], r["src"], r["dst"])):
            if not g.has_node(end):  # its own row comes later
                g.add_node(end, end)
        if r["what"] == "attribute":
            g.set_attribute(r["node_id"], r["name"], r["token"], r["text"])
        else:
            g.add_edge((min(r["src"], r["dst"]), max(r["src"], r["dst"]), r["relation"]), r["src"], r["dst"], r["weight"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["pos"] is None, r["pos"])):
            made, g = [], _Stored(self.nodes, self.attrs, self.edges)
            if r["pos"] is None or (at is not None and r["pos"] <= at):
                made.append({"what": "late", "error": "no_position" if r["pos"] is None else "late"})
            else:
                at = r["pos"]
                error = carry_out(g, r.asDict())
                made.append({"what": "effect", "applied": error is None, "error": None if error == "noop" else error})
            for i, m in enumerate([*made, *g.changes]):
                yield Row(**{c: {**m, "graph_id": key[0], "pos": r["pos"], "seq": i}.get(c) for c in _COLUMNS})
        if at is not None:
            self.last.update((at,))

    def close(self) -> None:
        pass


def initial_rows(nodes: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """Graphs as rows to start from: (graph_id, what, node_id, label, name, token, text, src, dst, relation, weight)."""
    kinds = {"node_id": "string", "label": "string", "name": "string", "token": "string", "text": "string", "src": "string", "dst": "string", "relation": "string", "weight": "double"}

    def row(df: DataFrame, what: str) -> DataFrame:
        return df.select("graph_id", F.lit(what).alias("what"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    return row(nodes.select("graph_id", "node_id", "label"), "node").unionByName(row(attrs, "attribute")).unionByName(row(edges, "edge"))


def configure(spark: SparkSession) -> None:
    """Keep state in the store that maps and times to live need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    prepare(spark)


def graph_changes(edits: DataFrame, start: DataFrame | None = None, live_ms: int | None = None) -> DataFrame:
    """What a stream of edits (EDIT) does to graphs that begin as start (initial_rows) says, in append mode.

    Rows of what = effect say whether the edit at pos was applied and why not; node, attribute and
    edge rows are the entries it set, or removed where gone; seq orders the rows of one edit. A graph
    takes edits in order of pos: those of one batch are sorted, and one that comes after a later one,
    or again, or without a position, changes nothing and is given as what = late. live_ms is the time
    to live of an entry that nothing touches.
    """
    grouped = edits.select(*[x.split()[0] for x in EDIT.split(", ")]).groupBy("graph_id")
    first = None if start is None else start.groupBy("graph_id")
    return grouped.transformWithState(GraphProcessor(live_ms), _OUT, "append", "ProcessingTime" if live_ms else "None", first)


def latest(changes: DataFrame) -> DataFrame:
    """The graphs that changes lead to: of each entry the last row, without what is gone; changes is a table of all batches."""
    key = ["graph_id", "what", "node_id", "name", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation"]
    held = changes.where("what in ('node', 'attribute', 'edge')")
    whole = F.struct("pos", "seq", "gone", "label", "token", "text", "src", "dst", "weight")
    last = held.groupBy(*key).agg(F.max_by(whole, F.struct("pos", "seq")).alias("r"))
    return last.where("not r.gone").select("graph_id", "what", "node_id", "r.label", "name", "r.token", "r.text", "r.src", "r.dst", "relation", "r.weight")
