"""Sessions replayed turn by turn in the tasks that hold them, with every question answered on the graphs in hand.

A session's rows come in order, after one row with its first graph and the next session's. A task
keeps two graphs, as the turns and as the guessed edits leave it, and changes them edit by edit, so
no graph after a turn is ever written or shuffled. Answers are those of solve.answer_queries.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import prepare
from ..sources.trade import Graphs
from .paths import nearest
from .solve import NAMED, PAIRS

#: Initial graphs, and answers about each, that a task remembers.
GRAPHS, ANSWERS = 256, 10_000


def packed(g: Graphs) -> DataFrame:
    """(graph_id, graph): each graph with its attributes but the status as compressed JSON."""
    listed = lambda df, *cols: df.groupBy("graph_id").agg(F.collect_list(F.struct(*cols)).alias(cols[-1]))
    nodes, edges = listed(g.nodes, "node_id", "label", "is_open"), listed(g.edges, "src", "dst", "weight")
    attrs = listed(g.attrs.where("name <> 'status'"), "node_id", "name", "token", "text")
    whole = nodes.join(edges, "graph_id", "left").join(attrs, "graph_id", "left")
    text = whole.select("graph_id", F.to_json(F.struct(F.col("is_open").alias("nodes"), F.col("weight").alias("edges"), F.col("text").alias("attrs"))).alias("graph"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            graphs = pa.array([zlib.compress(x.encode()) for x in b.column("graph").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("graph_id"), graphs], ["graph_id", "graph"])

    return text.mapInArrow(each, "graph_id string, graph binary")


class Graph:
    """A session's first graph: label and token and text of attributes by node, neighbours with the number of edges and the least weight, closed nodes."""

    def __init__(self, blob: bytes):
        g = json.loads(zlib.decompress(blob))
        self.label = {n["node_id"]: n.get("label") for n in g["nodes"]}
        self.size = len(g["nodes"])
        self.shut = {n["node_id"] for n in g["nodes"] if not n.get("is_open")}
        self.near: dict[str, dict[str, tuple[int, float]]] = {}
        for e in g.get("edges", ()):
            for a, b in ((e["src"], e["dst"]), (e["dst"], e["src"])):
                n, w = self.near.setdefault(a, {}).get(b, (0, e["weight"]))
                self.near[a][b] = (n + 1, min(w, e["weight"]))
        self.held: dict[str, dict[str, tuple[str | None, str | None]]] = {}
        for a in g.get("attrs", ()):
            self.held.setdefault(a["name"], {})[a["node_id"]] = (a.get("token"), a.get("text"))
        self.first = State(self)
        self.said: dict[tuple, str] = {}

    def answer(self, question: tuple) -> str:
        """The answer on this graph as it is, remembered."""
        if question not in self.said:
            if len(self.said) >= ANSWERS:
                self.said.clear()
            self.said[question] = self.first.answer(question)
        return self.said[question]


@functools.lru_cache(GRAPHS)
def unpacked(blob: bytes) -> Graph:
    """The graph in a blob of packed(), kept while a task uses it."""
    return Graph(blob)


class State:
    """A graph as edits have left it; off says what differs from the first one: False what went or closed, True what came or opened, None an edge put back, which weighs 1."""

    def __init__(self, base: Graph):
        self.base, self.shut, self.off = base, set(base.shut), {}
        self.near = {a: dict(near) for a, near in base.near.items()}

    def edit(self, op: str, a: str | None, lo: str | None, hi: str | None) -> bool:
        """Carry out an edit; whether it changed anything."""
        if op.startswith("SET"):
            goal = op == "SET_OPEN"
            if a not in self.base.label or (a not in self.shut) == goal:
                return False
            (self.shut.discard if goal else self.shut.add)(a)
            if goal == (a not in self.base.shut):
                del self.off[a]
            else:
                self.off[a] = goal
            return True
        if op not in ("ADD", "DEL") or lo is None or hi is None or (hi in self.near.get(lo, ())) == (op == "ADD"):
            return False
        begun = self.base.near.get(lo, {}).get(hi)
        if op == "ADD":
            link = (begun[0] if begun else 1 + (lo == hi), 1.0)
            self.near.setdefault(lo, {})[hi] = self.near.setdefault(hi, {})[lo] = link
            self.off[lo, hi] = None if begun else True
        else:
            del self.near[lo][hi]
            self.near[hi].pop(lo, None)
            if begun:
                self.off[lo, hi] = False
            else:
                del self.off[lo, hi]
        return True

    def shape(self) -> dict:
        """The closed nodes and joined pairs, as what differs from the first graph."""
        return {k: v for k, v in self.off.items() if v is not None}

    def _open(self, node: str | None) -> bool:
        return node in self.base.label and node not in self.shut

    def get(self, node: str, none: tuple = ()) -> list[tuple[str, float]] | tuple:
        """Available neighbours with their weights, for nearest()."""
        return [(b, w) for b, (_, w) in self.near[node].items() if self._open(b)] if node in self.near else none

    def _value(self, node: str, name: str | None) -> tuple[str | None, str | None]:
        """Token and text of an attribute, null where it is missing."""
        if name == "status":
            return (None, None) if node not in self.base.label else ("s:closed", "closed") if node in self.shut else ("s:open", "open")
        return self.base.held.get(name, {}).get(node, (None, None))

    def _within(self, source: str, hops: int) -> list[str]:
        """The nodes at 1 to hops steps."""
        seen, front, depth = {source}, [source], 0
        out: list[str] = []
        while front and depth < hops:
            depth += 1
            fresh = []
            for x in front:
                for y in self.near.get(x, ()):
                    if y not in seen:
                        seen.add(y)
                        fresh.append(y)
            out += fresh
            front = fresh
        return out

    def _met(self, starts: list[str], goals: set[str], usable) -> bool:
        """Whether a way over usable nodes leads from a start to a goal; starts are usable."""
        seen, rest = set(starts), list(starts)
        while rest:
            x = rest.pop()
            if x in goals:
                return True
            for y in self.near.get(x, ()):
                if y not in seen and usable(y):
                    seen.add(y)
                    rest.append(y)
        return False

    def _on_cycle(self, source: str) -> bool:
        """Whether two different neighbours stay connected without the node."""
        about = [x for x in self.near.get(source, ()) if x != source]
        return any(self._met([x], set(about[i + 1 :]), lambda y: y != source) for i, x in enumerate(about[:-1]))

    def answer(self, question: tuple) -> str:
        """The answer to a question (kind, source, target, attribute, token, hops)."""
        kind, source, target, attribute, token, hops = question
        if source not in self.base.label or (kind in NAMED and attribute is None) or (kind in PAIRS and target is None):
            return "invalid"
        near = self.near.get(source, {})
        if kind == "node_count":
            return str(self.base.size)
        if kind == "node_degree":
            return str(sum(n for n, _ in near.values()))
        if kind in ("edge_exists", "link_prediction"):
            return "yes" if target in near else "no"
        if kind == "attribute_lookup":
            text = self._value(source, attribute)[1]
            return "none" if text is None else text
        if kind == "attribute_check":
            return "yes" if self._value(source, attribute)[0] == token else "no"
        if kind == "filtered_neighbor_count":
            return str(sum(n for x, (n, _) in near.items() if self._value(x, attribute)[0] == token))
        if kind == "cycle_membership":
            return "yes" if self._on_cycle(source) else "no"
        if kind == "reachability":
            return "yes" if self._open(source) and self._open(target) and self._met([source], {target}, self._open) else "no"
        if kind == "constrained_reachability":
            free = lambda x: x in self.base.label and self._value(x, attribute)[0] != token
            met = source == target or target in near or self._met([x for x in near if free(x)], set(self.near.get(target, ())), free)
            return "yes" if met else "no"
        if kind in ("shortest_path", "path_cost", "filtered_path_count"):
            found = nearest(self, source, {target}).get(target) if self._open(source) and self._open(target) else None
            if found is None:
                return "unreachable"
            if kind == "path_cost":
                return cost_text(found[0])
            return str(len(found[1]) if kind == "shortest_path" else sum(self._value(x, attribute)[0] == token for x in found[1]))
        reached = self._within(source, hops or 2)
        if kind == "most_common_attribute_within_hops":
            n = Counter(text for x in [source, *reached] if (text := self._value(x, attribute)[1]) is not None)
            return min(n, key=lambda text: (-n[text], text)) if n else "none"
        if attribute is not None:
            reached = [x for x in reached if self._value(x, attribute)[0] == token]
        if kind == "within_hops_count":
            return str(len(reached))
        if kind == "within_hops_list":
            named = [self.base.label[x] for x in reached if x in self.base.label]
            return ", ".join(sorted(x for x in named if x is not None)) if named else "none"
        raise ValueError(f"unknown kind {kind}")


def cost_text(cost: float) -> str:
    """A cost as paths.path_cost writes it: whole numbers without decimals, others rounded half to even at two, as Spark prints doubles."""
    if cost == cost // 1:
        return str(min(int(cost), 2**63 - 1))
    x = float(Decimal(repr(cost)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))
    if x < 1e7:
        return repr(x)
    _, digits, _ = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    return f"{text[0]}.{text[1:] or '0'}E{Decimal(repr(x)).adjusted()}"


ROLES = ("gold", "stale", "initial", "shuffled", "predicted")
_ASK = ("kind", "source", "target", "attribute", "token")
_EDITS = ("op", "a", "lo", "hi", "said_op", "said_a", "said_lo", "said_hi")


def replayed(questions: DataFrame, heads: DataFrame, kept: list[str]) -> DataFrame:
    """(kept, gold, stale, initial, shuffled, predicted, state_exact): the question of each turn on five graphs, and whether the guessed edits have the same nodes closed and pairs joined.

    questions has session_id, turn_index, an edit (op, a, lo, hi), the guessed one (the same names
    after said_) and a question; heads (session_id, own, other) the packed graphs that the session
    and the next one start from, a row a session; kept names columns of questions that go with the answers.
    """
    spark = questions.sparkSession
    prepare(spark)
    cols = list(dict.fromkeys(["session_id", "turn_index", *kept, *_EDITS, *_ASK, "hops"]))
    q = questions.select(*cols, F.lit(None).cast("binary").alias("own"), F.lit(None).cast("binary").alias("other"))
    h = heads.select("session_id", *[F.lit(None).cast(q.schema[c].dataType).alias(c) for c in cols[1:]], "own", "other")
    rows = q.unionByName(h).repartition("session_id").sortWithinPartitions("session_id", F.col("turn_index").asc_nulls_first())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next_ = own = guess = None
        last = ""
        for b in batches:
            text = [b.column(c).to_numpy(zero_copy_only=False).tolist() for c in (*_EDITS, *_ASK)]
            hops = pc.fill_null(b.column("hops"), 0).to_pylist()
            mine, theirs, head = b.column("own"), b.column("other"), pc.is_valid(b.column("own"))
            out: list[list] = [[] for _ in (*ROLES, "exact")]
            for i, (starts, far, op, a, lo, hi, p_op, p_a, p_lo, p_hi, *ask) in enumerate(zip(head.to_pylist(), hops, *text, strict=True)):
                if starts:
                    first, next_ = unpacked(mine[i].as_py()), unpacked(theirs[i].as_py())
                    own, guess = State(first), State(first)
                    continue
                question = (*ask, far)
                stale = own.answer(question) if own.off else first.answer(question)
                gold = (own.answer(question) if own.off else first.answer(question)) if own.edit(op, a, lo, hi) else stale
                guess.edit(p_op, p_a, p_lo, p_hi)
                initial = first.answer(question)
                last = gold if guess.off == own.off else guess.answer(question) if guess.off else initial
                same = guess.off == own.off or guess.shape() == own.shape()
                for x, v in zip(out, (gold, stale, initial, next_.answer(question), last, same), strict=True):
                    x.append(v)
            turn = b.filter(pc.invert(head)).select(kept)
            said = [*[pa.array(x, pa.string()) for x in out[:-1]], pa.array(out[-1], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*turn.columns, *said], [*kept, *ROLES, "state_exact"])

    types = [f"{c} {q.schema[c].dataType.simpleString()}" for c in kept] + [f"{r} string" for r in ROLES] + ["state_exact boolean"]
    return rows.mapInArrow(each, ", ".join(types))
