"""Reachability where edges have directions: strongly connected components and the order between them.

Two nodes of a strong component reach each other, so what reaches what is settled between components,
whose graph has no cycles. A graph of up to HELD edges is searched by the task that holds it. Larger
ones are divided in rounds: every node learns the least node that
reaches it and the least that it reaches, by a fixed random order; where both are one node, it is in
that node's component. No component lies across nodes that differ in either, so edges between such
nodes go and the rest is divided again, about as often as the logarithm of a graph's size. Each step
is a join over all graphs at once, so a graph may be of any size.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, prepare, settle

#: Edges of a graph that one task searches by itself.
HELD = 200_000


def strong_components(nodes: DataFrame, adj: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """(keys, node_id, component): the smallest node that a node reaches and is reached by, itself included.

    nodes has keys and node_id, adj keys, src and dst along their direction; edges at nodes that are
    not listed are ignored.
    """
    node = nodes.select(*keys, "node_id").distinct()
    near = adj.select(*keys, "src", "dst").where("src <> dst").distinct()
    near = near.join(node.withColumnRenamed("node_id", "src"), [*keys, "src"], "left_semi").join(node.withColumnRenamed("node_id", "dst"), [*keys, "dst"], "left_semi")
    near = settle(near, "strong-edges")
    large = settle(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held).select(*keys), "strong-large")
    found = [searched(near.join(large, keys, "left_anti"), keys)]
    if not large.isEmpty():
        found.append(_divided(node.join(large, keys, "left_semi"), near.join(large, keys, "left_semi"), keys))
    whole = functools.reduce(DataFrame.unionByName, found)
    return node.join(whole, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("component", "node_id").alias("component"))


def searched(near: DataFrame, keys: list[str]) -> DataFrame:
    """Components of graphs that a task holds whole, one depth-first search each; nodes without edges are left out."""
    prepare(near.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in near.schema}

    def each(t: pa.Table) -> pa.Table:
        found = low_links(t.column("src").to_pylist(), t.column("dst").to_pylist())
        own = [pa.array([t.column(k)[0].as_py()] * len(found), t.schema.field(k).type) for k in keys]
        return pa.table([*own, pa.array(list(found), t.schema.field("src").type), pa.array(list(found.values()), t.schema.field("src").type)], names=[*keys, "node_id", "component"])

    return near.groupBy(*keys).applyInArrow(each, ", ".join([*[f"{k} {kind[k]}" for k in keys], f"node_id {kind['src']}", f"component {kind['src']}"]))


def low_links(src: list[str], dst: list[str]) -> dict[str, str]:
    """The smallest node of each node's strong component, by one iterative search with low links."""
    near: dict[str, list[str]] = {}
    for a, b in zip(src, dst, strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    out: dict[str, str] = {}
    waiting: list[str] = []
    for start in near:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        waiting.append(start)
        walk = [(start, iter(near[start]))]
        while walk:
            x, rest = walk[-1]
            for y in rest:
                if y not in seen:
                    seen[y] = low[y] = len(seen)
                    waiting.append(y)
                    walk.append((y, iter(near[y])))
                    break
                if y not in out:
                    low[x] = min(low[x], seen[y])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[x])
                if low[x] == seen[x]:  # x and all that waits above it reach each other
                    group = []
                    while not group or group[-1] != x:
                        group.append(waiting.pop())
                    out.update(dict.fromkeys(group, min(group)))
    return out


def _divided(node: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """Components of graphs of any size, by rounds of joins."""
    near, rank = settle(near, "strong-part"), F.struct(F.xxhash64("node_id").alias("h"), F.col("node_id").alias("id"))
    live, found, i = settle(node.select(*keys, "node_id", rank.alias("f"), rank.alias("b")), "strong-0"), [], 0
    while not live.isEmpty():
        while True:
            i += 1
            forth = near.join(live.select(*keys, F.col("node_id").alias("src"), F.col("f").alias("_f")), [*keys, "src"]).select(*keys, F.col("dst").alias("node_id"), "_f", F.lit(None).cast(live.schema["b"].dataType).alias("_b"))
            back = near.join(live.select(*keys, F.col("node_id").alias("dst"), F.col("b").alias("_b")), [*keys, "dst"]).select(*keys, F.col("src").alias("node_id"), F.lit(None).cast(live.schema["f"].dataType).alias("_f"), "_b")
            told = forth.unionByName(back).groupBy(*keys, "node_id").agg(F.min("_f").alias("_f"), F.min("_b").alias("_b"))
            both = live.join(told, [*keys, "node_id"], "left").select(*keys, "node_id", F.least("f", "_f").alias("_f"), F.least("b", "_b").alias("_b"), "f", "b")
            new = settle(both.select(*keys, "node_id", F.col("_f").alias("f"), F.col("_b").alias("b"), ((F.col("_f") != F.col("f")) | (F.col("_b") != F.col("b"))).alias("moved")), f"strong-{i}")
            discard(live)
            live = new
            if live.where("moved").isEmpty():
                break
        found.append(settle(live.where("f = b").select(*keys, "node_id", "f.id"), f"strong-found-{i}"))
        rest = live.where("f <> b")
        side = lambda end: rest.select(*keys, F.col("node_id").alias(end), F.col("f").alias(f"_f{end}"), F.col("b").alias(f"_b{end}"))  # noqa: E731, B023
        kept = near.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"]).where("_fsrc = _fdst and _bsrc = _bdst").select(*keys, "src", "dst")
        kept = settle(kept, f"strong-edges-{i}")
        fresh = settle(rest.select(*keys, "node_id", rank.alias("f"), rank.alias("b")), f"strong-again-{i}")
        discard(near, live)
        near, live = kept, fresh
    whole = functools.reduce(DataFrame.unionByName, found)
    named = whole.groupBy(*keys, "id").agg(F.min("node_id").alias("component"))
    return whole.join(named, [*keys, "id"]).select(*keys, "node_id", "component")


def between(components: DataFrame, adj: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): pairs of different components that an edge leads between."""
    at = lambda end, name: components.select(*keys, F.col("node_id").alias(end), F.col("component").alias(name))
    return adj.select(*keys, "src", "dst").join(at("src", "a"), [*keys, "src"]).join(at("dst", "b"), [*keys, "dst"]).where("a <> b").select(*keys, "a", "b").distinct()


def closure(starts: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): every b that each asked a leads to over links (keys, a, b), a itself included.

    Only what is new goes on, so rounds end with the longest of the shortest ways, and work is what
    the asked ones reach.
    """
    links = settle(links.select(*keys, F.col("a").alias("_at"), F.col("b").alias("_to")).distinct(), "closure-links")
    front = settle(starts.select(*keys, "a").distinct().withColumn("b", F.col("a")), "closure-0")
    state, i = front, 0
    while not front.isEmpty():
        i += 1
        step = front.withColumnRenamed("b", "_at").join(links, [*keys, "_at"]).select(*keys, "a", F.col("_to").alias("b")).distinct()
        front = settle(step.join(state, [*keys, "a", "b"], "left_anti"), f"closure-{i}")
        state = state.unionByName(front)
    return state
