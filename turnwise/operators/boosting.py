"""Gradient boosting over small counts: the shortcut classifier that structure close to the question allows.

Rows are counted by task, binned features and class once, so training runs over cells with weights.
For each class of each task a round grows one regression tree on the gradient of the multinomial
deviance. A level of all trees of all tasks is one pass: tasks apply the trees so far, sum gradients
by tree, node, feature and bin, and Spark adds them up; the driver sees the sums of open nodes only
and picks the splits. Scores of a cell are kept with it and brought up to date every few rounds, so a
pass applies few trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, prepare, settle

#: Rounds whose trees a pass applies before scores are settled.
KEEP = 10
#: Bins of a feature at most; fewer values than that keep a bin each.
BINS = 64


class Model:
    """Trees by task: classes, first scores, and for each round and class a tree as (feature, bin, left, right, value) rows."""

    def __init__(self, edges: dict[str, list[np.ndarray]], classes: dict[str, list[str]], prior: dict[str, np.ndarray], rate: float):
        self.edges, self.classes, self.prior, self.rate = edges, classes, prior, rate
        self.rounds: list[dict[tuple[str, int], np.ndarray]] = []

    def binned(self, task: str, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges[task])], 1) if len(x) else np.zeros(x.shape, np.int64)

    def scores(self, task: str, bins: np.ndarray, start: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        out = np.tile(self.prior[task], (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds[since:]:
            for k in range(out.shape[1]):
                if (task, k) in trees:
                    tree = trees[task, k]
                    out[:, k] += self.rate * tree[leaves(tree, bins), 4]
        return out


def leaves(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node of a tree where each row ends; a node without feature (-1) is a leaf."""
    at = np.zeros(len(bins), np.int64)
    while True:
        f = tree[at, 0].astype(np.int64)
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return at
        node = at[inner]
        left = bins[inner, f[inner]] <= tree[node, 1]
        at[inner] = np.where(left, tree[node, 2], tree[node, 3]).astype(np.int64)


def best_split(n: np.ndarray, g: np.ndarray) -> tuple[float, int] | None:
    """(gain, last bin on the left) of one feature: the greatest n_left n_right / n times the squared difference of mean gradients, the first among equals."""
    left_n, left_g = np.cumsum(n)[:-1], np.cumsum(g)[:-1]
    right_n, right_g = n.sum() - left_n, g.sum() - left_g
    ok = (left_n > 0) & (right_n > 0)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left_n * right_n / (left_n + right_n) * (left_g / left_n - right_g / right_n) ** 2, -1.0)
    i = int(gain.argmax())
    return float(gain[i]), i


def _probabilities(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: DataFrame, rounds: int = 150, depth: int = 3, rate: float = 0.1) -> Model:
    """A model of rows (task, features array<double>, answer). Tasks of one answer give that answer; null answers are left out."""
    spark = rows.sparkSession
    prepare(spark)
    held = settle(rows.where("answer is not null").groupBy("task", "features", "answer").agg(F.count(F.lit(1)).alias("n")), "boost-cells")
    found = held.groupBy("task", "answer").agg(F.sum("n").alias("n")).collect()  # a row each class
    classes = {t: sorted(r.answer for r in found if r.task == t) for t in {r.task for r in found}}
    prior = {t: np.log(np.array([next(r.n for r in found if r.task == t and r.answer == c) for c in cs], float)) for t, cs in classes.items()}
    prior = {t: p - np.log(np.exp(p).sum()) for t, p in prior.items()}
    # Bin edges: the values themselves where they are few, else quantiles of them.
    values = held.select("task", F.posexplode("features").alias("j", "x")).groupBy("task", "j").agg(F.percentile_approx("x", F.array(*[F.lit(i / BINS) for i in range(1, BINS + 1)]), 10_000).alias("q"), F.count_distinct("x").alias("k"), F.max("x").alias("top"))
    few = held.select("task", F.posexplode("features").alias("j", "x")).join(values.where(F.col("k") <= BINS).select("task", "j"), ["task", "j"]).groupBy("task", "j").agg(F.collect_set("x").alias("own"))
    table = values.join(few, ["task", "j"], "left").select("task", "j", F.coalesce("own", "q").alias("e")).collect()
    edges = {t: [np.unique(next(r.e for r in table if r.task == t and r.j == j)) for j in range(sum(r.task == t for r in table))] for t in classes}
    model = Model(edges, classes, prior, rate)
    many = {t for t, cs in classes.items() if len(cs) > 1}
    cells, since = held, 0

    for r in range(rounds if many else 0):
        trees = {(t, k): np.array([[-1, 0, 0, 0, 0.0]]) for t in many for k in range(len(classes[t]))}
        open_ = {key: {0} for key in trees}
        for level in range(depth + 1):
            if not any(open_.values()):
                break
            sums = _histograms(cells, model, since, trees, open_, level < depth)
            for key, nodes in open_.items():
                below: set[int] = set()
                for node in sorted(nodes):
                    n, g, h, parts = sums[(*key, node)]
                    k = len(classes[key[0]])
                    trees[key][node, 4] = (k - 1) / k * g / h if abs(h) > 1e-150 else 0.0
                    if level == depth or n < 2:
                        continue
                    tries = [(s[0], -j, s[1]) for j, (pn, pg) in sorted(parts.items()) if (s := best_split(pn, pg))]
                    if not tries or max(tries)[0] <= 1e-12:
                        continue
                    _, j, bin_ = max(tries, key=lambda x: x[:2])
                    at = len(trees[key])
                    trees[key] = np.concatenate([trees[key], np.array([[-1, 0, 0, 0, 0.0]] * 2)])
                    trees[key][node, :4] = (-j, bin_, at, at + 1)
                    below |= {at, at + 1}
                open_[key] = below
        model.rounds.append(trees)
        if len(model.rounds) - since == KEEP and r + 1 < rounds:
            new = settle(_with_scores(cells, model, since), "boost-scores")
            if cells is not held:
                discard(cells)
            cells, since = new, len(model.rounds)
    return model


def _groups(b: pa.RecordBatch, model: Model, since: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(task, rows, bins, scores) of a batch of cells."""
    tasks = np.array(b.column("task").to_pylist(), object)
    for t in sorted(set(tasks)):
        rows = np.flatnonzero(tasks == t)
        x = np.array(b.column("features").take(pa.array(rows)).to_pylist(), float)
        start = np.array(b.column("scores").take(pa.array(rows)).to_pylist(), float) if "scores" in b.schema.names else None
        bins = model.binned(t, x)
        yield t, rows, bins, model.scores(t, bins, start, since)


def _with_scores(cells: DataFrame, model: Model, since: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            for _, rows, _, s in _groups(b, model, since):
                for i, v in zip(rows.tolist(), s.tolist(), strict=True):
                    out[i] = v
            yield pa.record_batch([*[b.column(c) for c in ("task", "features", "answer", "n")], pa.array(out, pa.list_(pa.float64()))], names=["task", "features", "answer", "n", "scores"])

    return cells.mapInArrow(each, "task string, features array<double>, answer string, n long, scores array<double>")


def _histograms(cells: DataFrame, model: Model, since: int, trees: dict, open_: dict, split: bool) -> dict:
    """For each open node (task, class, node): its number, gradient and curvature, and if it may split by feature the (number, gradient) of each bin."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for t, rows, bins, s in _groups(b, model, since):
                if len(model.classes[t]) < 2:
                    continue
                n = b.column("n").to_numpy()[rows].astype(float)
                y = np.array([model.classes[t].index(a) for a in b.column("answer").take(pa.array(rows)).to_pylist()])
                p = _probabilities(s)
                for k in range(s.shape[1]):
                    if not open_[t, k]:
                        continue
                    g = (y == k) - p[:, k]
                    at = leaves(trees[t, k], bins)
                    for node in open_[t, k]:
                        own = at == node
                        h = np.abs(g[own]) * (1 - np.abs(g[own]))
                        v = np.array([n[own].sum(), (n[own] * g[own]).sum(), (n[own] * h).sum()])
                        key = (t, k, node, -1, 0)
                        total[key] = total.get(key, 0) + v
                        for j in range(bins.shape[1] if split else 0):
                            size = len(model.edges[t][j]) + 1
                            both = np.concatenate([np.bincount(bins[own, j], n[own], size), np.bincount(bins[own, j], n[own] * g[own], size)])
                            total[t, k, node, j, 0] = total.get((t, k, node, j, 0), 0) + both
        for (t, k, node, j, _), v in total.items():
            yield pa.record_batch([pa.array([t]), pa.array([k], pa.int32()), pa.array([node], pa.int32()), pa.array([j], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["task", "k", "node", "j", "v"])

    parts = cells.mapInArrow(each, "task string, k int, node int, j int, v array<double>")
    wide = parts.select("task", "k", "node", "j", F.posexplode("v").alias("i", "x")).groupBy("task", "k", "node", "j", "i").agg(F.sum("x").alias("x"))
    arrays: dict[tuple, dict[int, float]] = {}
    for r in wide.collect():  # bins of the open nodes
        arrays.setdefault((r.task, r.k, r.node, r.j), {})[r.i] = r.x
    out: dict = {}
    for (t, k, node, j), v in arrays.items():
        x = np.array([v[i] for i in range(len(v))])
        here = out.setdefault((t, k, node), [0.0, 0.0, 0.0, {}])
        if j < 0:
            here[:3] = x.tolist()
        else:
            here[3][j] = (x[: len(x) // 2], x[len(x) // 2 :])
    return out


def predict(rows: DataFrame, model: Model, name: str = "guess") -> DataFrame:
    """rows (task, features and others) with the likeliest answer, the first among equals; null for a task that the model does not know."""
    prepare(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            tasks = np.array(b.column("task").to_pylist(), object)
            for t in set(tasks) & set(model.classes):
                at = np.flatnonzero(tasks == t)
                x = np.array(b.column("features").take(pa.array(at)).to_pylist(), float)
                best = model.scores(t, model.binned(t, x)).argmax(1)
                for i, k in zip(at.tolist(), best.tolist(), strict=True):
                    out[i] = model.classes[t][k]
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, name])

    return rows.mapInArrow(each, f"{schema}, `{name}` string")


def structure_features(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """queries with features: of source and target each the neighbours, whether closed, leaf neighbours, least degree about it and closed neighbours (-1 for no such node), then hops, nodes and closed nodes of the graph.

    Neighbours are those of the graph without directions, each counted once.
    """
    near = edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    degree = near.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    known = nodes.select("graph_id", "node_id", (~F.col("is_open")).cast("double").alias("shut")).join(degree, ["graph_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    about = near.join(known.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count_if(F.col("degree") == 1).alias("leaf"), F.min("degree").alias("least"), F.sum("shut").alias("closed"))
    each = known.join(about, ["graph_id", "node_id"], "left")
    facts = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("degree", "shut", "leaf", "least", "closed")])
    each = each.select("graph_id", "node_id", facts.alias("f"))
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("is_open")).alias("_c"))
    q = queries.join(each.toDF("graph_id", "source", "_s"), ["graph_id", "source"], "left").join(each.toDF("graph_id", "target", "_t"), ["graph_id", "target"], "left").join(size, "graph_id", "left")
    none = F.array(*[F.lit(-1.0)] * 5)
    whole = F.concat(F.coalesce("_s", none), F.coalesce("_t", none), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("hops", "_n", "_c")]))
    return q.select(*queries.columns, whole.alias("features"))
