"""Vectors as a whole: moments, principal components, collapse statistics, a linear probe.

What is summed over all vectors is summed in the tasks that read them, then in SHARES tasks, and only
sums reach the driver: a matrix of the vectors' length for moments, one of classes by length for the
probe. Vectors that are null or hold null or non-finite components are left out, and so are those
whose length is not the commonest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import prepare, settle

#: Tasks that add up what the reading tasks have summed.
SHARES = 32


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a finite vector of the commonest length, the longer among equals, as doubles."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull() & ~bad).withColumn(column, x.cast("array<double>"))
    sizes = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.where(F.size(column) == F.lit(top if top is not None else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of partial(batch) over all batches of df; null without rows. All partial results have one length."""
    prepare(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                x = partial(b)
                total = x if total is None else total + x
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SHARES], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["share", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("sums"))
        return pa.table([t.column("share")[:1], pa.array([total.tobytes()], pa.binary())], names=["share", "sums"])

    parts = df.mapInArrow(each, "share int, sums binary")
    # As few tasks as that send their sums to the driver themselves.
    few = df.rdd.getNumPartitions() <= SHARES
    shares = (parts if few else parts.groupBy("share").applyInArrow(add, "share int, sums binary")).collect()
    return sum(np.frombuffer(r.sums, np.float64) for r in sorted(shares, key=lambda r: r.share)) if shares else None


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(number, mean, covariance with n - 1) of usable vectors: a pass for the mean, one for what is left about it."""
    x = usable(vectors, column).select(column)
    first = summed(x, lambda b: np.append(_matrix(b.column(0)).sum(0), float(b.num_rows)))
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, mean = int(first[-1]), first[:-1] / first[-1]

    def about(b: pa.RecordBatch) -> np.ndarray:
        c = _matrix(b.column(0)) - mean
        return (c.T @ c).ravel()

    return n, mean, summed(x, about).reshape(len(mean), len(mean)) / max(1, n - 1)


def covariance(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(i, j, value) of the covariance matrix."""
    n, _, c = moments(vectors, column)
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))]
    return vectors.sparkSession.createDataFrame(rows, "i long, j long, value double")


def principal_components(vectors: DataFrame, k: int, column: str = "embedding") -> DataFrame:
    """(component, eigenvalue, explained, vector) of the k largest, from one matrix of the vectors' length.

    explained is the component's share of the variance. A vector's largest part by size is positive.
    """
    _, _, c = moments(vectors, column)
    values, basis = np.linalg.eigh(c) if len(c) else (np.zeros(0), np.zeros((0, 0)))
    total = float(np.clip(values, 0, None).sum())
    rows = []
    for rank, i in enumerate(np.argsort(-values, kind="stable")[:k]):
        v = basis[:, i] * (1 if basis[np.abs(basis[:, i]).argmax(), i] >= 0 else -1)
        rows.append((rank, float(values[i]), float(values[i]) / total if total else 0.0, v.tolist()))
    return vectors.sparkSession.createDataFrame(rows, "component long, eigenvalue double, explained double, vector array<double>")


def collapse(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(mean_within_cosine, effective_rank, dim): mean over groups of the mean cosine of two members, and the rank that the spectrum amounts to.

    The sum of all cosines of a group is the squared length of the sum of its unit vectors, so no
    pair is made; a group of one counts as 0. The rank is the squared trace of the covariance over
    the sum of its squares. Null groups are one.
    """
    x = usable(vectors, column).select(F.col(by).alias("g"), F.col(column).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = x.select("g", F.posexplode(F.transform("x", lambda v: v / F.greatest(length, F.lit(1e-12)))).alias("i", "v"))
    parts = unit.groupBy("g", "i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    cosine = parts.groupBy("g").agg(((F.sum(F.col("s") * F.col("s")) - n) / F.greatest(F.lit(1), n * (n - 1))).alias("c"))
    _, _, c = moments(vectors, column)
    rank = float(np.trace(c) ** 2 / max(float((c * c).sum()), 1e-12)) if len(c) else 0.0
    return cosine.agg(F.avg("c").alias("mean_within_cosine")).select("mean_within_cosine", F.lit(rank).alias("effective_rank"), F.lit(len(c)).cast("long").alias("dim"))


class Probe:
    """A linear classifier over standardised vectors: classes by (length + 1) weights, the last for the constant."""

    def __init__(self, classes: list[str], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.classes, self.mean, self.scale, self.weights = classes, mean, scale, weights

    def predict(self, vectors: DataFrame, label: str, column: str = "embedding", name: str = "predicted") -> DataFrame:
        """usable vectors with the class of the highest score, the first among equals."""
        rows = usable(vectors, column)
        prepare(rows.sparkSession)
        at, schema = rows.columns.index(column), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        classes, mean, scale, w = self.classes, self.mean, self.scale, self.weights

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = (_matrix(b.column(at)) - mean) / scale if b.num_rows else np.zeros((0, len(mean)))
                best = (z @ w[:, :-1].T + w[:, -1]).argmax(1)
                yield pa.record_batch([*b.columns, pa.array([classes[i] for i in best], pa.string())], names=[*b.schema.names, name])

        return rows.mapInArrow(each, f"{schema}, `{name}` string")


def fit_probe(vectors: DataFrame, label: str, column: str = "embedding", ridge: float = 1e-4, rounds: int = 500, tolerance: float = 1e-7) -> Probe:
    """Multinomial logistic regression by L-BFGS; each step's loss and gradient is one pass over the vectors.

    Vectors are standardised by their mean and their deviation (at least 1e-6). The loss is the mean
    cross-entropy plus ridge times the squared weights without the constants. Rows without a label are
    left out; classes are the labels as text, in order.
    """
    rows = settle(usable(vectors.where(F.col(label).isNotNull()), column).select(F.col(label).cast("string").alias("y"), F.col(column).alias("x")), "probe-rows")
    n, mean, c = moments(rows, "x")
    classes = sorted(r.y for r in rows.select("y").distinct().collect())  # the classes, a row each
    scale, k = np.maximum(np.sqrt(np.diag(c)), 1e-6), len(classes)
    place = {y: i for i, y in enumerate(classes)}

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(k, -1)

        def partial(b: pa.RecordBatch) -> np.ndarray:
            z = (_matrix(b.column(1)) - mean) / scale
            z = np.concatenate([z, np.ones((len(z), 1))], 1)
            y = np.array([place[v] for v in b.column(0).to_pylist()])
            s = z @ w.T
            s -= s.max(1, keepdims=True)
            e = np.exp(s)
            total = e.sum(1)
            p = e / total[:, None]
            p[np.arange(len(y)), y] -= 1
            return np.append((p.T @ z).ravel(), (np.log(total) - s[np.arange(len(y)), y]).sum())

        got = summed(rows, partial)
        g = got[:-1].reshape(k, -1) / n
        g[:, :-1] += 2 * ridge * w[:, :-1]
        return float(got[-1] / n + ridge * (w[:, :-1] ** 2).sum()), g.ravel()

    start = np.zeros(k * (len(mean) + 1))
    return Probe(classes, mean, scale, (minimise(loss, start, rounds, tolerance) if n and k > 1 else start).reshape(k, -1))


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """The least point of a smooth convex function by L-BFGS with a line search for the strong Wolfe conditions."""
    value, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        d, left = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (y @ s)
            left.append(a)
            d -= a * y
        if steps:
            d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), a in zip(steps, reversed(left), strict=True):
            d += (a - (y @ d) / (y @ s)) * s
        d, slope = -d, -(g @ d)
        t = 1.0 if i else min(1.0, 1.0 / np.abs(g).sum())
        low, high = 0.0, np.inf
        for _ in range(25):
            new, new_g = loss(x + t * d)
            if new > value - 1e-4 * t * slope:
                high = t
            elif abs(new_g @ d) <= 0.9 * slope:
                break
            elif new_g @ d < 0:
                low = t
            else:
                high = t
            t = 2 * t if np.isinf(high) else (low + high) / 2
        if new > value:
            break
        moved, turned, before = t * d, new_g - g, value
        x, value, g = x + moved, new, new_g
        if turned @ moved > 1e-12 * (turned @ turned) ** 0.5 * (moved @ moved) ** 0.5:
            steps = [*steps, (moved, turned)][-memory:]
        if before - value <= 1e-15 * max(1.0, abs(before)) and np.abs(moved).max() <= 1e-9:
            break
    return x
