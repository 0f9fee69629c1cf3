"""Embedding near-dedup by E8 lattice hashing.

Each table projects a unit vector onto sixteen random directions, scales the result and decodes it
to the nearest pair of points of the lattice E8. A vector is filed under that cell and under the
PROBES neighbouring cells whose points lie nearest to it. Two vectors are candidates if, in some
table, the own cell of one is among the cells of the other; candidates are verified by cosine in
double precision. At cosine 0.98 one table finds a pair with probability 0.47, twelve find 0.9995.
Whether a pair is found depends on its two vectors alone, and on nothing else in the table.

A caller may ask for cells of one point of E8 and eight tables (a table finds 0.61 then): fewer
rows are filed, but the cells are some 300 times as large.

Exact copies are collapsed first and counted. A cell with many members is split into blocks of about
BLOCK members, and each pair of blocks is one unit of work, so no cell is gathered whole. A pair is
counted only in the first cell where it meets, which every unit can tell by itself from the
vectors; so no list of pairs is ever shuffled: units give link counts and a spanning star for each
group they find.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

PROBES, SEED, BLOCK = 4, 20_240_607, 256
#: Scale of the projections, by the number of lattice points a cell is made of.
SCALE = {1: 1.4, 2: 0.9}
#: Tables by the number of lattice points a cell is made of.
TABLES = {1: 8, 2: 12}
#: A cell is made of so many lattice points, however many vectors there are.
POINTS = 2
COSINE = 0.98
#: More than a cosine of unit vectors is off by.
ROUNDING = 1e-9


@functools.lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    d = x - r
    rows = np.flatnonzero(r.sum(-1).astype(np.int64) & 1)
    worst = np.abs(d[rows]).argmax(-1)
    r[rows, worst] += np.where(d[rows, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: even-sum integers, or those moved by one half everywhere."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


@functools.lru_cache(maxsize=16)
def _directions(dim: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections of each table and odd multipliers that hash a cell."""
    rng = np.random.default_rng([SEED, dim, *[points] * (points > 1)])
    return rng.normal(size=(TABLES[points], dim, 8 * points)) * SCALE[points], rng.integers(1, 1 << 62, size=(TABLES[points], 8 * points + 1)) | 1


def cells(unit: np.ndarray, salt: np.ndarray, points: int = 1) -> np.ndarray:
    """(vectors, tables, 1 + PROBES) hashed cells, a vector's own cell first; salt keeps labels apart."""
    project, mult = _directions(unit.shape[1], points)
    out = np.empty((len(unit), TABLES[points], 1 + PROBES), np.int64)
    steps = np.zeros((240 * points, 8 * points))
    for i in range(points):
        steps[240 * i : 240 * (i + 1), 8 * i : 8 * (i + 1)] = roots()
    for t in range(TABLES[points]):
        x = unit @ project[t]
        own = nearest_e8(x.reshape(-1, 8)).reshape(x.shape)
        toward = (x - own) @ steps.T
        best, every = np.empty((len(unit), PROBES), np.int64), np.arange(len(unit))
        for i in range(PROBES):  # a sort of all 480 steps takes longer
            best[:, i] = toward.argmax(1)
            toward[every, best[:, i]] = -np.inf
        near = np.concatenate([own[:, None, :], own[:, None, :] + steps[best]], axis=1)
        twice = np.rint(near * 2).astype(np.int64)
        with np.errstate(over="ignore"):
            h = (twice * mult[t, :-1]).sum(-1) + salt[:, None] * mult[t, -1]
            h = (h ^ (h >> 29)) * mult[0, 0]
            out[:, t] = h ^ (h >> 32)
    return out


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of vector in a list column."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. They are scaled by a power of two first, which loses nothing, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near_pairs(u: np.ndarray, begin: np.ndarray, size: np.ndarray, own: np.ndarray, side: np.ndarray, other: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of near vectors within each unit of consecutive rows; units of one size are compared together."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size):
        of = begin[size == m]
        step = max(1, 1_000_000 // (m * m))
        for at in range(0, len(of), step):
            rows = of[at : at + step, None] + np.arange(m)
            x = u[rows]
            near = x @ x.transpose(0, 2, 1) >= cosine - ROUNDING
            near &= np.triu(np.ones((m, m), bool), 1)
            near &= own[rows][:, :, None] | own[rows][:, None, :]
            apart = side[rows][:, :, None] != side[rows][:, None, :]
            near &= apart | ~other[rows[:, 0]][:, None, None]
            k, a, b = np.nonzero(near)
            a, b = rows[k, a], rows[k, b]
            # A product of matrices rounds by its shape; what counts is a sum that two vectors give in any unit.
            for at_pair in range(0, len(a), 100_000):
                p, q = a[at_pair : at_pair + 100_000], b[at_pair : at_pair + 100_000]
                true = (u[p] * u[q]).sum(1) >= cosine
                out_a.append(p[true])
                out_b.append(q[true])
    return np.concatenate(out_a), np.concatenate(out_b)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the links (a, b) join it with."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _verified(t: pa.Table, cosine: float, points: int) -> Iterator[pa.RecordBatch]:
    """(a, b, links) of whole units: the counts of verified pairs where they first meet, and stars that join them."""
    for at, x in _vectors(t.column("embedding").combine_chunks()):
        col = {c: t.column(c).to_numpy(zero_copy_only=False)[at] for c in ("key", "tab", "i", "j", "rep", "copies", "salt", "own", "side")}
        cut = np.ones(len(at), bool)
        cut[1:] = False
        for c in ("key", "tab", "i", "j"):
            cut[1:] |= col[c][1:] != col[c][:-1]
        begin = np.flatnonzero(cut)
        u = _unit(x)
        own = col["own"].astype(bool)
        a, b = _near_pairs(u, begin, np.diff(np.append(begin, len(at))), own, col["side"], col["i"] != col["j"], cosine)
        if not len(a):
            continue
        met, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        c = cells(u[met], col["salt"][met], points)
        swap = col["rep"][a] > col["rep"][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ca, cb = back[: len(a)], back[len(a) :]
        ca, cb = np.where(swap, cb, ca), np.where(swap, ca, cb)
        here = np.zeros(len(a), bool)
        for s in range(0, len(a), 100_000):
            x, y = c[ca[s : s + 100_000]], c[cb[s : s + 100_000]]
            # Where a pair meets: the cell of the lower id, else that of the higher, in the first table that has either.
            low, high = (x[:, :, :1] == y).any(-1), (y[:, :, :1] == x).any(-1)
            first, rows = (low | high).argmax(1), np.arange(len(x))
            where = np.where(low[rows, first], x[rows, first, 0], y[rows, first, 0])
            p = a[s : s + 100_000]
            here[s : s + 100_000] = (first == col["tab"][p]) & (where == col["key"][p])
        a, b = a[here], b[here]
        if not len(a):
            continue
        links = np.rint(np.bincount(a, col["copies"][b], len(at)) + np.bincount(b, col["copies"][a], len(at))).astype(np.int64)
        n, low = np.flatnonzero(links), stars(len(at), a, b)
        hung = np.flatnonzero(low != np.arange(len(at)))
        yield pa.record_batch([pa.array(col["rep"][n], pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(links[n], pa.int64())], names=["a", "b", "links"])
        yield pa.record_batch([pa.array(col["rep"][hung], pa.int64()), pa.array(col["rep"][low[hung]], pa.int64()), pa.array(np.zeros(len(hung), np.int64))], names=["a", "b", "links"])


def embedding_links(vectors: DataFrame, cosine: float = COSINE, points: int = POINTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    A row links with nothing if its id, label or vector is null, or its vector is empty, zero or
    holds a null or non-finite number; its component is its own vec_id. Vectors of different length
    never link. Repeated rows, and rows that share a vec_id, are vectors of their own. An empty
    table gives no rows, other columns are ignored. points: lattice points of a cell, 1 or 2.
    """
    spark = vectors.sparkSession
    C.prepare(spark)
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # Single precision stays as it is, half the size, and is widened where cosines are taken.
    kind = T.FloatType() if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else T.DoubleType()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.cast(T.ArrayType(kind)).alias("embedding"))
    rows = rows.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    reps = rows.where("_fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    reps = C.materialize(reps.withColumn("salt", F.xxhash64("label")).withColumn("rep", F.monotonically_increasing_id()), "e8-vectors")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TABLES[points] * (1 + PROBES)
        tab, own = np.repeat(np.arange(TABLES[points], dtype=np.int32), 1 + PROBES), np.arange(n) % (1 + PROBES) == 0
        for b in batches:
            rep, salt = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at, x in _vectors(b.column(1)):
                for i in range(0, len(at), 2048):
                    some = at[i : i + 2048]
                    c = cells(_unit(x[i : i + 2048]), salt[some], points)
                    yield pa.record_batch([pa.array(c.ravel()), pa.array(np.tile(tab, len(some))), pa.array(np.tile(own, len(some))), pa.array(np.repeat(rep[some], n))], names=["key", "tab", "own", "rep"])

    filed = C.materialize(reps.select("rep", "embedding", "salt").mapInArrow(file, "key long, tab int, own boolean, rep long"), "e8-cells")
    met = filed.groupBy("key", "tab").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").select("key", "tab", "n")
    met = C.materialize(met, "e8-met")
    blocks = F.ceil(F.col("n") / BLOCK)
    side = F.pmod(F.xxhash64("rep"), blocks)
    spread = filed.join(met, ["key", "tab"]).select("key", "tab", "own", "rep", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_with"))
    work = spread.select("key", "tab", "own", "rep", "side", F.least("side", "_with").alias("i"), F.greatest("side", "_with").alias("j"))
    work = work.join(reps.select("rep", "copies", "embedding", "salt"), "rep").select("key", "tab", "i", "j", "rep", "copies", "salt", "own", "side", "embedding")
    dealt = work.repartition("key", "tab", "i", "j").sortWithinPartitions("key", "tab", "i", "j", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 8192:
                continue
            t = pa.Table.from_batches(held)
            # The last unit may go on in the next batch.
            k = np.stack([t.column(c).to_numpy() for c in ("key", "tab", "i", "j")], axis=1)
            ends = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if len(ends):
                yield from _verified(t.slice(0, int(ends[-1])), cosine, points)
                held = t.slice(int(ends[-1])).to_batches()
        if held:
            yield from _verified(pa.Table.from_batches(held), cosine, points)

    found = C.materialize(dealt.mapInArrow(verify, "a long, b long, links long"), "e8-links")
    comps = C.connected_components(found.where("b is not null").select("a", "b"), "e8")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("_links"))
    named = reps.join(links, reps.rep == F.col("a"), "left").drop("a").join(comps, F.col("rep") == F.col("node"), "left").withColumn("_part", F.coalesce("component", "rep"))
    named = C.materialize(named.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "first_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "_part"), "e8-named")
    lowest = named.groupBy("_part").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "_part")
    linked = rows.where("_fine").join(named, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not _fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7_embedding_near_dedup over the whole embeddings table."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
