"""Helpers shared by the operators of this subpackage: shared-folder tables, running totals, components.

Everything here is plain DataFrame code. Lineage is cut with Parquet tables written below the
folder the cluster names in ``spark.checkpoint.dir``, which every executor can reach, so a lost
executor costs a re-read and never a failed job.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import delete, discard, exists, linked_components, shared_dir, table_dir
from ..shared import settle as materialize

__all__ = ["connected_components", "delete", "discard", "exists", "materialize", "own_name", "prepare", "running_total", "shared_dir", "small_batches", "table_dir"]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver imported it from."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written within it go to and from Python workers by that many rows at a time, or fewer if the session says so.

    A batch of Spark's usual 10,000 whole texts or sets takes tens of MB, several times over: in
    the JVM's buffers for both directions, in the worker, and once more as Python objects.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before each row of its key, in ``order``.

    Rows are dealt by ranges of (keys, order), so that a hot key is spread over many blocks; blocks
    are summed first, and each row adds its own prefix in its block to the total of the blocks
    before. ``order`` must be unique within a key for the result to be defined.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_block", F.spark_partition_id())
    dealt = materialize(dealt, name)
    within = Window.partitionBy("_block", *keys).orderBy(*order)
    part = dealt.withColumn("_own", F.sum(value).over(within) - F.col(value))
    totals = dealt.groupBy("_block", *keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block")
    offsets = totals.select(F.col("_block").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys], (F.sum("_sum").over(before) - F.col("_sum")).alias("_off"))
    on = F.col("_block") == F.col("_b")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return part.join(offsets, on).withColumn(out, F.col("_own") + F.col("_off")).drop("_block", "_own", "_b", "_off", *[f"_k_{k}" for k in keys])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable, however long the chains are."""
    return linked_components(edges.select("a", "b"), name=name)
