"""Tables in the folder that the cluster names in spark.checkpoint.dir, and connected components over them.

Lineage is cut with Parquet tables that every executor can reach, so a lost executor costs a
re-read and never a failed job. All tables of one application lie in one folder, which clear()
deletes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver imported it from."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a local master gets a temporary one and a cluster raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", made := f"file://{tempfile.mkdtemp(prefix='turnwise-')}")
    return made


def table_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/turnwise/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df once into the shared folder and return it read back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{table_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnwise_path = path
    return out


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() gives, settled the first time this application asks for that name over that source."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _KEPT:
        _KEPT[key] = settle(build(), name)
    return _KEPT[key].sparkSession.read.schema(_KEPT[key].schema).parquet(_KEPT[key]._turnwise_path)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its rows numbered from 0 in the given order, which must tell all rows apart.

    Rows are dealt by ranges and numbered within each; the sizes of the ranges, one row a
    partition, say where each begins. No task sees more than its range.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    begin = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(begin, "_part").withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_part")


def discard(*tables: DataFrame | None) -> None:
    """Delete what settle() wrote for these, once nothing will read them again."""
    for df in tables:
        if df is not None and getattr(df, "_turnwise_path", None):
            delete(df.sparkSession, df._turnwise_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once no DataFrame that reads them is in use."""
    delete(spark, table_dir(spark))
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]


def linked_components(links: DataFrame, keys: tuple[str, ...] = (), name: str = "components") -> DataFrame:
    """(keys, node, component) for every node of the links (keys, a, b): component is the smallest node reachable within equal keys.

    Alternating stars: a large star hangs every greater neighbour of a node on the least node about
    it, a small star every lesser one; both keep what is connected and never add links. The links
    end as stars around the least nodes after a number of rounds that grows with the logarithm of
    the longest chain, so chains of any length settle and no cap on rounds is needed. Minima are
    pre-aggregated before the shuffle, and the links of a hub are split by adaptive skew joins.
    """
    keys = list(keys)
    now = settle(links.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    i = 0
    while True:
        # Done if all links hang nodes that are no centre on one centre each.
        roles = now.select(*keys, F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        roles = roles.unionByName(now.select(*keys, F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")).distinct())
        if roles.groupBy(*keys, "node").agg(F.sum("hangs").alias("n"), F.max("holds").alias("c")).where("n > 1 or (n > 0 and c > 0)").isEmpty():
            return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        i += 1
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("_near")).select(*keys, "a", F.least("a", "_near").alias("low"))
        large = settle(both.join(least, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("low").alias("b")).distinct(), f"{name}-large-{i}")
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("low"))
        small = large.join(least, [*keys, "a"]).where("b <> low").select(*keys, F.col("b").alias("a"), F.col("low").alias("b"))
        new = settle(small.unionByName(least.select(*keys, "a", F.col("low").alias("b"))).distinct(), f"{name}-small-{i}")
        discard(now, large)
        now = new
