"""Node vectors by feature hashing, and messages between neighbours: sums, means and maxima of vectors.

Vectors are sparse rows (graph, node, bucket, value), so hashing and passing messages are groupings
that Spark pre-aggregates, at any length of vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.hashing import bucket
from .adjacency import adjacency

DIM, SALT = 256, "graph-node-v1"
KEY = ["graph_id", "node_id"]


def node_vectors(nodes: DataFrame, attrs: DataFrame, dim: int = DIM, salt: str = SALT, unit: bool = True) -> DataFrame:
    """(graph_id, node_id, bucket, value) of every node: its id, label and attributes, each at a signed place.

    An attribute counts with its value as JSON; a finite number also counts by name with its
    hyperbolic tangent. unit divides by the length of the vector. Places that cancel out are left out,
    and so is a node whose places all do.
    """
    said = scalars.scalar_json(F.col("token"), F.col("text"))
    number = F.when(F.col("token").startswith("n:") & ~F.col("text").isin("True", "False"), F.col("text").try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    own = lambda df, key, size: df.select(*KEY, key.alias("key"), size.alias("size"))
    one = F.lit(1.0)
    parts = own(nodes, F.concat(F.lit("id="), "node_id"), one).unionByName(own(nodes, F.concat(F.lit("label="), "label"), one))
    parts = parts.unionByName(own(attrs, F.concat(F.lit("attr:"), "name", F.lit("="), said), one)).unionByName(own(attrs.where(finite), F.concat(F.lit("numeric:"), "name"), F.tanh(number)))
    placed = parts.where("key is not null").withColumn("b", bucket(F.col("key"), dim, salt))
    out = placed.groupBy(*KEY, F.col("b.bucket").alias("bucket")).agg(F.sum(F.col("b.sign") * F.col("size")).alias("value")).where("value <> 0")
    if not unit:
        return out
    length = out.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_length"))
    return out.join(length, KEY).select(*KEY, "bucket", (F.col("value") / F.col("_length")).alias("value"))


def messages(edges: DataFrame, vectors: DataFrame, how: str = "mean") -> DataFrame:
    """(graph_id, node_id, bucket, value): what the vectors of a node's neighbours add up to, along edges and by their weights.

    sum adds up the weighted vectors; mean divides that by the total of absolute weights, at least 1;
    max takes the greatest weighted value at each place, where a vector without the place has 0.
    Values of 0 and nodes without messages are left out.
    """
    if how not in ("sum", "mean", "max"):
        raise ValueError(f"how is sum, mean or max, not {how}")
    # A message goes along an edge, from src to dst.
    ways = adjacency(edges).select("graph_id", "src", "dst", "weight")
    sent = ways.join(vectors.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"), "bucket", (F.col("weight") * F.col("value")).alias("x"))
    met = sent.groupBy(*KEY, "bucket").agg(F.sum("x").alias("total"), F.max("x").alias("top"), F.count(F.lit(1)).alias("n"))
    if how == "sum":
        out = met.select(*KEY, "bucket", F.col("total").alias("value"))
    else:
        about = ways.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum(F.abs("weight")).alias("w"), F.count(F.lit(1)).alias("all"))
        both = met.join(about, KEY)
        value = F.col("total") / F.greatest("w", F.lit(1.0)) if how == "mean" else F.when(F.col("n") < F.col("all"), F.greatest("top", F.lit(0.0))).otherwise(F.col("top"))
        out = both.select(*KEY, "bucket", value.alias("value"))
    return out.where("value <> 0")


def dense(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(graph_id, node_id, vector) with all places."""
    held = vectors.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    return held.select(*KEY, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vector"))
