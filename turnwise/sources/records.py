"""JSON-lines records: sessions, static questions, graphs; written with sorted keys and read with explicit schemas and defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..shared import table_dir
from .trade import Graphs

#: Names of scalars, each with its own type.
_SCALARS = "map<string,variant>"
NODE = f"struct<id:string,label:string,attributes:{_SCALARS}>"
EDGE = f"struct<source:string,target:string,relation:string,weight:double,attributes:{_SCALARS}>"
GRAPH = f"struct<graph_id:string,nodes:array<{NODE}>,edges:array<{EDGE}>,directed:boolean,metadata:{_SCALARS}>"
EDIT = "struct<operation:string,target:string,node_id:string,source:string,destination:string,attribute:string,value:variant,label:string,relation:string,weight:double,reason:string>"
QUERY = "struct<reasoning_type:string,source:string,target:string,attribute:string,value:variant,question:string,hops:int>"
TURN = f"struct<turn_index:int,utterance:string,gold_edit:{EDIT},gold_edits:array<{EDIT}>,query:{QUERY},gold_answer:string,stale_answer:string,before_fingerprint:string,after_fingerprint:string,tags:array<string>,complexity:{_SCALARS}>"
SESSION = f"session_id string, split string, initial_graph {GRAPH}, turns array<{TURN}>, seed long, paraphrase_family string"
STATIC = f"tuple_id string, split string, graph {GRAPH}, query {QUERY}, answer string, topology string, density_bin string, hop_depth string, scale_bin string, metadata {_SCALARS}"


def sorted_json(df: DataFrame) -> Column:
    """A row as compact JSON with its columns in order of name; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.select(sorted_json(df).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a known schema; blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).json(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{table_dir(spark)}/{name}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """df written as JSON lines into the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    write_lines(df, path)
    return read_lines(df.sparkSession, path, df.schema)


def completed_graph(g: Column) -> Column:
    """A decoded graph with the defaults of fields that a record may leave out: label is the id, relation connected, weight 1, directed false."""
    nodes = F.transform(g["nodes"], lambda n: F.struct(n["id"].alias("id"), F.coalesce(n["label"], n["id"]).alias("label"), F.coalesce(n["attributes"], F.create_map().cast(_SCALARS)).alias("attributes")))
    edges = F.transform(g["edges"], lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), F.coalesce(e["relation"], F.lit("connected")).alias("relation"), F.coalesce(e["weight"], F.lit(1.0)).alias("weight"), F.coalesce(e["attributes"], F.create_map().cast(_SCALARS)).alias("attributes")))
    return F.struct(g["graph_id"].alias("graph_id"), nodes.alias("nodes"), edges.alias("edges"), F.coalesce(g["directed"], F.lit(False)).alias("directed"), g["metadata"].alias("metadata"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a JSON-lines file, graphs completed, and each turn's edits in gold_edits whether it gave one edit or several."""
    s = read_lines(spark, path, SESSION)
    edits = lambda t: F.when(F.size(F.coalesce(t["gold_edits"], F.array().cast(f"array<{EDIT}>"))) > 0, t["gold_edits"]).otherwise(F.array_compact(F.array(t["gold_edit"])))
    return s.withColumn("initial_graph", completed_graph(F.col("initial_graph"))).withColumn("turns", F.transform("turns", lambda t: t.withField("gold_edits", edits(t))))


def read_static(spark: SparkSession, path: str) -> DataFrame:
    """Static questions of a JSON-lines file with completed graphs."""
    return read_lines(spark, path, STATIC).withColumn("graph", completed_graph(F.col("graph")))


def _named(attributes: Column, name: str) -> Column:
    return F.try_element_at(attributes, F.lit(name))


def available(attributes: Column) -> Column:
    """Whether a node with these attributes can be used: unless its status is the string closed, or open is the boolean false."""
    status, is_open = _named(attributes, "status"), _named(attributes, "open")
    shut = (F.schema_of_variant(status) == "STRING") & (F.try_variant_get(status, "$", "string") == "closed")
    barred = (F.schema_of_variant(is_open) == "BOOLEAN") & ~F.try_variant_get(is_open, "$", "boolean")
    return ~F.coalesce(shut, F.lit(False)) & ~F.coalesce(barred, F.lit(False))


def graph_nodes(graphs: DataFrame, graph: str = "graph", key: Column | None = None) -> DataFrame:
    """(graph_id, node_id, label, is_open, attributes) from a column of graphs; key names a graph in place of its own id."""
    n = graphs.select((F.col(f"{graph}.graph_id") if key is None else key).alias("graph_id"), F.explode(f"{graph}.nodes").alias("n"))
    return n.select("graph_id", F.col("n.id").alias("node_id"), F.col("n.label").alias("label"), available(F.col("n.attributes")).alias("is_open"), F.col("n.attributes").alias("attributes"))


def graph_attributes(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, name, token, text) of every attribute of nodes as graph_nodes gives them."""
    a = nodes.select("graph_id", "node_id", F.explode("attributes").alias("name", "v"))
    return a.select("graph_id", "node_id", "name", scalars.scalar(F.col("v")).alias("s")).select("graph_id", "node_id", "name", "s.token", "s.text")


def graph_edges(graphs: DataFrame, graph: str = "graph", key: Column | None = None) -> DataFrame:
    """(graph_id, src, dst, relation, weight, directed) from a column of graphs."""
    e = graphs.select((F.col(f"{graph}.graph_id") if key is None else key).alias("graph_id"), F.coalesce(F.col(f"{graph}.directed"), F.lit(False)).alias("directed"), F.explode(f"{graph}.edges").alias("e"))
    return e.select("graph_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.relation").alias("relation"), F.col("e.weight").alias("weight"), "directed")


def collection(graphs: DataFrame, graph: str = "graph", key: Column | None = None) -> Graphs:
    """The frames of a column of graphs, which every question can be asked about."""
    nodes = graph_nodes(graphs, graph, key)
    return Graphs(nodes.drop("attributes"), graph_edges(graphs, graph, key), graph_attributes(nodes))


def record_queries(records: DataFrame, key: Column, query: str = "query") -> DataFrame:
    """(query_id, graph_id, kind, source, target, attribute, token, hops) of a column of queries; the key names both query and graph."""
    q = F.col(query)
    return records.select(key.alias("query_id"), key.alias("graph_id"), q["reasoning_type"].alias("kind"), q["source"].alias("source"), q["target"].alias("target"), q["attribute"].alias("attribute"), scalars.scalar(q["value"])["token"].alias("token"), q["hops"].alias("hops"))


def _object(pairs: Column) -> Column:
    """JSON text of an object from an array of (name, json), sorted by name."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(scalars.quoted(p["name"]), F.lit(":"), p["json"])), ","), F.lit("}"))


def _pairs(attributes: Column) -> Column:
    """JSON text of an attribute map as an array of [name, value], sorted by name."""

    def one(name: Column) -> Column:
        held = scalars.scalar(attributes[name])
        return F.concat(F.lit("["), scalars.quoted(name), F.lit(","), scalars.scalar_json(held["token"], held["text"]), F.lit("]"))

    # A VARIANT can't be compared, so names are sorted first.
    names = F.array_sort(F.map_keys(attributes))
    return F.concat(F.lit("["), F.array_join(F.transform(names, one), ","), F.lit("]"))


def fingerprint(graph: Column) -> Column:
    """SHA-256 of a completed graph, whatever the order of its nodes, edges and attributes; its own id and metadata don't count.

    The text hashed is {"directed":…,"edges":[[a,b,relation,weight,[[name,value],…]],…],"nodes":[[id,label,[[name,value],…]],…]}
    in ASCII without blanks; an undirected edge has its ends in order.
    """
    q = scalars.quoted
    join = lambda rows: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(rows), lambda x: x["json"]), ","), F.lit("]"))
    nodes = F.transform(graph["nodes"], lambda n: F.named_struct(F.lit("id"), n["id"], F.lit("label"), n["label"], F.lit("json"), F.concat(F.lit("["), q(n["id"]), F.lit(","), q(n["label"]), F.lit(","), _pairs(n["attributes"]), F.lit("]"))))

    def edge(e: Column) -> Column:
        swap = ~graph["directed"] & (e["source"] > e["target"])
        a, b = F.when(swap, e["target"]).otherwise(e["source"]), F.when(swap, e["source"]).otherwise(e["target"])
        text = F.concat(F.lit("["), q(a), F.lit(","), q(b), F.lit(","), q(e["relation"]), F.lit(","), scalars.float_text(e["weight"]), F.lit(","), _pairs(e["attributes"]), F.lit("]"))
        return F.named_struct(F.lit("a"), a, F.lit("b"), b, F.lit("relation"), e["relation"], F.lit("weight"), e["weight"], F.lit("json"), text)

    text = F.concat(F.lit('{"directed":'), graph["directed"].cast("string"), F.lit(',"edges":'), join(F.transform(graph["edges"], edge)), F.lit(',"nodes":'), join(nodes), F.lit("}"))
    return F.sha2(scalars.ascii_json(text), 256)


def chain_violations(sessions: DataFrame) -> DataFrame:
    """(session_id, turn_index, rule) of turns whose before_fingerprint is not the initial graph's (initial_state) or not the after_fingerprint of the turn before (broken_chain).

    sessions are as read_sessions gives them. A missing fingerprint is a violation.
    """
    first = fingerprint(F.col("initial_graph"))
    turns = F.transform("turns", lambda t, i: F.named_struct(F.lit("turn_index"), t["turn_index"], F.lit("before"), t["before_fingerprint"], F.lit("last"), F.when(i > 0, F.get("turns", i - 1)["after_fingerprint"]), F.lit("first"), i == 0))
    each = sessions.select("session_id", first.alias("_initial"), turns.alias("t")).select("session_id", "_initial", F.explode("t").alias("t")).select("session_id", "_initial", "t.*")
    rule = F.when(F.col("first") & ~F.col("before").eqNullSafe(F.col("_initial")), "initial_state").when(~F.col("first") & (F.col("before").isNull() | ~F.col("before").eqNullSafe(F.col("last"))), "broken_chain")
    return each.select("session_id", "turn_index", rule.alias("rule")).where("rule is not null")


def graph_json(g: Graphs) -> DataFrame:
    """(graph_id, json): each graph as a JSON record with sorted keys, nodes by id and edges by ends and relation."""
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("json"))
    q = scalars.quoted
    held = g.attrs.groupBy("graph_id", "node_id").agg(_object(F.collect_list(F.struct("name", scalars.scalar_json(F.col("token"), F.col("text")).alias("json")))).alias("attributes"))
    node = g.nodes.select("graph_id", "node_id", "label").join(held, ["graph_id", "node_id"], "left")
    node_json = _object(F.array(field("attributes", F.coalesce("attributes", F.lit("{}"))), field("id", q(F.col("node_id"))), field("label", q(F.col("label")))))
    nodes = node.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", node_json.alias("json")))).alias("nodes"))
    directed = F.col("directed") if "directed" in g.edges.columns else F.lit(False)
    edge_json = _object(F.array(field("relation", q(F.col("relation"))), field("source", q(F.col("src"))), field("target", q(F.col("dst"))), field("weight", scalars.float_text(F.col("weight")))))
    edges = g.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "relation", edge_json.alias("json")))).alias("edges"), F.bool_or(directed).alias("directed"))
    joined = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(c, lambda x: x["json"]), ","), F.lit("")), F.lit("]"))
    both = nodes.join(edges, "graph_id", "left")
    whole = _object(F.array(field("graph_id", q(F.col("graph_id"))), field("nodes", joined("nodes")), field("edges", joined("edges")), field("directed", F.coalesce(F.col("directed"), F.lit(False)).cast("string"))))
    return both.select("graph_id", whole.alias("json"))


def static_json(questions: DataFrame, graphs: DataFrame) -> DataFrame:
    """(value): one line for each question (query_id, kind, graph_id, source, target, attribute, value_json, hops, answer, split, scale_bin) with its whole graph from graph_json."""
    q = scalars.quoted
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("json"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    query = _object(F.array(
        field("reasoning_type", q(F.col("kind"))), field("source", q(F.col("source"))), field("target", q(F.col("target"))), field("attribute", q(F.col("attribute"))),
        field("value", F.coalesce("value_json", F.lit("null"))), field("hops", number("hops")),
    ))
    line = _object(F.array(field("tuple_id", q(F.col("query_id"))), field("split", q(F.col("split"))), field("graph", F.col("json")), field("query", query), field("answer", q(F.col("answer"))), field("scale_bin", q(F.col("scale_bin")))))
    return questions.join(graphs, "graph_id").select(line.alias("value"))


def turn_records(said: DataFrame, answers: DataFrame) -> DataFrame:
    """(session_id, turn_index, utterance, kind, gold_answer, stale_answer) of every turn."""
    a = answers.select("session_id", "turn_index", "kind", F.col("gold").alias("gold_answer"), F.col("stale").alias("stale_answer"))
    return said.select("session_id", "turn_index", "utterance").join(a, ["session_id", "turn_index"])


def stream_hash(df: DataFrame, order: list[str], by: str) -> DataFrame:
    """(by, records, sha256) of the rows of each key: SHA-256 over the hashes of their JSON lines, in order.

    Lines are hashed where they are, and only their hashes are brought together.
    """
    line = df.select(by, F.struct(*[F.col(c) for c in order]).alias("_o"), F.sha2(sorted_json(df), 256).alias("_h"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"])
    return line.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.sha2(F.array_join(listed, ""), 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """(name, change): files added, removed or changed since a manifest was made."""
    a, b = now.select("name", F.col("sha256").alias("x")), then.select("name", F.col("sha256").alias("y"))
    change = F.when(F.col("y").isNull(), "added").when(F.col("x").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, "name", "full").select("name", change.alias("change")).where("change is not null")
