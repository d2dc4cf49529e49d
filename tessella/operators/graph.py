"""The work graph: nodes, edges, vectors of nodes, and a registry of other graphs.

nodes(id, type, title, body, status, harness_origin, created_at, updated_at, metadata_json),
edges(id, from_id, to_id, kind, weight, created_at), node_embeddings(node_id, embedding).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.vectors import hashed_embedding, knn

DIMS = 384
NODE = "id string, type string, title string, body string, status string, harness_origin string, created_at string, updated_at string, metadata_json string"
EDGE = "id string, from_id string, to_id string, kind string, weight double, created_at string"
REGISTRY = "project_name string, db_path string, parent_registry_id string, last_seen string"


class NodeNotFound(KeyError):
    pass


def _now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def embed_text(title, body):
    """What is embedded of a node: title, blank line, body."""
    return F.concat_ws("\n\n", title, body)


def create_nodes(nodes: DataFrame, vectors: DataFrame, new: DataFrame, embed: Callable = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """Both tables with new nodes (type, title, body, ...) and their vectors; ids are made where absent."""
    have = {c for c in new.columns}
    field = lambda c, default: (F.coalesce(F.col(c), default) if c in have else default)
    none = F.lit(None).cast("string")
    fresh = new.select(
        field("id", F.lit(None) if "id" in have else F.uuid()).alias("id"), *[field(c, none).cast("string").alias(c) for c in ("type", "title", "body")], field("status", F.lit("open")).alias("status"),
        field("harness_origin", none).alias("harness_origin"), _now().alias("created_at"), _now().alias("updated_at"), field("metadata_json", F.lit("{}")).alias("metadata_json"),
    )
    added = fresh.select(F.col("id").alias("node_id"), embed(embed_text(F.col("title"), F.coalesce("body", F.lit(""))), DIMS).alias("embedding"))
    return nodes.unionByName(fresh), vectors.unionByName(added)


def get_node(nodes: DataFrame, node_id: str):
    row = nodes.where(F.col("id") == node_id).first()
    if row is None:
        raise NodeNotFound(node_id)
    return row


def update_nodes(nodes: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes with the fields of `changes` (by id); an absent or null field keeps what was there. Of several
    changes to one field of a node the last by `order` counts, and without an order the greatest value.
    Ids that no node has are ignored; vectors are not made anew."""
    fields = [c for c in changes.columns if c != "id" and c in nodes.columns]
    fields = [c for c in fields if c != order]
    last = lambda c: F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    latest = changes.groupBy("id").agg(*[last(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    out = nodes.join(latest, "id", "left")
    cols = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.when(F.col("__hit"), _now()).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in nodes.columns]
    return out.select(*cols)


def list_nodes(nodes: DataFrame, type: str | None = None, status: str | None = None) -> DataFrame:
    for c, v in (("type", type), ("status", status)):
        if v is not None:
            nodes = nodes.where(F.col(c) == v)
    return nodes.orderBy("created_at", "id")


def create_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with new ones (from_id, to_id, kind[, weight]); an end that no node has is refused."""
    ends = new.select(F.explode(F.array("from_id", "to_id")).alias("id")).join(nodes.select("id"), "id", "left_anti").limit(1).collect()
    if ends:
        raise NodeNotFound(ends[0][0])
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in new.columns else F.lit(1.0)
    return edges.unionByName(new.select(F.uuid().alias("id"), "from_id", "to_id", "kind", weight.alias("weight"), _now().alias("created_at")))


def list_edges(edges: DataFrame, from_id: str | None = None, to_id: str | None = None, kind: str | None = None) -> DataFrame:
    for c, v in (("from_id", from_id), ("to_id", to_id), ("kind", kind)):
        if v is not None:
            edges = edges.where(F.col(c) == v)
    return edges.orderBy("created_at", "id")


def traverse(edges: DataFrame, start, kind: str | None, max_depth: int, nodes: DataFrame | None = None) -> DataFrame:
    """(id, depth): what can be reached along edges of one kind, at its least depth.

    The start itself is there only if a cycle leads back to it. A depth of 0 reads as 1. Breadth
    first: each round joins the frontier to the edges and drops what was seen, so walks are never
    counted out. Rounds are written to the shared folder if one is set, which keeps plans short."""
    hops = edges.where(F.col("kind") == kind) if kind is not None else edges
    hops = hops.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    where = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    if where:
        edges.sparkSession.sparkContext.setCheckpointDir(where)
    frontier = hops.where(F.col("a") == F.lit(start)).select(F.col("b").alias("id")).distinct()
    seen = frontier.withColumn("depth", F.lit(1))
    for depth in range(2, max(1, max_depth) + 1):
        frontier = frontier.join(hops, frontier.id == hops.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        if where:
            frontier = frontier.checkpoint()
            if frontier.isEmpty():
                break
        seen = seen.unionAll(frontier.withColumn("depth", F.lit(depth)))
    return seen if nodes is None else seen.join(nodes.select("id"), "id", "left_semi")


def search(nodes: DataFrame, vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(nodes' columns, distance): the nodes of the k nearest vectors; a vector without a node takes
    one of the k places and gives no row."""
    best = knn(vectors.select(F.col("node_id").alias("key"), "embedding"), query, k)
    return nodes.join(F.broadcast(best), nodes.id == best.key).drop("key").orderBy("distance", "id")  # at most k rows


def doctor(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(finding, count): nodes without a vector, vectors without a node, edges with an end missing."""
    ids = nodes.select("id")
    dangling = edges.join(ids.withColumnRenamed("id", "from_id").withColumn("__f", F.lit(1)).distinct(), "from_id", "left")
    dangling = dangling.join(ids.withColumnRenamed("id", "to_id").withColumn("__t", F.lit(1)).distinct(), "to_id", "left").where("__f is null or __t is null")
    counted = lambda name, df: df.agg(F.count("*").alias("count")).select(F.lit(name).alias("finding"), "count")
    return (
        counted("unindexed_nodes", nodes.join(vectors, nodes.id == vectors.node_id, "left_anti"))
        .unionAll(counted("orphan_embeddings", vectors.join(nodes, nodes.id == vectors.node_id, "left_anti")))
        .unionAll(counted("dangling_edges", dangling))
    )


def unindexed(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector, oldest first."""
    return nodes.join(vectors, nodes.id == vectors.node_id, "left_anti").orderBy("created_at", "id")


def reindex(nodes: DataFrame, vectors: DataFrame, embed: Callable = hashed_embedding) -> DataFrame:
    """Vectors with those added that nodes lack."""
    lacking = nodes.join(vectors, nodes.id == vectors.node_id, "left_anti")
    return vectors.unionByName(lacking.select(F.col("id").alias("node_id"), embed(embed_text(F.col("title"), F.coalesce("body", F.lit(""))), DIMS).alias("embedding")))


def register_child(registry: DataFrame, name: str, path: str, own_path: str, parent: str | None = None) -> DataFrame:
    """The registry with a child named; a relative path is taken from our own folder."""
    full = path if path.startswith("/") or "://" in path else f"{own_path.rstrip('/')}/{path}"
    row = registry.sparkSession.createDataFrame([(name, full, parent)], "project_name string, db_path string, parent_registry_id string").withColumn("last_seen", _now())
    return registry.where(F.col("project_name") != name).unionByName(row)


def list_children(registry: DataFrame) -> DataFrame:
    return registry.orderBy("project_name")


def rollup(spark: SparkSession, root: str, read: Callable[[str], tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame | None, list[str]]:
    """(nodes of this graph and all registered below it, each once, with column origin; warnings).

    The walk over registries is a loop on the driver over graphs, not over rows; one that can't be
    read is a warning."""
    import posixpath

    read = read or (lambda p: (spark.read.parquet(f"{p}/nodes"), spark.read.parquet(f"{p}/registry")))
    todo, seen, parts, warnings = [root], set(), [], []
    while todo:
        path = todo.pop(0)
        canonical = path if "://" in path else posixpath.normpath(path)
        if canonical in seen:
            continue
        seen.add(canonical)
        try:
            nodes, registry = read(canonical)
            children = [posixpath.join(canonical, r[0]) for r in registry.select("db_path").orderBy("db_path").toLocalIterator()]
        except Exception as e:
            warnings.append(f"{canonical}: {type(e).__name__}")
            continue
        parts.append(nodes.withColumn("origin", F.lit(canonical)))
        todo += children
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out, warnings


def statements(sql: str) -> list[str]:
    """The statements of a text, split at semicolons outside quotes and comments."""
    tokens = re.findall(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", sql, re.S)
    out, cur = [], ""
    for t in tokens:
        if t == ";":
            out.append(cur)
            cur = ""
        else:
            cur += t
    return [s.strip() for s in [*out, cur] if s.strip()]


def query_json(spark: SparkSession, sql: str) -> DataFrame:
    """(json): the rows of one statement; several are refused."""
    found = statements(sql)
    if len(found) != 1:
        raise ValueError(f"one statement is wanted, {len(found)} given")
    df = spark.sql(found[0])
    cols = [F.concat(F.lit("<blob "), F.octet_length(F.col(f"`{c}`")).cast("string"), F.lit(" bytes>")).alias(c) if t == "binary" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def new_id() -> str:
    return str(uuid.uuid4())


# The store: a folder with a table of nodes, edges, vectors and children

STORE = {
    "nodes": "id string, type string, title string, body string, status string, metadata_json string, created_at string, updated_at string",
    "edges": "from_id string, to_id string, kind string, weight double, created_at string",
    "node_embeddings": "node_id string, embedding array<float>",
    "registry": "project_name string, db_path string, parent_registry_id string, last_seen string",
}
STORE_VARIABLE, STORE_NAME = "TESSELLA_STORE", ".tessella/graph"


def open_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a store; those that aren't there yet are made, empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, schema in STORE.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(conf).exists(path):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return out


def broken_references(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(kind, id): ends of edges, and vectors, that no node has: what a foreign key would refuse."""
    ends = edges.select(F.lit("edge").alias("kind"), F.explode(F.array("from_id", "to_id")).alias("id")).unionAll(vectors.select(F.lit("vector"), "node_id"))
    return ends.distinct().join(nodes.select("id"), "id", "left_anti").select("kind", "id")


def store_path(start: str, environment: dict[str, str] | None = None) -> str | None:
    """The store of a folder: what the environment names, else the nearest STORE_NAME in the folder or above
    it; null if there is none."""
    import os

    named = (os.environ if environment is None else environment).get(STORE_VARIABLE)
    if named:
        return named
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, STORE_NAME)):
            return os.path.join(at, STORE_NAME)
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)
