"""Graphs on disk: a folder of versions, each with nodes by kind and edges by relation, and a pointer to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.graph import Graph
from shelfgraph.schema import EDGES, FORMAT_VERSION, KINDS, NODES, RELS, GraphError
from shelfgraph.sources.scratch import file_system

POINTER = "current.json"


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def save(graph: Graph, path: str) -> dict[str, int]:
    """Write a new version and then move the pointer to it; a reader sees the old graph or the new one. Returns the counts."""
    spark = graph.nodes.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    graph.nodes.write.partitionBy("kind").parquet(f"{path}/{version}/nodes")
    graph.edges.write.partitionBy("rel").parquet(f"{path}/{version}/edges")
    counts = {"nodes": graph.nodes.count(), "edges": graph.edges.count()}
    text = json.dumps({"format": FORMAT_VERSION, "version": version, **counts})
    fs, target = file_system(spark, f"{path}/{POINTER}")
    _, fresh = file_system(spark, f"{path}/{version}.json")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(options.Rename, 1)
    rename[0] = options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), rename)
    return counts


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, f"{path}/{POINTER}")
    return fs.exists(p)


def load(spark: SparkSession, path: str, validate: bool = False) -> Graph:
    """The current version. Raises GraphError for a folder without a graph, a damaged pointer or another format; ``validate`` also checks the tables."""
    text = _read(spark, f"{path}/{POINTER}")
    if text is None:
        raise GraphError(f"no graph at {path}")
    try:
        meta = json.loads(text)
        version, form = meta["version"], meta["format"]
    except (ValueError, KeyError, TypeError) as e:
        raise GraphError(f"damaged graph at {path}") from e
    if form != FORMAT_VERSION:
        raise GraphError(f"graph format {form}, expected {FORMAT_VERSION}")
    nodes = spark.read.schema(NODES).parquet(f"{path}/{version}/nodes").select(NODES.names)
    edges = spark.read.schema(EDGES).parquet(f"{path}/{version}/edges").select(EDGES.names)
    graph = Graph(nodes, edges)
    if validate:
        check(graph)
    return graph


def check(graph: Graph) -> None:
    """Raises GraphError for unknown labels or relations, repeated numbers or ids, and edges that lead nowhere."""

    def none(df: DataFrame, what: str) -> None:
        if not df.isEmpty():
            raise GraphError(what)

    none(graph.nodes.where(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()), "a node has an unknown kind")
    none(graph.edges.where(~F.col("rel").isin(*RELS) | F.col("rel").isNull()), "an edge has an unknown relation")
    for key in ("idx", "id"):
        none(graph.nodes.groupBy(key).count().where(f"count > 1 OR {key} IS NULL"), f"a node's {key} is repeated or null")
    for end in ("src", "dst"):
        none(graph.edges.join(graph.nodes.select(F.col("idx").alias(end)), end, "left_anti"), f"an edge's {end} is not there")
