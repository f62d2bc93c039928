"""Folds a statement log into a graph: upserts, property merges, edge resolution, removals, merges of two logs.

Every step is an aggregation that Spark can start within each task, or an equi-join; nothing needs the statements of one id in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.functions.values import typed_props
from shelfgraph.graph import Graph
from shelfgraph.schema import NODES
from shelfgraph.sources.pages import ENTRIES, STATEMENTS
from shelfgraph.sources.scratch import settle

_FIELDS = ("t", "b", "i", "d", "s", "l")
_VALUE = pa.struct([("t", pa.int8()), ("b", pa.bool_()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("l", pa.list_(pa.string()))])
_NODES = pa.schema([("idx", pa.int64()), *((c, pa.string()) for c in ("kind", "id", "name", "props_json")), ("props", pa.map_(pa.string(), _VALUE))])
#: Removed ids up to this number are broadcast.
BROADCAST_GONE = 100_000


def numbered(df: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name`` from 0 without gaps, in ``order``: sorted by ranges, then numbered by the sizes of the parts."""
    keys = [F.col(order)] if isinstance(order, str) else order
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = settle(parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sizes = {r["_part"]: r["n"] for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    start = F.element_at(F.lit(starts or [0]), F.col("_part") + 1)
    return held.withColumn(name, (start + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_part", "_row")


def fold_nodes(log: DataFrame) -> DataFrame:
    """(id, first, kind, name, entries, props_json) of each id: the last kind, the last name that is not empty, and merged properties.

    A value replaces another unless it is null or an empty string. Where a statement or its predecessor is not an object, the merge starts anew with it.
    """
    n = log.where("op = 'node'").select("seq", "kind", "id", "name", "entries", "props_json")
    plain, named = F.col("entries").isNull(), F.col("name") != ""
    base = n.groupBy("id").agg(
        F.min("seq").alias("first"),
        F.max_by("kind", "seq").alias("kind"),
        F.coalesce(F.max_by("name", F.when(named, F.col("seq"))), F.lit("")).alias("name"),
        F.max(F.when(plain, F.col("seq"))).alias("broken"),
        F.max_by("props_json", F.when(plain, F.col("seq"))).alias("last_plain"),
    )
    base = settle(base, "fold-base")
    after = n.join(base.where("broken IS NOT NULL").select("id", "broken"), "id").where("seq > broken").groupBy("id").agg(F.min("seq").alias("next"))
    base = base.join(after, "id", "left").withColumn("start", F.coalesce("next", "broken", "first"))
    pairs = n.select("id", "seq", F.explode("entries").alias("e")).select("id", "seq", "e.k", "e.v")
    merged = pairs.join(base.select("id", "start"), "id").where("seq >= start")
    full = ~F.col("v").isin("null", '""')
    merged = merged.groupBy("id", "k").agg(F.coalesce(F.max_by("v", F.when(full, F.col("seq"))), F.max_by("v", F.when(F.col("seq") == F.col("start"), F.col("seq")))).alias("v")).where("v IS NOT NULL")
    merged = merged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("entries"))
    broken = F.col("broken").isNotNull() & F.col("next").isNull()
    empty = F.array().cast(ENTRIES)
    return base.join(merged, "id", "left").select("id", "first", "kind", "name", F.when(~broken, F.coalesce("entries", empty)).alias("entries"), F.when(broken, F.col("last_plain")).alias("props_json"))


def build(log: DataFrame, removed_ids: DataFrame | None = None, removed_urls: DataFrame | None = None, dedup_edges: bool = False) -> Graph:
    """The graph of a log. ``removed_ids(id)`` goes with its edges; of ``removed_urls(url)``, the first node whose property url is that string. Edges with an end that is not there are
    dropped; repeated edges are kept unless ``dedup_edges``. An empty log gives an empty graph."""
    nodes = fold_nodes(log)
    if removed_urls is not None:
        url = F.get_json_object(F.concat(F.lit("["), F.try_element_at(F.filter("entries", lambda e: e["k"] == "url"), F.lit(1))["v"], F.lit("]")), "$[0]")
        quoted = F.try_element_at(F.filter("entries", lambda e: e["k"] == "url"), F.lit(1))["v"].startswith('"')
        nodes = settle(nodes, "folded")
        with_url = nodes.where(F.size("entries") > 0).select("id", "first", F.when(quoted, url).alias("url"))
        gone = with_url.join(removed_urls.select("url").distinct(), "url").groupBy("url").agg(F.min_by("id", "first").alias("id")).select("id")
        removed_ids = gone if removed_ids is None else removed_ids.select("id").unionByName(gone)
    if removed_ids is not None:
        gone = settle(removed_ids.select("id").where("id IS NOT NULL").distinct(), "removed")
        nodes = nodes.join(F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone, "id", "left_anti")
    nodes = numbered(nodes, "first", "idx")
    ids = nodes.select("id", "idx")
    e = log.where("op = 'edge'").select("seq", "src_id", "rel", "dst_id")
    e = e.join(ids.select(F.col("id").alias("src_id"), F.col("idx").alias("src")), "src_id").join(ids.select(F.col("id").alias("dst_id"), F.col("idx").alias("dst")), "dst_id")
    if dedup_edges:
        e = e.groupBy("src", "rel", "dst").agg(F.min("seq").alias("seq"))
    edges = e.select(F.col("seq").alias("eseq"), "src", "rel", "dst")
    return Graph(settle(_typed(nodes), "graph-nodes"), settle(edges, "graph-edges"))


def _typed(nodes: DataFrame) -> DataFrame:
    """Adds the JSON and the typed map of the properties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["entries"] is None:
                    text, props = r["props_json"], {}
                else:
                    text = "{" + ",".join(f"{_quoted(e['k'])}:{e['v']}" for e in r["entries"]) + "}"
                    props = typed_props(text)
                rows.append({"idx": r["idx"], "kind": r["kind"], "id": r["id"], "name": r["name"], "props_json": text, "props": [(k, dict(zip(_FIELDS, v, strict=True))) for k, v in props.items()]})
            yield pa.RecordBatch.from_pylist(rows, schema=_NODES)

    return nodes.select("idx", "kind", "id", "name", "entries", "props_json").mapInArrow(run, NODES)


def _quoted(k: str) -> str:
    import json

    return json.dumps(k, ensure_ascii=False)


def log_of(graph: Graph) -> DataFrame:
    """The statements that make ``graph`` again: nodes in order, then edges by source. Their numbers are below 0, so a new log follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                try:
                    v = json.loads(text) if text is not None else None
                except ValueError:
                    v = None
                out.append([{"k": k, "v": json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))} for k, x in sorted(v.items())] if isinstance(v, dict) else None)
            plain = [t if e is None else None for t, e in zip(b.column(3).to_pylist(), out, strict=True)]
            entries = pa.array(out, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(plain, pa.string()), entries, b.column(4)], names=["id", "kind", "name", "props_json", "entries", "idx"])

    nodes = graph.nodes.select("id", "kind", "name", "props_json", "idx").mapInArrow(run, f"id string, kind string, name string, props_json string, entries {ENTRIES}, idx long")
    none = F.lit(None).cast("string")
    low = F.lit(-(1 << 62))
    one = nodes.select((low + F.col("idx")).alias("seq"), F.lit("node").alias("op"), "kind", "id", "name", "entries", "props_json", none.alias("src_id"), none.alias("rel"), none.alias("dst_id"))
    names = graph.nodes.select("idx", "id")
    e = numbered(graph.edges, [F.col("src"), F.col("eseq")], "at")
    e = e.join(names.select(F.col("idx").alias("src"), F.col("id").alias("src_id")), "src").join(names.select(F.col("idx").alias("dst"), F.col("id").alias("dst_id")), "dst")
    two = e.select((F.lit(-(1 << 61)) + F.col("at")).alias("seq"), F.lit("edge").alias("op"), none.alias("kind"), none.alias("id"), none.alias("name"), F.lit(None).cast(ENTRIES).alias("entries"), none.alias("props_json"), "src_id", "rel", "dst_id")
    return one.unionByName(two)


def merge(graph: Graph | None, log: DataFrame, removed_urls: DataFrame | None = None, dedup_edges: bool = False) -> Graph:
    """``graph`` followed by ``log``; removals come last, so they win over a page of the same call."""
    whole = log.select([c.split()[0] for c in STATEMENTS.replace(ENTRIES, "x").split(", ")])
    if graph is not None:
        whole = log_of(graph).unionByName(whole)
    return build(settle(whole, "log"), removed_urls=removed_urls, dedup_edges=dedup_edges)


