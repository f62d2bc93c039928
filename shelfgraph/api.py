"""The public functions: build, merge and query graphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from shelfgraph.operators.fold import build, merge
from shelfgraph.plans.compiler import run_query
from shelfgraph.sources import store
from shelfgraph.sources.pages import pages_from_dir, pages_from_list, statements
from shelfgraph.sources.scratch import settle


def build_graph(spark: SparkSession, pages: Iterable[str] | DataFrame, out: str, dedup_edges: bool = False) -> dict[str, int]:
    """Extract ``pages``, texts or a frame (page_seq, html), and save the graph; returns the numbers of nodes and edges."""
    frame = pages if isinstance(pages, DataFrame) else pages_from_list(spark, pages)
    return store.save(build(settle(statements(frame), "log"), dedup_edges=dedup_edges), out)


def build_graph_from_dir(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    return build_graph(spark, pages_from_dir(spark, path), out)


def merge_graph(spark: SparkSession, existing: str, pages: Iterable[str] | DataFrame, removed_urls: Iterable[str] = (), out: str | None = None, dedup_edges: bool = False) -> dict[str, int]:
    """Add ``pages`` to the graph at ``existing``, then remove the products of ``removed_urls``. A graph that is not there is empty; a damaged one raises. ``out`` may be ``existing``, the default."""
    graph = store.load(spark, existing) if store.exists(spark, existing) else None
    frame = pages if isinstance(pages, DataFrame) else pages_from_list(spark, pages)
    urls = spark.createDataFrame([(u,) for u in removed_urls], "url string")
    return store.save(merge(graph, statements(frame), urls, dedup_edges), out or existing)


def query(spark: SparkSession, path: str, text: str, ordered: bool = True) -> DataFrame:
    return run_query(store.load(spark, path), text, ordered)
