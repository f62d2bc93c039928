"""Merges a stream of pages into a stored graph, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfgraph import api
from shelfgraph.operators.fold import numbered


def merge_stream(pages: DataFrame, path: str, checkpoint: str, dedup_edges: bool = True) -> StreamingQuery:
    """Start merging ``pages(url, html, removed)``: pages with ``removed`` take their product out, the others are merged.

    A batch that is run again after a failure merges the same statements once more; with ``dedup_edges`` that changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # without gaps, since a page's place is shifted to make room for its statements
        fresh = numbered(batch.where("NOT coalesce(removed, false)").select(F.monotonically_increasing_id().alias("_at"), "html"), "_at", "page_seq").select("page_seq", "html")
        gone = [r["url"] for r in batch.where("removed").select("url").distinct().toLocalIterator()]
        api.merge_graph(spark, path, fresh, gone, path, dedup_edges)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
