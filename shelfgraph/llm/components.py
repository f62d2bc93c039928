"""Connected components of an edge table, by label propagation with pointer jumping; labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.common import settle


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least node that it reaches. Repeated edges and loops do no harm; edges with a null end are left out.

    Each round takes the least label among the neighbours and then the label of that label, so rounds grow with the logarithm of the longest path.
    ``files`` bounds the number of files of what it writes.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = settle(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", files)
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels", files)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        better = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        moved = settle(better.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), (F.least("mid", F.coalesce("far", "mid")) != F.col("old")).alias("moved")), "labels", files)
        label = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return label
