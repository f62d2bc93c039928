"""A property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """``nodes`` has idx, kind, id, name and either ``props``, a map of tagged values, or promoted columns; ``edges`` has eseq, src, rel, dst.

    ``promoted`` names the column of each property that is stored as a column of its own, so that it is pruned and pushed down. ``tags`` is the
    memo of the value types that a property of the map has. ``by_kind`` and ``by_rel`` hold the tables that make up nodes and edges, where a graph is a view
    of several tables: a pattern with a label or a relation then plans only those. ``ends`` has the kinds of the source and the destination of each relation,
    where that is all it can have.
    """

    nodes: DataFrame
    edges: DataFrame
    promoted: dict[str, str] = field(default_factory=dict)
    tags: dict[str, frozenset[int]] = field(default_factory=dict)
    by_kind: dict[str, DataFrame] = field(default_factory=dict)
    by_rel: dict[str, DataFrame] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)

    def nodes_of(self, kind: str | None) -> DataFrame:
        if kind is None:
            return self.nodes
        return self.by_kind[kind] if kind in self.by_kind else self.nodes.where(F.col("kind") == kind)

    def edges_of(self, rels: tuple[str, ...]) -> DataFrame:
        if not rels:
            return self.edges
        if all(r in self.by_rel for r in rels):
            return reduce(DataFrame.unionByName, [self.by_rel[r] for r in dict.fromkeys(rels)])
        return self.edges.where(F.col("rel").isin(list(rels)))

    def out_edges(self, idx: int) -> DataFrame:
        return self.edges.where(F.col("src") == idx)

    def in_edges(self, idx: int) -> DataFrame:
        return self.edges.where(F.col("dst") == idx)

    def tags_of(self, prop: str) -> frozenset[int]:
        """The types that the values of ``prop`` have in the map; one scan for each property, once."""
        if prop not in self.tags:
            seen = self.nodes.select(F.col("props")[prop]["t"].alias("t")).where("t IS NOT NULL").distinct()
            self.tags[prop] = frozenset(r["t"] for r in seen.collect())
        return self.tags[prop]

    def pair_count(self, kind: str = "Product", rel: str = "Brand") -> int:
        """Edges ``rel`` that leave nodes of ``kind``, whatever they lead to."""
        sources = self.nodes.where(F.col("kind") == kind).select(F.col("idx").alias("src"))
        return self.edges.where(F.col("rel") == rel).join(sources, "src", "left_semi").count()


