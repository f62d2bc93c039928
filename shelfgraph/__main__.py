"""python -m shelfgraph FOLDER OUT: builds a graph of a folder's pages and shows the time of each step."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from shelfgraph import api
from shelfgraph.sources import store


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("shelfgraph").getOrCreate()
    began = time.time()
    print(api.build_graph_from_dir(spark, args[0], args[1]), f"build and save: {time.time() - began:.2f} s")
    began = time.time()
    graph = store.load(spark, args[1], validate=True)
    print(f"load and check: {time.time() - began:.2f} s")
    for text in ("MATCH (p:Product)-[:Brand]->(b:Brand) RETURN b.name AS brand, count(*) AS n", "MATCH (p:Product) RETURN p.name, p.price, p.currency LIMIT 20"):
        began = time.time()
        api.run_query(graph, text).show(truncate=60)
        print(f"{text}: {time.time() - began:.2f} s")
    print("Product to Brand edges:", graph.pair_count())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
