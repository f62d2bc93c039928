"""Node numbers of the star schema."""

import pytest
from pyspark.sql import functions as F

from shelfgraph.plans.compiler import run_query
from shelfgraph.sources.star import _TABLES, star_graph


def _graph(spark, pairs, path):
    for name, schema in _TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"file://{path}/{name}.parquet")
    empty = spark.createDataFrame([], _TABLES["lineitem"])
    empty.unionByName(pairs, allowMissingColumns=True).write.mode("overwrite").parquet(f"file://{path}/lineitem.parquet")
    return star_graph(spark, f"file://{path}")


def test_each_pair_is_one_variant(spark, tmp_path):
    # cut to 40 bits, the hashes of some of four million pairs are alike
    ids = spark.range(4_000_000).select((F.col("id") / 20).cast("long").alias("l_partkey"), (F.col("id") % 20).alias("l_suppkey"))
    cut = ids.withColumn("h", F.pmod(F.xxhash64("l_partkey", "l_suppkey"), F.lit(1 << 40)))
    twins = cut.groupBy("h").agg(F.collect_list(F.struct("l_partkey", "l_suppkey")).alias("p")).where(F.size("p") > 1).select(F.explode("p").alias("p")).select("p.*").collect()
    assert len(twins) >= 2
    pairs = spark.createDataFrame([*((r[0], r[1]) for r in twins), (None, 1), (1, None), (None, None)], "l_partkey long, l_suppkey long")
    graph = _graph(spark, pairs, tmp_path)
    assert graph.by_kind["Variant"].select("idx").distinct().count() == pairs.count()
    edges = graph.by_rel["HasVariant"]
    assert edges.join(graph.by_kind["Variant"], edges["dst"] == F.col("idx")).count() == pairs.count()


def test_key_out_of_range(spark, tmp_path):
    graph = _graph(spark, spark.createDataFrame([(1 << 31, 1)], "l_partkey long, l_suppkey long"), tmp_path)
    with pytest.raises(Exception, match="key out of range"):
        graph.by_kind["Variant"].collect()


def test_counts_at_a_hub_are_not_multiplied_out(spark, tmp_path):
    _graph(spark, spark.createDataFrame([(1, 1)], "l_partkey long, l_suppkey long"), tmp_path)
    parts = spark.range(300).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "if(id < 250, 'Brand#1', if(id < 290, 'Brand#2', null)) AS p_brand", "'PROMO' AS p_type", "cast(id % 50 AS int) AS p_size", "1.5D AS p_retailprice")
    parts.write.mode("overwrite").parquet(f"file://{tmp_path}/part.parquet")
    graph = star_graph(spark, f"file://{tmp_path}")
    for text, expected in (
        ("MATCH (a:Product {size: 7})-[:Brand]->(b)<-[:Brand]-(a) RETURN a.pkey AS k, count(*) AS n", [*((k, 250) for k in range(7, 250, 50)), (257, 40)]),
        ("MATCH (c)-[:Brand]->(b)<-[:Brand]-(a:Product) WHERE a.size = 7 RETURN a.pkey AS k, count(*) AS n", [*((k, 250) for k in range(7, 250, 50)), (257, 40)]),
        ("MATCH (a:Product {size: 7})-[:Brand]->(b)<-[:Brand]-(c:Product {size: 9}) RETURN b.name AS b, count(*) AS n", [("Brand#1", 25), ("Brand#2", 1)]),
    ):
        got = run_query(graph, text)
        assert sorted(map(tuple, got.collect())) == expected
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "t1_times" in plan  # one end is counted by brand before it is joined
        assert {f.rsplit("/", 2)[-2] for f in got.inputFiles()} == {"part.parquet"}  # a relation's ends are the only nodes that are read
