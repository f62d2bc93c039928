"""Folding, storing and merging, against a sequential fold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfgraph import api
from shelfgraph.graph import Graph
from shelfgraph.operators.fold import build, fold_nodes, merge
from shelfgraph.schema import GraphError
from shelfgraph.sources import store
from shelfgraph.sources.pages import page_sources, statement_log, statements
from shelfgraph.plans import catalogue
from shelfgraph.plans.fixtures import PAGES


def sequential(rows):
    """The fold, one statement after the other."""
    out = {}
    for _, kind, id, name, text in rows:
        new = json.loads(text)
        if id not in out:
            out[id] = [kind, name, new]
            continue
        old = out[id]
        old[0], old[1] = kind, name or old[1]
        if isinstance(old[2], dict) and isinstance(new, dict):
            old[2] = {**old[2], **{k: v for k, v in new.items() if v not in (None, "")}}
        else:
            old[2] = new
    return out


def test_fold_matches_sequential(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        props = rng.choice([lambda: {k: rng.choice([1, "", None, "x", "y", [1]]) for k in rng.sample("abc", rng.randint(0, 3))}, lambda: "text", lambda: None])()
        rows.append(("node", rng.choice(["Product", "Brand"]), f"i{rng.randint(0, 60)}", rng.choice(["", "A", "B"]), json.dumps(props)))
    got = {r["id"]: [r["kind"], r["name"], json.loads(r["props_json"]) if r["entries"] is None else {e["k"]: json.loads(e["v"]) for e in r["entries"]}] for r in fold_nodes(statement_log(spark, rows)).collect()}
    assert got == sequential(rows)


def test_order_edges_and_removal(spark):
    log = statement_log(
        spark,
        [
            ("node", "Product", "b", "B", '{"url": "u1"}'),
            ("node", "Product", "a", "A", '{"url": "u1"}'),
            ("node", "Brand", "x", "X", '"X"'),
            ("edge", "a", "Brand", "x"),
            ("edge", "a", "Brand", "x"),
            ("edge", "b", "Brand", "x"),
            ("edge", "b", "Offers", "none"),
        ],
    )
    g = build(log)
    assert [r["id"] for r in g.nodes.orderBy("idx").collect()] == ["b", "a", "x"]
    assert g.edges.count() == 3 and g.pair_count() == 3 and g.out_edges(1).count() == 2 and g.in_edges(2).count() == 3
    assert build(log, dedup_edges=True).edges.count() == 2
    less = build(log, removed_urls=spark.createDataFrame([("u1",), ("u2",)], "url string"))
    assert [r["id"] for r in less.nodes.orderBy("idx").collect()] == ["a", "x"]  # the first of the url's nodes goes
    again = merge(less, statement_log(spark, [("node", "Product", "a", "", '{"url": "", "n": 2}')]))
    assert again.edges.count() == 2 and json.loads(again.nodes.where("id = 'a'").first()["props_json"]) == {"n": 2, "url": "u1"}


def test_empty_log(spark):
    g = build(statement_log(spark, []))
    assert g.nodes.count() == 0 and g.edges.count() == 0


def test_store_and_merge(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    assert api.build_graph(spark, [PAGES["jsonld"], PAGES["graph"], PAGES["empty"]], path) == {"nodes": 12, "edges": 11}
    store.load(spark, path, validate=True)
    counts = api.merge_graph(spark, path, [PAGES["itemlist"]], ["https://s.test/products/chair"])
    assert counts == {"nodes": 15, "edges": 10}
    assert {r[0] for r in api.query(spark, path, "MATCH (p:Product) RETURN p.name AS n").collect()} == {"Desk Lamp", "One", "Two"}
    with pytest.raises(GraphError, match="no graph"):
        store.load(spark, f"file://{tmp_path}/nothing")
    (tmp_path / "g" / "current.json").write_text('{"format": 99, "version": "x"}')
    (tmp_path / "g" / ".current.json.crc").unlink(missing_ok=True)
    with pytest.raises(GraphError, match="format"):
        store.load(spark, path)


def test_validation(spark):
    g = build(statement_log(spark, [("node", "Product", "a", "A", "{}"), ("node", "Brand", "b", "B", "{}"), ("edge", "a", "Brand", "b")]))
    store.check(g)
    for bad in (
        Graph(g.nodes, g.edges.selectExpr("eseq", "src", "rel", "dst + 9 AS dst")),
        Graph(g.nodes, g.edges.selectExpr("eseq", "src", "'Likes' AS rel", "dst")),
        Graph(g.nodes.unionByName(g.nodes), g.edges),
        Graph(g.nodes.selectExpr("idx", "'Thing' AS kind", "id", "name", "props_json", "props"), g.edges),
    ):
        with pytest.raises(GraphError):
            store.check(bad)


def test_directory(spark, tmp_path):
    (tmp_path / "b.html").write_text(PAGES["itemlist"])
    (tmp_path / "a.htm").write_bytes(PAGES["jsonld"].encode() + b"\xff")
    (tmp_path / "c.txt").write_text(PAGES["graph"])
    assert api.build_graph_from_dir(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")["nodes"] == 13  # nine of the lamp's page, two products and their offers of the list


def test_stream(spark, tmp_path):
    from shelfgraph.streaming.merge import merge_stream

    spark.createDataFrame([("u", PAGES["itemlist"], False)], "url string, html string, removed boolean").write.parquet(f"{tmp_path}/in")
    pages = spark.readStream.schema("url string, html string, removed boolean").parquet(f"{tmp_path}/in")
    merge_stream(pages, f"file://{tmp_path}/g", f"{tmp_path}/cp").awaitTermination(120)
    assert api.query(spark, f"file://{tmp_path}/g", "MATCH (p:Product) RETURN p.name AS n").count() == 2


def test_pages_of_a_small_table_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(1, 1201).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "concat('Brand#', id % 5) AS p_brand", "cast(id % 50 AS int) AS p_size", "id + 0.5D AS p_retailprice")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    monkeypatch.setattr(catalogue, "PAGES_A_TASK", 100, raising=False)
    for made in (statements(catalogue._part_pages(spark, f"file://{tmp_path}")), page_sources(catalogue._part_pages(spark, f"file://{tmp_path}"))):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 3 and max(sizes) <= sum(sizes) / 2
    got = {r["source"]: r["n"] for r in catalogue.QUERIES["part_pages_sources"](spark, f"file://{tmp_path}").collect()}
    assert got == {"jsonld": 400, "microdata": 400, "empty": 400}
    got = sorted(map(tuple, catalogue.QUERIES["removed_ids"](spark, f"file://{tmp_path}").collect()))
    kept = sum(k % 3 == 0 and k % 50 >= 20 for k in range(1, 1201))
    assert got == [("Brand", 5), ("Offer", 400), ("Offers", kept), ("Product", 400 + kept)]


def _parts(spark, path, monkeypatch):
    """300 parts in one file, in pages of 30 for each task."""
    rows = spark.range(1, 301).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "concat('Brand#', id % 5) AS p_brand", "cast(id % 50 AS int) AS p_size", "id + 0.5D AS p_retailprice")
    rows.coalesce(1).write.parquet(f"file://{path}/part.parquet")
    monkeypatch.setattr(catalogue, "PAGES_A_TASK", 30, raising=False)
    return f"file://{path}"


def test_products_of_a_small_table(spark, tmp_path, monkeypatch):
    path = _parts(spark, tmp_path, monkeypatch)
    assert len(catalogue._part_log(spark, path).inputFiles()) >= 3
    got = {tuple(r) for r in catalogue.QUERIES["part_pages_products"](spark, path).collect()}
    url = lambda k: f"https://shop.test/{'offer' if k % 3 == 0 and k % 2 else 'p'}/{k}"
    assert {(n, c, u, None if p is None else str(p)) for n, c, u, p in got} == {(f"part {k}", k * 100 + 50, url(k), str(k) if k % 3 else None) for k in range(1, 301) if k % 3 < 2}


def test_stored_graph_of_a_small_table(spark, tmp_path, monkeypatch):
    path, logs = _parts(spark, tmp_path, monkeypatch), []
    monkeypatch.setattr(catalogue, "build", lambda log, **more: logs.append(log) or build(log, **more))
    got = sorted(map(tuple, catalogue.QUERIES["stored_graph"](spark, path).collect()))
    assert len(logs[0].inputFiles()) >= 3
    assert got == [(f"Brand#{b}", 20, float(sum(k * 100 + 50 for k in range(1, 301) if k % 3 == 0 and k % 5 == b))) for b in range(5)]


@pytest.mark.parametrize("ids", [range(0), range(2, 3), range(1, 32)])
def test_sources_of_a_small_table(spark, tmp_path, monkeypatch, ids):
    path = _parts(spark, tmp_path, monkeypatch)
    spark.read.parquet(f"{path}/part.parquet").where(F.col("p_partkey").isin(list(ids))).coalesce(1).write.parquet(f"{path}/few/part.parquet")
    pages = catalogue._part_pages(spark, f"{path}/few")
    assert len(pages.inputFiles()) == max(1, -(-len(ids) // 30)) and all("/part.parquet/" not in f for f in pages.inputFiles())
    got = {r["source"]: r["n"] for r in catalogue.QUERIES["part_pages_sources"](spark, f"{path}/few").collect()}
    expected = {"jsonld": sum(k % 3 == 0 for k in ids), "microdata": sum(k % 3 == 1 for k in ids), "empty": sum(k % 3 == 2 for k in ids)}
    assert got == {k: n for k, n in expected.items() if n}
