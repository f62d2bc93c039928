"""Registered queries over the star-schema graph, each beside its SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.graph import Graph
from shelfgraph.operators.fold import build, merge
from shelfgraph.plans import fixtures
from shelfgraph.plans.compiler import run_query
from shelfgraph.sources import store
from shelfgraph.sources.pages import page_sources, pages_from_list, statement_log, statements
from shelfgraph.sources.scratch import new_folder, settle, spread
from shelfgraph.sources.star import event_graph, star_graph

CENTS = "cast(round(p_retailprice * 100) AS BIGINT)"
#: name: (query, SQL)
STAR: dict[str, tuple[str, str]] = {
    "two_hop": ("MATCH (p:Product)-[:Review]->(r:Review)-[:Author]->(a:Person) RETURN a.segment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "scan_label": ("MATCH (p:Product) RETURN p.name AS name, p.price_cents AS c", f"SELECT p_name AS name, {CENTS} AS c FROM part"),
    "inline_props": ("MATCH (p:Product {type: 'PROMO', size: 5}) RETURN p.pkey AS k, p.name AS name", "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_type = 'PROMO' AND p_size = 5"),
    "hop_out": ("MATCH (p:Product)-[:Brand]->(b:Brand) RETURN b.name AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1"),
    "hop_in": ("MATCH (b:Brand)<-[:Brand]-(p:Product) RETURN b.name AS brand, p.pkey AS k", "SELECT p_brand AS brand, p_partkey AS k FROM part"),
    "hop_multi_rel": ("MATCH (p:Product)-[:Brand|Category]->(x) RETURN x.kind AS kind, count(*) AS n", "SELECT 'Brand' AS kind, count(*) AS n FROM part UNION ALL SELECT 'Category', count(*) FROM part"),
    "hop_untyped": (
        "MATCH (p:Product)-->(x) RETURN x.kind AS k, count(*) AS n",
        "SELECT 'Brand' AS k, count(*) AS n FROM part UNION ALL SELECT 'Category', count(*) FROM part UNION ALL SELECT 'Offer', count(*) FROM lineitem UNION ALL SELECT 'Review', count(*) FROM lineitem UNION ALL SELECT 'Organization', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'Variant', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
    ),
    "hop_in_untyped": ("MATCH (b:Brand)<--(x) RETURN b.name AS b, count(x) AS n", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1"),
    "mixed_dir": ("MATCH (a:Product {size: 7})-[:Brand]->(b)<-[:Brand]-(c:Product {size: 9}) RETURN b.name AS b, count(*) AS n", "SELECT x.p_brand AS b, count(*) AS n FROM part x JOIN part y ON x.p_brand = y.p_brand WHERE x.p_size = 7 AND y.p_size = 9 GROUP BY 1"),
    "repeated_variable": ("MATCH (a:Product {size: 7})-[:Brand]->(b)<-[:Brand]-(a) RETURN a.pkey AS k, count(*) AS n", "SELECT x.p_partkey AS k, count(*) AS n FROM part x JOIN part y ON x.p_brand = y.p_brand WHERE x.p_size = 7 GROUP BY 1"),
    "category_chain": ("MATCH (n:Category)-[:BroaderCategory]->(r:Category) RETURN n.name AS nation, r.name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "manufacturer": ("MATCH (o:Organization)<-[:Manufacturer]-(p:Product)-[:HasVariant]->(v:Variant) WHERE p.size < 3 RETURN o.name AS org, count(v) AS n", "WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT s_name AS org, count(*) AS n FROM d x JOIN d y ON x.l_partkey = y.l_partkey JOIN supplier ON s_suppkey = x.l_suppkey JOIN part ON p_partkey = x.l_partkey WHERE p_size < 3 GROUP BY 1"),
    "where_and_or_paren": ("MATCH (p:Product) WHERE (p.size = 3 OR p.size = 4) AND p.type = 'PROMO' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (3, 4) AND p_type = 'PROMO'"),
    "not_two_valued": ("MATCH (p:Product) WHERE NOT p.missing = 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM part"),
    "not_nested": ("MATCH (p:Product) WHERE NOT (NOT p.size > 10 OR p.type = 'PROMO') RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 10 AND p_type <> 'PROMO'"),
    "cmp_range": ("MATCH (p:Product) WHERE p.price_cents >= 95000 AND p.price_cents < 97000 RETURN p.pkey AS k, p.price_cents AS c", f"SELECT p_partkey AS k, {CENTS} AS c FROM part WHERE {CENTS} >= 95000 AND {CENTS} < 97000"),
    "cmp_eq": ("MATCH (p:Product) WHERE p.size = 7.0 RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size = 7"),
    "ne_cross_type": ("MATCH (p:Product) WHERE p.brand <> 5 RETURN count(*) AS n", "SELECT count(*) AS n FROM part"),
    "eq_cross_type": ("MATCH (p:Product) WHERE p.brand = 5 OR p.size < 'a' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE false"),
    "ne_null": ("MATCH (p:Product) WHERE p.missing <> 5 RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE false"),
    "starts_ci": ("MATCH (p:Product) WHERE p.name STARTS WITH 'RED' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE lower(p_name) LIKE 'red%'"),
    "ends_ci": ("MATCH (p:Product) WHERE p.name ENDS WITH 'Ring' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE lower(p_name) LIKE '%ring'"),
    "contains_ci": ("MATCH (p:Product) WHERE p.name CONTAINS 'ED R' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE lower(p_name) LIKE '%ed r%'"),
    "fuzzy": ("MATCH (p:Product) WHERE p.name FUZZY 'rinx' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(lower(p_name), 'ri') OR contains(lower(p_name), 'in') OR contains(lower(p_name), 'nx')"),
    "in_list": ("MATCH (p:Product) WHERE p.size IN [1, 2, 3] RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 2, 3)"),
    "in_empty": ("MATCH (p:Product) WHERE p.size IN [] RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE false"),
    "regex": ("MATCH (p:Product) WHERE p.name =~ '^(red|blue) ' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, '^(red|blue) ')"),
    "regex_ci": ("MATCH (p:Product) WHERE p.name =~ '(?i)RING$' RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, '(?i)RING$')"),
    "bare_truthy": ("MATCH (p:Product) WHERE p.promo RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE p_type = 'PROMO'"),
    "return_node": ("MATCH (b:Category)-[:BroaderCategory]->(r) RETURN b AS node, r.name AS region", "SELECT {'idx': n_nationkey + 7 * 1099511627776, 'kind': 'Category', 'name': n_name} AS node, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "count_prop_nulls": ("MATCH (p:Product) RETURN count(p.missing) AS n", "SELECT count(*) AS n FROM part"),
    "min_max": ("MATCH (p:Product) RETURN p.brand AS b, min(p.price_cents) AS lo, max(p.price_cents) AS hi", f"SELECT p_brand AS b, min({CENTS})::DOUBLE AS lo, max({CENTS})::DOUBLE AS hi FROM part GROUP BY 1"),
    "sum_avg": ("MATCH (p:Product) RETURN p.brand AS b, sum(p.price_cents) AS s, avg(p.size) AS a", f"SELECT p_brand AS b, sum({CENTS})::DOUBLE AS s, avg(p_size) AS a FROM part GROUP BY 1"),
    "agg_non_numeric": ("MATCH (p:Product) RETURN min(p.name) AS lo, count(*) AS n", "SELECT NULL::DOUBLE AS lo, count(*) AS n FROM part"),
    "group_multi_key": ("MATCH (p:Product) RETURN p.brand AS b, count(*) AS n, p.type AS t", "SELECT p_brand AS b, count(*) AS n, p_type AS t FROM part GROUP BY 1, 3"),
    "global_agg_empty": ("MATCH (p:Product) WHERE p.size > 999 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size > 999 HAVING count(*) > 0"),
    "distinct": ("MATCH (p:Product) RETURN DISTINCT p.type AS t", "SELECT DISTINCT p_type AS t FROM part"),
    "distinct_limit": ("MATCH (p:Product) RETURN DISTINCT p.type AS t ORDER BY p.type DESC SKIP 1 LIMIT 3", "SELECT DISTINCT p_type AS t FROM part ORDER BY t DESC LIMIT 3 OFFSET 1"),
    "order_multi": ("MATCH (p:Product) RETURN p.pkey AS k, p.price_cents AS c ORDER BY c DESC, k LIMIT 20", f"SELECT p_partkey AS k, {CENTS} AS c FROM part ORDER BY c DESC, k LIMIT 20"),
    "skip_limit": ("MATCH (p:Product) RETURN p.pkey AS k ORDER BY p.pkey SKIP 10 LIMIT 10", "SELECT p_partkey AS k FROM part ORDER BY 1 LIMIT 10 OFFSET 10"),
    "overlap_topk": (
        "MATCH (p:Product) WHERE p.name CONTAINS 'red' OR p.name CONTAINS 'ring' OR p.size < 4 RETURN p.pkey AS k LIMIT 25",
        "SELECT p_partkey AS k FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%ring%' OR p_size < 4 ORDER BY (lower(p_name) LIKE '%red%')::INT + (lower(p_name) LIKE '%ring%')::INT + (p_size < 4)::INT DESC, p_partkey LIMIT 25",
    ),
    "agg_order_limit": ("MATCH (p:Product)-[:Brand]->(b:Brand) RETURN b.name AS b, count(*) AS n ORDER BY n DESC, b LIMIT 5", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, b LIMIT 5"),
    "anonymous_nodes": ("MATCH ()-[:Brand]->(b:Brand) RETURN b.name AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1"),
    "negative_literals": ("MATCH (p:Product) WHERE p.size > -1 AND p.size IN [-1, 5, 6] AND NOT p.size = -5 RETURN p.pkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size IN (5, 6)"),
    "aggregate_word_variable": ("MATCH (count:Product)-[:Brand]->(max) WHERE count.size >= 4.5 AND count.size < 6 RETURN count.pkey AS k, max.name AS sum", "SELECT p_partkey AS k, p_brand AS sum FROM part WHERE p_size = 5"),
    "quoted_names": ("match (`a part`:Product) where `a part`.name starts with \"red\" Return `a part`.pkey as `part's key`, `a part`.size", "SELECT p_partkey AS \"part's key\", p_size::BIGINT AS \"a part.size\" FROM part WHERE lower(p_name) LIKE 'red%'"),
    "offers_by_flag": ("MATCH (p:Product)-[:Offers]->(o:Offer) WHERE p.brand = 'Brand#1' OR o.quantity > 45 RETURN o.returnflag AS f, count(*) AS n, sum(o.price_cents) AS s", "SELECT l_returnflag AS f, count(*) AS n, sum(cast(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#1' OR l_quantity > 45 GROUP BY 1"),
}
EVENTS: dict[str, tuple[str, str]] = {
    "json_event_props": ("MATCH (e:Review) WHERE e.k < 50 RETURN e.pkey AS id, e.k AS k", "SELECT event_id AS id, cast(props->>'$.k' AS BIGINT) AS k FROM events WHERE cast(props->>'$.k' AS BIGINT) < 50"),
    "is_null": ("MATCH (e:Review) WHERE e.k IS NULL OR e.value IS NULL RETURN e.pkey AS id", "SELECT event_id AS id FROM events WHERE cast(props->>'$.k' AS BIGINT) IS NULL OR value IS NULL"),
    "is_not_null": ("MATCH (e:Review)-[:Author]->(u:Person) WHERE e.k IS NOT NULL RETURN u.pkey AS u, count(e.k) AS n", "SELECT user_id AS u, count(*) AS n FROM events WHERE cast(props->>'$.k' AS BIGINT) IS NOT NULL GROUP BY 1"),
    "null_on_predicate": ("MATCH (e:Review) WHERE (e.k = 1) IS NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM events"),
    "order_nulls": ("MATCH (e:Review) RETURN e.pkey AS id, e.k AS k ORDER BY e.k DESC, e.pkey LIMIT 40", "SELECT event_id AS id, cast(props->>'$.k' AS BIGINT) AS k FROM events ORDER BY k DESC NULLS FIRST, id LIMIT 40"),
}


def _star(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(star_graph(spark, sf_dir), text)


def _events(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(event_graph(spark, sf_dir), text)


QUERIES = {**{k: _star(q) for k, (q, _) in STAR.items()}, **{k: _events(q) for k, (q, _) in EVENTS.items()}}
SQL = {k: sql for k, (_, sql) in {**STAR, **EVENTS}.items()}


# pages and statements of our own

#: Rows of a narrow table that one task makes pages of and reads them.
PAGES_A_TASK = 10_000


def _built(spark: SparkSession, *pages: str) -> Graph:
    return build(settle(statements(pages_from_list(spark, [fixtures.PAGES[p] for p in pages])), "log"))


def _extracted(*pages: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(_built(spark, *pages), text)


def _stated(text: str, dedup_edges: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(build(statement_log(spark, fixtures.UPSERTS), dedup_edges=dedup_edges), text)


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = build(statement_log(spark, fixtures.UPSERTS))
    more = statement_log(spark, [("node", "Product", "p3", "Scarf", '{"price": "5"}'), ("edge", "p3", "Brand", "Acme"), ("node", "Product", "p1", "Shirt II", "{}")])
    return run_query(merge(first, more, spark.createDataFrame([("https://s.test/hat",)], "url string")), "MATCH (p:Product)-[:Brand]->(b) RETURN p.name AS p, b.kind AS k, count(*) AS n")


def _page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("page_seq"), "html")
    return page_sources(pages).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each part, made natively: linked data whose type is a list, microdata, or data that do not parse, in turn."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_retailprice"), PAGES_A_TASK, "parts")
    key, cents = F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("long")
    price = F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), cents % 100)
    page, odd = F.concat(F.lit("https://shop.test/p/"), key), key % 2 == 1
    offer = F.struct(price.alias("price"), F.when(odd, F.concat(F.lit("https://shop.test/offer/"), key)).alias("url"))
    data = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.concat(F.lit("P"), key).alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), offer.alias("offers")))
    linked = F.concat(F.lit("<link rel='canonical' href='"), page, F.lit("'><script type=\"application/ld+json\">"), data, F.lit("</script>"))
    cart = F.when(odd, F.concat(F.lit("<b data-product-id='"), key, F.lit("'></b>"))).otherwise(F.concat(F.lit("<b data-addtocart='{\"id\": "), key, F.lit("}'></b>")))
    micro = F.concat(F.lit("<meta property='og:url' content='"), page, F.lit("'>"), cart, F.lit("<div itemscope itemtype='https://schema.org/Product'><h1 itemprop='name'>"), F.col("p_name"), F.lit("</h1><meta itemprop='price' content='"), price, F.lit("'></div>"))
    broken = F.concat(F.lit("<script type=\"application/ld+json\">{\"@type\": \"Product\", "), key, F.lit("</script>"))
    return part.select(key.alias("page_seq"), F.when(key % 3 == 0, linked).when(key % 3 == 1, micro).otherwise(broken).alias("html"))


def _part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(statements(_part_pages(spark, sf_dir)), "part-log")


def _part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query(build(_part_log(spark, sf_dir)), "MATCH (p:Product) RETURN p.name AS name, p.price_cents AS cents, p.url AS url, p.product_id AS pid")


def _part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sources(_part_pages(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _stored_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, save, load with validation, query."""
    path = new_folder(spark, "stored")
    store.save(build(_part_log(spark, sf_dir)), path)
    return run_query(store.load(spark, path, validate=True), "MATCH (p:Product)-[:Brand]->(b:Brand) RETURN b.name AS brand, count(*) AS n, sum(p.price_cents) AS s")


def _removed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes removed by id go with their edges; the offers and brands stay."""
    gone = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 20").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"))
    graph = build(_part_log(spark, sf_dir), removed_ids=gone)
    left = run_query(graph, "MATCH (x) RETURN x.kind AS what, count(*) AS n")
    return left.unionByName(run_query(graph, "MATCH (p)-[:Offers]->(o:Offer) RETURN p.kind AS what, count(*) AS n").withColumn("what", F.lit("Offers")))


PRODUCT = "MATCH (p:Product) RETURN p.name AS name, p.price AS price, p.price_cents AS cents, p.currency AS cur, p.price_score AS score"
QUERIES |= {
    "upsert_merge": _stated("MATCH (p:Product) RETURN p.name AS name, p.price AS price, p.note AS note, p.sku AS sku, p.color AS color"),
    "id_collision": _stated("MATCH (o:Organization) RETURN o.name AS name, o.since AS since"),
    "dup_edges": _stated("MATCH (p:Product)-[:Brand]->(b) RETURN p.name AS name, count(b) AS n"),
    "dedup_edges": _stated("MATCH (p:Product)-[:Brand]->(b) RETURN p.name AS name, count(b) AS n", dedup_edges=True),
    "coercion": _stated("MATCH (p:Product) WHERE p.n = 456 AND p.e = '1e5' AND p.z = 0.5 AND p.big >= 2 AND p.ok AND NOT p.n = '456' RETURN p.n AS n, p.e AS e, p.z AS z, p.big AS big, p.ok AS ok"),
    "incremental_merge": _incremental,
    "extract_jsonld": _extracted("jsonld", "graph", text=PRODUCT),
    "extract_jsonld_kinds": _extracted("jsonld", "graph", text="MATCH (x) RETURN x.kind AS k, count(*) AS n"),
    "extract_reviews": _extracted("jsonld", text="MATCH (p:Product)-[:Review]->(r:Review)-[:Author]->(a:Person) RETURN r.name AS body, r.date AS d, a.name AS author"),
    "extract_hoists": _extracted("jsonld", text="MATCH (p:Product)-[:AggregateRating]->(r) RETURN p.availability AS a, p.seller_name AS s, p.rating_value AS r, r.review_count AS c, p.sku AS sku"),
    "gallery": _extracted("jsonld", text="MATCH (p:Product) RETURN p.image AS image, p.images AS images"),
    "product_group": _extracted("group", text="MATCH (p:Product) RETURN p.name AS name, p.product_group_id AS g, p.price AS price"),
    "itemlist": _extracted("itemlist", text="MATCH (p:Product) RETURN p.name AS name, p.price AS price"),
    "signal_gate": _extracted("faq", "itemlist", text="MATCH (p:Product) WHERE p.name CONTAINS 'return' RETURN p.name AS name"),
    "extract_platform": _extracted("platform", text="MATCH (p:Product)-[:HasVariant]->(v:Variant) RETURN p.name AS p, p.price AS price, p.price_score AS score, p.url AS url, p.image AS image, v.name AS v, v.price AS vprice"),
    "extract_attribute": _extracted("attribute", text="MATCH (p:Product)-[:HasVariant]->(v) RETURN p.name AS p, v.price AS price, v.price_score AS score"),
    "extract_next": _extracted("next", text=PRODUCT.replace("p.currency", "p.missing")),
    "extract_hypernova": _extracted("hypernova", text="MATCH (p:Product) RETURN p.name AS name, p.price AS price, p.url AS url, p.image AS image"),
    "extract_microdata": _extracted("microdata", text="MATCH (p:Product) RETURN p.name AS name, p.price AS price, p.currency AS cur, p.url AS url, p.image AS image, p.description AS d"),
    "pages_source_counts": _page_sources,
    "part_pages_products": _part_products,
    "part_pages_sources": _part_sources,
    "stored_graph": _stored_brands,
    "removed_ids": _removed_parts,
}
SQL |= {
    "upsert_merge": "SELECT * FROM (VALUES ('Shirt', '12', 'new', '0123', 'red'), ('Hat', NULL, NULL, NULL, NULL)) t(name, price, note, sku, color)",
    "id_collision": "SELECT 'Acme' AS name, 1990::BIGINT AS since",
    "dup_edges": "SELECT * FROM (VALUES ('Shirt', 2::BIGINT), ('Hat', 1)) t(name, n)",
    "dedup_edges": "SELECT * FROM (VALUES ('Shirt', 1::BIGINT), ('Hat', 1)) t(name, n)",
    "coercion": "SELECT 456::BIGINT AS n, '1e5' AS e, 0.5::DOUBLE AS z, 2::DOUBLE AS big, true AS ok",
    "incremental_merge": "SELECT * FROM (VALUES ('Shirt II', 'Organization', 2::BIGINT), ('Scarf', 'Organization', 1)) t(p, k, n)",
    "extract_jsonld": "SELECT * FROM (VALUES ('Desk Lamp', '49.50', 4950::BIGINT, 'EUR', 0::BIGINT), ('Chair', '120', 12000, 'EUR', 0)) t(name, price, cents, cur, score)",
    "extract_jsonld_kinds": "SELECT * FROM (VALUES ('Product', 2::BIGINT), ('Brand', 1), ('Organization', 1), ('Offer', 3), ('AggregateRating', 1), ('Review', 2), ('Person', 2)) t(k, n)",
    "extract_reviews": "SELECT * FROM (VALUES ('Bright', '2024-01-02', 'Ana'), ('Fine', NULL, 'Bo')) t(body, d, author)",
    "extract_hoists": "SELECT 'InStock' AS a, 'Shop A' AS s, 4.5::DOUBLE AS r, 12::BIGINT AS c, '0123' AS sku",
    "gallery": "SELECT 'https://cdn.test/a.jpg' AS image, ['https://cdn.test/a.jpg', 'https://cdn.test/b.jpg'] AS images",
    "product_group": "SELECT * FROM (VALUES ('Mug red', 'G7', '9'), ('Mug blue', 'G7', '9')) t(name, g, price)",
    "itemlist": "SELECT * FROM (VALUES ('One', '1'), ('Two', '2')) t(name, price)",
    "signal_gate": "SELECT '' AS name WHERE false",
    "extract_platform": "SELECT 'Tee' AS p, '645' AS price, 3::BIGINT AS score, 'https://t.test/products/tee' AS url, 'https://cdn.test/t.jpg' AS image, v, vp AS vprice FROM (VALUES ('S', '645'), ('M', '66000')) t(v, vp)",
    "extract_attribute": "SELECT 'Bag' AS p, '56' AS price, 2::BIGINT AS score",
    "extract_next": "SELECT * FROM (VALUES ('Pan', '30', 3000::BIGINT, NULL::VARCHAR, 0::BIGINT), ('Pot', '45', 4500, NULL, 0)) t(name, price, cents, cur, score)",
    "extract_hypernova": "SELECT 'Serum' AS name, '590' AS price, 'https://l.test/one' AS url, 'https://l.test/img/1.jpg' AS image",
    "extract_microdata": "SELECT 'Towel' AS name, '15' AS price, 'USD' AS cur, 'https://m.test/p/1' AS url, 'https://m.test/t.png' AS image, 'Soft towel' AS d",
    "pages_source_counts": "SELECT 'empty' AS source, count(*) AS n FROM pages",
    "part_pages_products": f"""
        SELECT p_name AS name, {CENTS} AS cents, 'https://shop.test/' || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'offer/' ELSE 'p/' END || p_partkey AS url,
               CASE WHEN p_partkey % 3 = 1 THEN p_partkey END AS pid
        FROM part WHERE p_partkey % 3 < 2""",
    "part_pages_sources": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'microdata' ELSE 'empty' END AS source, count(*) AS n FROM part GROUP BY 1",
    "stored_graph": f"SELECT p_brand AS brand, count(*) AS n, sum({CENTS})::DOUBLE AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY 1",
    "removed_ids": """
        SELECT 'Product' AS what, count(*) AS n FROM part WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_size >= 20)
        UNION ALL SELECT 'Offer', count(*) FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'Brand', count(DISTINCT p_brand) FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'Offers', count(*) FROM part WHERE p_partkey % 3 = 0 AND p_size >= 20""",
}
