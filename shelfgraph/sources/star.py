"""A graph view of the star-schema tables: only projections and unions, so labels and properties prune the scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.graph import Graph

#: Each kind's ids are row keys in a band of their own, so an id needs no numbering job.
BAND = 1 << 40
#: Each of the two keys that make a pair's number is below this.
_HALF = 1 << 31
_BANDS = ("part", "brand", "type", "supplier", "orders", "customer", "pair", "nation", "region", "event", "user")
#: The kinds of each relation's source and destination.
_ENDS = {"Brand": ("Product", "Brand"), "Category": ("Product", "Category"), "BroaderCategory": ("Category", "Category"), "Manufacturer": ("Product", "Organization"), "HasVariant": ("Product", "Variant"), "Offers": ("Product", "Offer"), "Review": ("Product", "Review"), "Author": ("Review", "Person")}
_PROPS = {"brand": "string", "type": "string", "size": "bigint", "price_cents": "bigint", "acctbal_cents": "bigint", "quantity": "double", "returnflag": "string", "status": "string", "total_cents": "bigint", "segment": "string", "promo": "boolean", "k": "bigint", "value": "double", "pkey": "bigint"}


def _idx(band: str, key: Column) -> Column:
    return (F.lit(_BANDS.index(band) * BAND) + key.cast("long")).cast("long")


def _hashed(band: str, text: Column) -> Column:
    """A stable key of a text: its hash, cut to the band's width."""
    return _idx(band, F.pmod(F.xxhash64(text), F.lit(BAND)))


def _paired(a: Column, b: Column) -> Column:
    """An exact number of two keys, null or from 0 to 2^31 - 2, above all bands; other keys are an error, since two pairs would get one number."""
    half = lambda c: F.coalesce(F.when(c.between(0, _HALF - 2), c.cast("long") + 1).when(c.isNotNull(), F.raise_error(F.concat(F.lit("key out of range: "), c.cast("string"))).cast("long")), F.lit(0).cast("long"))
    return F.lit(1 << 62) + half(a) * F.lit(_HALF) + half(b)


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _nodes(df: DataFrame, kind: str, idx: Column, name: Column, **props: Column) -> tuple[str, DataFrame]:
    columns = [props[p].cast(t).alias(f"p_{p}") if p in props else F.lit(None).cast(t).alias(f"p_{p}") for p, t in _PROPS.items()]
    return kind, df.select(idx.alias("idx"), F.lit(kind).alias("kind"), F.coalesce(name, F.lit("")).alias("name"), *columns)


def _edges(df: DataFrame, rel: str, src: Column, dst: Column, seq: Column) -> tuple[str, DataFrame]:
    return rel, df.select(seq.cast("long").alias("eseq"), src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))


def _graph(nodes: list[tuple[str, DataFrame]], edges: list[tuple[str, DataFrame]]) -> Graph:
    def grouped(frames: list[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
        names = dict.fromkeys(n for n, _ in frames)
        return {n: reduce(DataFrame.unionByName, [f for m, f in frames if m == n]) for n in names}

    union = lambda frames: reduce(DataFrame.unionByName, [f for _, f in frames])
    return Graph(union(nodes), union(edges), {p: f"p_{p}" for p in _PROPS}, by_kind=grouped(nodes), by_rel=grouped(edges), ends={r: _ENDS[r] for r, _ in edges})


#: The tables' columns, so that no job reads them from the files.
_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts are products, brands and types are brands and categories, line items are offers, orders are reviews and customers their authors."""
    part, supplier, orders, customer, lineitem, nation, region = (_table(spark, sf_dir, t) for t in ("part", "supplier", "orders", "customer", "lineitem", "nation", "region"))
    c = F.col
    # line items have no key of their own: a hash of what tells them apart, below all other bands
    line = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").bitwiseOR(F.lit(-(1 << 63)))
    pair = _paired(c("l_partkey"), c("l_suppkey"))
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    n_offset = 1 << 20  # regions and nations are categories in one band
    nodes = [
        _nodes(part, "Product", _idx("part", c("p_partkey")), c("p_name"), brand=c("p_brand"), type=c("p_type"), size=c("p_size"), price_cents=_cents("p_retailprice"), promo=c("p_type") == "PROMO", pkey=c("p_partkey")),
        _nodes(part.select("p_brand").distinct(), "Brand", _hashed("brand", c("p_brand")), c("p_brand")),
        _nodes(part.select("p_type").distinct(), "Category", _hashed("type", c("p_type")), c("p_type")),
        _nodes(nation, "Category", _idx("nation", c("n_nationkey")), c("n_name")),
        _nodes(region, "Category", _idx("region", c("r_regionkey") + n_offset), c("r_name")),
        _nodes(supplier, "Organization", _idx("supplier", c("s_suppkey")), c("s_name"), acctbal_cents=_cents("s_acctbal")),
        _nodes(lineitem, "Offer", line, F.lit(""), quantity=c("l_quantity"), price_cents=_cents("l_extendedprice"), returnflag=c("l_returnflag")),
        _nodes(orders, "Review", _idx("orders", c("o_orderkey")), c("o_orderpriority"), status=c("o_orderstatus"), total_cents=_cents("o_totalprice")),
        _nodes(customer, "Person", _idx("customer", c("c_custkey")), c("c_name"), segment=c("c_mktsegment")),
        _nodes(pairs, "Variant", pair, F.lit("")),
    ]
    p_idx = _idx("part", c("l_partkey"))
    edges = [
        _edges(part, "Brand", _idx("part", c("p_partkey")), _hashed("brand", c("p_brand")), c("p_partkey")),
        _edges(part, "Category", _idx("part", c("p_partkey")), _hashed("type", c("p_type")), c("p_partkey")),
        _edges(nation, "BroaderCategory", _idx("nation", c("n_nationkey")), _idx("region", c("n_regionkey") + n_offset), c("n_nationkey")),
        _edges(pairs, "Manufacturer", p_idx, _idx("supplier", c("l_suppkey")), c("l_suppkey")),
        _edges(pairs, "HasVariant", p_idx, pair, c("l_suppkey")),
        _edges(lineitem, "Offers", p_idx, line, c("l_orderkey") * 8 + c("l_linenumber")),
        _edges(lineitem, "Review", p_idx, _idx("orders", c("l_orderkey")), c("l_orderkey") * 8 + c("l_linenumber")),
        _edges(orders, "Author", _idx("orders", c("o_orderkey")), _idx("customer", c("o_custkey")), c("o_orderkey")),
    ]
    return _graph(nodes, edges)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Events are reviews by their users; the event's JSON gives the property k."""
    events = _table(spark, sf_dir, "events")
    c = F.col
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    nodes = [
        _nodes(events, "Review", _idx("event", c("event_id")), c("event_type"), k=k, value=c("value"), pkey=c("event_id")),
        _nodes(events.select("user_id").distinct(), "Person", _idx("user", c("user_id")), c("user_id").cast("string"), pkey=c("user_id")),
    ]
    return _graph(nodes, [_edges(events, "Author", _idx("event", c("event_id")), _idx("user", c("user_id")), c("event_id"))])
