"""Labels, relation types and table layouts of a product graph."""

from __future__ import annotations

from pyspark.sql import types as T

#: Node kinds and relation types, in natural order.
KINDS = ("Product", "Offer", "Brand", "Organization", "Review", "AggregateRating", "Category", "Person", "Variant")
RELS = ("Offers", "Brand", "Manufacturer", "Review", "AggregateRating", "IsVariantOf", "Category", "Author", "HasVariant", "BroaderCategory")
#: Of the stored form; another version is refused.
FORMAT_VERSION = 1
#: Tags of a property value.
BOOL, INT, FLOAT, STR, LIST = 1, 2, 3, 4, 5
VALUE = T.StructType(
    [T.StructField("t", T.ByteType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("l", T.ArrayType(T.StringType()))]
)
NODES = T.StructType(
    [T.StructField("idx", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("props_json", T.StringType()), T.StructField("props", T.MapType(T.StringType(), VALUE))]
)
EDGES = T.StructType([T.StructField("eseq", T.LongType()), T.StructField("src", T.LongType()), T.StructField("rel", T.StringType()), T.StructField("dst", T.LongType())])
#: The statement log: op is node or edge; edges use src_id, rel and dst_id.
STATEMENTS = "seq long, op string, kind string, id string, name string, props_json string, src_id string, rel string, dst_id string"


class GraphError(ValueError):
    """A query or a graph that cannot be used."""
