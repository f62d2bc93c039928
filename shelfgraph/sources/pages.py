"""Pages to statements: the only step that runs Python on the executors."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.sources.extract import MARKERS, extract_page, linked_objects, microdata_products, node_statement, parse_html, read_json, to_json

ENTRIES = "array<struct<k: string, v: string>>"
STATEMENTS = f"seq long, op string, kind string, id string, name string, entries {ENTRIES}, props_json string, src_id string, rel string, dst_id string"
_ARROW = pa.schema([("seq", pa.int64()), *((c, pa.string()) for c in ("op", "kind", "id", "name")), ("entries", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), *((c, pa.string()) for c in ("props_json", "src_id", "rel", "dst_id"))])
#: Statements that a page can make: the place of a page is shifted by so many bits.
PAGE_BITS = 24


def pages_from_list(spark: SparkSession, pages: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(pages)), "page_seq long, html string")


def pages_from_dir(spark: SparkSession, path: str) -> DataFrame:
    """``*.html`` and ``*.htm`` of one folder, in the order of their paths; bytes that are not UTF-8 are replaced, unreadable files left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm}").option("ignoreCorruptFiles", "true").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())
    place = spark.createDataFrame(list(enumerate(names)), "page_seq long, place string")
    text = files.join(F.broadcast(place) if len(names) < 100_000 else place, files["path"] == place["place"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(x.as_py() or b"").decode("utf-8", "replace") for x in b.column(1)], pa.string())], names=["page_seq", "html"])

    return text.select("page_seq", "content").mapInArrow(decode, "page_seq long, html string")


def has_marker(html: Any = "html") -> Any:
    """Whether a page can hold anything, natively; the others never reach Python."""
    c = F.lower(F.col(html))
    return reduce(lambda a, b: a | b, [c.contains(m.lower()) for m in MARKERS])


def _safe(html: str | None, where: str) -> tuple[str, list[dict[str, Any]]]:
    """A page that breaks the extractor is an empty page."""
    try:
        return extract_page(html or "")
    except Exception as e:
        print(f"page {where}: {type(e).__name__}: {e}", file=sys.stderr)
        return "error", []


def statements(pages: DataFrame) -> DataFrame:
    """The statement log of ``pages(page_seq, html)``; null pages and pages without markers make none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for seq, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, r in enumerate(_safe(html, str(seq))[1]):
                    entries = r.get("entries")
                    rows.append({c: r.get(c) for c in _ARROW.names} | {"seq": (seq << PAGE_BITS) + i, "entries": None if entries is None else [{"k": k, "v": v} for k, v in entries]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return pages.where(F.col("html").isNotNull() & has_marker()).select("page_seq", "html").mapInArrow(run, STATEMENTS)


def page_sources(pages: DataFrame) -> DataFrame:
    """(page_seq, source) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_safe(h, str(s))[0] for s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["page_seq", "source"])

    marked = F.coalesce(has_marker(), F.lit(False))
    read = pages.where(marked).select(F.col("page_seq").cast("long"), "html").mapInArrow(run, "page_seq long, source string")
    return read.unionByName(pages.where(~marked).select(F.col("page_seq").cast("long"), F.lit("empty").alias("source")))


def jsonld_objects(pages: DataFrame) -> DataFrame:
    """(page_seq, at, object) of every linked-data object of every page, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, i, to_json(o)) for s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, o in enumerate(linked_objects(parse_html(h)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["page_seq", "at", "object"])

    return pages.where(F.col("html").contains("application/ld+json")).select(F.col("page_seq").cast("long"), "html").mapInArrow(run, "page_seq long, at long, object string")


def extract_jsonld(html: str) -> list[dict]:
    return linked_objects(parse_html(html))


def extract_microdata_products(html: str) -> list[dict[str, str | None]]:
    return microdata_products(parse_html(html))


def statement_log(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A log made by hand: ("node", kind, id, name, props as JSON text) and ("edge", src_id, rel, dst_id), in order. Props that are not JSON are kept as a text."""
    out = []
    for seq, row in enumerate(rows):
        if row[0] == "node":
            try:
                props = read_json(row[4])
            except ValueError:
                props = None
            made = node_statement(*row[1:4], props)
            if not isinstance(props, dict):
                made["props_json"] = row[4]
            out.append((seq, "node", *row[1:4], made["entries"], made["props_json"], None, None, None))
        else:
            out.append((seq, "edge", None, None, None, None, None, *row[1:4]))
    return spark.createDataFrame(out, STATEMENTS)
