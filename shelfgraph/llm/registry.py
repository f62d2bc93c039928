"""Queries of the training-data operators, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm.bpe import encode_documents
from shelfgraph.llm import language, line_crf, toxicity
from shelfgraph.llm.common import UPPER, bound_batches, remainder
from shelfgraph.llm.decontaminate import find_contamination
from shelfgraph.llm.jaccard_join import jaccard_components
from shelfgraph.llm.licences import COPYRIGHT_LINE, KNOWN, KNOWN_DIGESTS, NO_WORD, SIGNS, SPELLINGS, known_digests, scan_licences
from shelfgraph.llm.lsm_dedup import dedup_exact
from shelfgraph.llm.shards import assign_shards
from shelfgraph.llm.url_rules import judge_urls

#: The rules of the contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, language.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return language.predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"), keep="largest")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 16)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.score_quality(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), known_digests(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _canonical_sql(text: str) -> str:
    s = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), '{COPYRIGHT_LINE}', '\\1', 'g')"
    for a, b in SIGNS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"trim(regexp_replace({s}, '{NO_WORD}', ' ', 'g'))"
    for a, b in SPELLINGS:
        s = f"replace({s}, '{a}', '{b}')"
    return s


def _licence_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
    digests = ", ".join(f"('{licence}', '{digest}')" for licence, digest in KNOWN_DIGESTS)
    return f"""
        WITH forms AS (SELECT licence, sha256({_canonical_sql("t")}) AS digest FROM (VALUES {quoted}) v(licence, t) UNION ALL SELECT * FROM (VALUES {digests}) d(licence, digest)),
        known AS (SELECT digest, min(licence) AS licence FROM forms GROUP BY 1),
        whole AS (SELECT doc_id, text, sha256({_canonical_sql("text")}) AS text_digest FROM documents),
        lines AS (SELECT doc_id, text_digest, unnest(string_split(text, chr(10))) AS line FROM whole WHERE text IS NOT NULL),
        found AS (SELECT doc_id, text_digest, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
                  FROM lines JOIN known ON digest = sha256({_canonical_sql("line")}) GROUP BY ALL)
        SELECT w.doc_id, w.text_digest, k.licence, coalesce(f.notices, '') AS notices
        FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN found f ON f.doc_id IS NOT DISTINCT FROM w.doc_id AND f.text_digest = w.text_digest"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language": op2_language,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_licences": op7_licences,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe": op10_bpe,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op7_licences": _licence_sql(),
    "op4_url_filters": """
        WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        best AS (SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
                 FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""",
}
