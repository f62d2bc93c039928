"""The pipeline, stage by stage, on the smallest tables."""

import tracemalloc
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from shelfgraph.llm import bpe, common, toxicity
from shelfgraph.llm.decontaminate import find_contamination
from shelfgraph.llm.shingles import word_keys
from test_free import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    clean = stages["toxicity"](spark, docs, SF).cache()
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, lexicon).where("predicted = 1").collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    single = stages["exact dedup"](spark, clean, SF).cache()
    texts = Counter(r["text"] for r in clean.collect())
    assert single.columns == columns and Counter(r["text"] for r in single.collect()) == Counter(texts.keys())
    far = stages["near dedup"](spark, single, SF).cache()
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in single.collect()], 5, 80) if i == c}
    assert far.columns == columns and {r["doc_id"] for r in far.collect()} == want
    fresh = stages["decontamination"](spark, far, SF).cache()
    leaks = {r["doc_id"] for r in find_contamination(far, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert fresh.columns == columns and {r["doc_id"] for r in fresh.collect()} == want - leaks
    assert stages["bpe"](spark, fresh, SF).count() == fresh.count()


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("a word "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        dict(corpus_pipeline.STAGES)["bpe"](spark, docs, SF)
        got = rows.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) <= 2 * common.ARROW_BYTES
        spark.conf.set(name, "1m")  # a lower bound than ours stays
        common.bound_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_workers_drop_what_others_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    codec = bpe._codec(path)
    assert list(common.tidy(iter, keeps="bpe")([1])) == [1] and bpe._codec(path) is codec
    assert list(common.tidy(iter)([1])) == [1] and not common._KEPT
    table = pa.table({"a": [1]})
    bpe._codec(path)
    assert common.tidy_group(lambda rows: rows)(table) is table and not common._KEPT


def test_words_are_hashed_in_small_memory():
    raw = b"some words of a text " * 50_000
    tracemalloc.start()
    keys, places = word_keys(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == len(places) == 250_000 and len(set(keys.tolist())) == 5 and peak < 20 * len(raw)
