"""The operators that use DataFrame functions only, against brute force."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfgraph.llm import common, decontaminate
from shelfgraph.llm.components import components
from shelfgraph.llm.decontaminate import drop_contaminated, find_contamination
from shelfgraph.llm.licences import KNOWN, known_digests, scan_licences
from shelfgraph.llm.lsm_dedup import DigestIndex, dedup_exact, drop_copies
from shelfgraph.llm.shards import assign_shards
from shelfgraph.llm.url_rules import judge_urls

#: Nulls, empty texts, repeated rows, ties, a long text, and columns whose names clash with the operators' own.
ROWS = [(1, "a b c", 0, "x"), (2, "a b c", 1, "y"), (3, None, 2, None), (4, "", 3, "z"), (5, "é" * 50_000, 4, "w"), (5, "é" * 50_000, 4, "w"), (None, "a b c", 5, "v"), (6, "only", None, "u"), (7, "A b c", 6, "t")]
SCHEMA = "doc_id long, text string, digest long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, keep, weak):
    digest = {"digest": lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 0))} if weak else {}  # the weak digest is the same for all
    got = dedup_exact(docs, keep, **digest).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    assert len(got) == len(ROWS)
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        rows = [r for r in got if r["text_sha256"] == sha]
        best = (min if keep == "smallest" else max)(i for i in ids if i is not None)
        assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]


def test_index_of_several_runs(spark, docs):
    index = DigestIndex(spark)
    index.flush(docs.where("doc_id < 3"))
    index.flush(docs.where("doc_id >= 3 OR doc_id IS NULL"))
    assert len(index.runs) > 2 and all(r.tier == 0 for r in index.runs)
    level = index.compact()
    assert level.where("n > 1").count() == 3 and len(index.runs) == 1 and index.runs[0].tier > 1 and index.runs[0].selective
    # a later flush meets the level that is there
    index.flush(spark.createDataFrame([(0, "only"), (12, "new")], "doc_id long, text string"))
    assert {(r["n"], r["keep"]) for r in index.compact().select("n", index.keep_id().alias("keep")).collect()} == {(1, 7), (1, 12), (2, 0), (2, 3), (2, 5), (3, 1)}
    found = index.lookup(spark.createDataFrame([(9, "A b c", 1), (10, "newer", 2), (11, None, 3)], "doc_id long, text string, digest long"))
    assert {r["doc_id"]: r["keep_id"] for r in found.collect()} == {9: 7, 10: None, 11: 3} and found.columns == ["doc_id", "text", "digest", "keep_id"]


def test_index_whose_filters_are_full(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    for most in (1 << 15, 1):
        index = DigestIndex(spark, most_bits=max(most, 32768))
        if most == 1:
            index.flush(docs)
            for r in index.runs:
                r.bits = 0  # no longer selective: every entry must meet
        else:
            index.flush(docs)
        got = {(r["n"], r["keep"]) for r in index.compact().select("n", index.keep_id().alias("keep")).collect()}
        assert got == {(2 if i < 300 else 1, i) for i in range(700)}


def test_drop_copies(spark, docs):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "6", "7"]
    assert drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0 and dedup_exact(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a", "p", 1, "q"), (2, "a", "p", 2, "q"), (1, "a", "p", 1, "q")], "doc_id long, text string, _key string, bucket long, bitmap string")
    assert [tuple(r) for r in drop_copies(odd).collect()] == [(1, "a", "p", 1, "q")]


def test_drop_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)] + [(3, "text 3"), (None, "text 3"), (200, "single")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_copies(docs).collect()) == [*range(40), 200]


def test_urls(spark):
    rules = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de", "block"), ("a.b", "", "block"), (None, "/", "block")]
    urls = [None, "", "no scheme", "http://X.net/", "http://net", "https://www.EXAMPLE.net/en/1?q#f", "http://example.net/fr/", "http://example.com/deep?x", "http://badexample.com/de", "x://u:p@a.b:80/", "y://c.a.b", "y://a.b", "http://example.net/en/1?a://b"]
    rows = [(i % 11, u, "rule") for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        hits = [(len(h + p), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return (host, path, *(max(hits)[1:] if hits else (None, "allow")))

    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *judge(u))) for i, u, _ in rows)
    assert judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow'").count() == len(rows)


def test_shards(spark):
    rows = [(i, "w" * (i % 97) + str(i), 1) for i in range(3000)] + [(5000 + i, "same text " * 9, 2) for i in range(1500)] + [(9000, None, 0), (9001, "", 0), (None, "x", 0), (9002, "long " * 2000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long")
    got = assign_shards(docs, 4).collect()
    assert len(got) == len(rows)
    load, slots = defaultdict(int), defaultdict(list)
    text = {i: (t or "").encode() for i, t, _ in rows}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == {0, 1, 2, 3} and max(load.values()) < 1.1 * min(load.values())
    assert assign_shards(docs.limit(0), 4).count() == 0
    # a group below a shard's share stays together
    small = assign_shards(spark.createDataFrame([(i, f"text {i % 500} " * 3) for i in range(3000)], "doc_id long, text string"), 4)
    assert small.groupBy("text_crc32").agg(F.count_distinct("shard").alias("k")).where("k > 1").count() == 0


def test_decontamination(spark):
    item = "A train leaves Springfield at 45 km and reaches Shelbyville after 3 hours with 45 passengers on board today"
    bench = spark.createDataFrame([(1, item, 0), (2, "two words", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, pos long")
    rows = [
        (10, f"Intro text. {item} and more."),
        (11, f"intro {item.replace('45', '60').replace('3', '7').replace('Springfield', 'Ogdenville')} outro"),  # asked again with other values
        (12, item.replace("45 passengers", "50 passengers")),  # one value stands for two
        (13, "A train leaves town and nothing else is like the item at all in this text"),
        (14, None),
        (15, ""),
        (16, "Two words"),
        (16, "Two words"),
        (None, item),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h long")
    got = {(r["doc_id"], r["item_id"]): (r["slots"], r["changed"]) for r in find_contamination(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (16, 2), (None, 1)}
    assert got[10, 1][1] == 0 and got[11, 1][1] > 0
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [12, 13, 14, 15]
    assert find_contamination(docs, bench.limit(0)).count() == 0 and find_contamination(docs.limit(0), bench).count() == 0

def test_decontamination_names(spark):
    asked = "Alice has 3 apples. Bob gives Alice 2 apples. How many apples does Alice have?"
    plain = "The clerk Mary Jones walked with Peter Smith through the old market while Susan Clark and Henry Ford bought bread for the evening meal"
    bench = spark.createDataFrame([(1, asked), (2, plain)], "item_id long, text string")
    rows = [
        (1, "Carol has 7 apples. Dan gives Carol 4 apples. How many apples does Carol have?"),
        (2, "Quiz:\n\n" + asked.replace("Alice", "Erin").replace("Bob", "Frank").replace(" ", "\n")),
        (3, plain.lower()),
        (4, "so " + plain.upper()),
        (5, plain.replace(" ", " \n ")),
        (6, "Carol has 7 apples. Dan gives Erin 4 apples. How many apples does Frank have?"),  # one name stands for three
        (7, "THE OLD MARKET OF THE TOWN WAS CLOSED IN THE EVENING AND NOBODY CAME TO BUY ANY BREAD OR MEAL AT ALL"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)}


def test_decontamination_parts(spark):
    word = lambda i: "".join(chr(97 + (i * k + k) % 26) for k in (3, 5, 7, 11)) + chr(97 + i % 26) + chr(97 + i // 26)
    short, middle, small, long = "What is the capital of France?", [word(i) for i in range(15)], [word(i) for i in range(100, 109)], [word(i) for i in range(200, 300)]
    bench = spark.createDataFrame([(1, short), (2, " ".join(middle)), (3, " ".join(small)), (4, " ".join(long))], "item_id long, text string")
    changed = lambda w, i: " ".join([*w[:i], "other", *w[i + 1 :]])
    rows = [
        (1, f"We met again in the evening and somebody asked us: {short} Nobody knew it."),
        (2, "before " + changed(middle, 7) + " after"),
        (3, "before " + changed(small, 4) + " after"),
        (4, "before " + " ".join(long[30:60]) + " after"),
        (5, " between many other words ".join(" ".join(middle[i : i + 4]) for i in range(0, 15, 4))),
        (6, "before " + " ".join(long[30:45]) + " after"),
        (7, "What is the colour of France in the evening when somebody asks us"),
        (8, " ".join([*middle[:7], "inserted", "words", *middle[7:]])),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (8, 2)}


def test_decontamination_diagonals(spark):
    item = "A train leaves Springfield at 45 km and reaches Shelbyville after 3 hours with 45 passengers on board today"
    long = f"{item} while the other train waits behind the old bridge until somebody finds the lost key of the red signal house beside the river where nobody has been at work since the great flood of that year"
    broken = item.replace("45 passengers", "50 passengers")
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    rows = [(1, f"{broken}. {item}"), (2, long.replace("45 passengers", "50 passengers")), (3, f"{broken}. {broken.replace('50', '52')}")]
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert (1, 1) in got and got[1, 1] == 0 and (2, 2) in got and not any(d == 3 for d, _ in got)


def test_licences(spark):
    mit = next(t for n, t in KNOWN if n == "MIT")
    rows = [(1, "Copyright (c) 2020 Me\n\n" + mit.upper().replace(" ", "  ")), (2, "Some prose.\nLicenced under the Apache Licence, version 2.0\nMore."), (3, "Released under the MIT License. And more"), (4, None), (5, ""), (2, "Some prose.\nLicenced under the Apache Licence, version 2.0\nMore.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licence string")
    got = sorted((r["doc_id"], r["licence"], r["notices"]) for r in scan_licences(docs, known_digests(spark)).collect() if r["doc_id"] != 1)
    assert got == [(2, None, "Apache-2.0")] * 2 + [(3, None, ""), (4, None, ""), (5, None, "")]
    assert scan_licences(docs.where("doc_id = 1"), known_digests(spark)).first()["licence"] == "MIT"


def test_licences_after_a_holder(spark):
    mit = next(t for n, t in KNOWN if n == "MIT")
    rows = [
        (1, "Copyright 2020 Foo. Released under the MIT License.", "MIT", "MIT"),
        (2, "prose\n(c) 2021 X. Licensed under CC BY 4.0.", None, "CC-BY-4.0"),
        (3, "Copyright (c) 2020 J. Smith, Foo Inc. All rights reserved.\n\n" + mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS"), "MIT", ""),
        (4, "Copyright Foo Ltd.\n# Copyright: Bar\nAll rights reserved.\n" + mit, "MIT", ""),
        (5, "Copyright 2020 Foo Inc. and others", None, ""),
    ]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in scan_licences(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), known_digests(spark)).collect()}
    assert got == {r[0]: r[2:] for r in rows}


def test_components(spark):
    edges = [("a", "b"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a"), ("a", "b")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**dict.fromkeys("abc", "a"), "x": "x", "y": "x", "z": "z", **{f"n{i:03}": "n000" for i in range(61)}}


def test_licences_as_published(spark):
    """Typographic quotes, no-break spaces, other blanks and other case do not matter; full texts are found where this machine has them."""
    mit = next(t for i, t in KNOWN if i == "MIT" and len(t) > 500)
    quoted = mit.replace('"Software"', "“Software”").replace('"AS IS"', "‘AS IS’")
    rows = [(1, quoted, "MIT"), (2, mit.replace(" ", " "), "MIT"), (3, mit.upper() + "\n\n", "MIT"), (4, mit + " But not on Sundays.", None), (5, "", None), (6, None, None)]
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    for file, licence in files.items():
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            rows += [(len(rows) + 1, path.read_text().replace("  ", " \t"), licence), (len(rows) + 2, path.read_text() + " and more", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in scan_licences(docs, known_digests(spark)).collect()} == {i: want for i, _, want in rows}
    assert scan_licences(docs.limit(0), known_digests(spark)).isEmpty()


def test_shards_with_a_heavy_key(spark):
    """A text that many rows share, below a shard's share: the slots stay gapless and rows that repeat are all there."""
    docs = spark.createDataFrame([(i % 3900, "same" if i % 8 == 0 else f"text {i} " * 4) for i in range(4000)], "doc_id long, text string")
    got = assign_shards(docs, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 4000 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://A.example.net/en/" + "x" * 100_000, "r"), (1, "http://A.example.net/en/" + "x" * 100_000, "r"), (None, None, None), (2, "", "s")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, verdict string")
    got = judge_urls(pages, rules)
    assert sorted((str(r["page_id"]), str(r["rule"]), r["verdict"]) for r in got.collect()) == [("1", "example.net/en/", "allow")] * 2 + [("2", "None", "allow"), ("None", "None", "allow")]
    assert judge_urls(pages.limit(0), rules).isEmpty()
    assert dedup_exact(pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")).limit(0), "largest").isEmpty()


def test_licence_lines_read_as_alone(spark):
    lines = ["(c) 2019 A", "Copyright 2020 B", "copyright", "Copyright\r", "holders", "Released under the\tMIT Licence.", " Licensed under CC BY 4.0. ", "# (c) C. Released under CC0 1.0.", "copyright notice", "", "licensed under CC BY-NC 4.0. copyright", "Licensed under the", "MIT License."]
    known = known_digests(spark)
    alone = scan_licences(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), known).where("licence IS NOT NULL")
    whole = scan_licences(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(reversed(lines)))], "doc_id long, text string"), known)
    want = ",".join(sorted({r["licence"] for r in alone.collect()}))
    assert {"CC-BY-4.0", "CC0-1.0", "MIT"} <= set(want.split(","))
    assert [r["notices"] for r in whole.collect()] == [want, want]


def test_intermediates_of_a_small_benchmark_are_few_files(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(str, find_contamination(docs, items).collect()))
    files = {}

    def settled(df, name, **options):
        out = common.settle(df, name, **options)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(decontaminate, "settle", settled)
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(str, find_contamination(docs, items).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert want and got == want
    assert files["items"] == 1 and files["item-windows"] == 1 and "hits" not in files
