"""The other operators: against brute force, a public library, or held-out labels."""

import array
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfgraph.llm import common, components, jaccard_join, language, line_crf, registry, toxicity
from shelfgraph.llm.bpe import MergeAutomaton, WordBpe, encode_documents
from shelfgraph.llm.cache import Memo
from shelfgraph.llm.common import by_bytes, remainder
from shelfgraph.llm.jaccard_join import boundary, drop_near_copies, jaccard_components
from shelfgraph.llm.shingles import shingle_sets, word_keys

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, k, p):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return sorted((r[0], len(sets[i]), min(least[root(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("k, p", [(3, 90), (5, 80), (1, 60)])
def test_jaccard(spark, k, p):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(4000)]
    boiler = rng.sample(words, 40)
    rows = []
    for base in range(25):
        text = rng.sample(words, rng.choice([1, 2, 5, 9, 14, 22, 40, 90, 200]))
        if base % 4 == 0:
            text += boiler
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).upper() if rng.random() < 0.1 else "\t".join(copy))
    rows = list(enumerate([*rows, None, "", "  ", "x", "x", "X"]))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n long").repartition(5)
    assert sorted(map(tuple, jaccard_components(docs, k, p).collect())) == brute(rows, k, p)


def test_near_copies_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, key string")
    assert jaccard_components(docs).count() == 0 and drop_near_copies(docs).columns == docs.columns
    assert drop_near_copies(spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (2, None), (None, "q")], "doc_id long, text string")).count() == 3


def test_near_copies_by_row(spark):
    """Null ids, an id of two texts, rows alike, and long texts: one row of each group stays, and no other row goes with it."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (4, "p q r s t u"), (4, "v w x y z a"), (5, "P q r s t u"), (7, long), (8, long + " end"), (9, "k l m n o p"), (9, "k l m n o p"), (10, None), (10, None), (11, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_key string").repartition(4)
    got = drop_near_copies(docs)
    left = [(r["doc_id"], (r["text"] or "").lower()) for r in got.collect()]
    assert got.columns == docs.columns and sorted(map(str, left)) == sorted(map(str, [(None, "a b c d e f"), (4, "p q r s t u"), (4, "v w x y z a"), (7, long), (9, "k l m n o p"), (10, ""), (10, ""), (11, " ")]))


def test_words_whose_blocks_change_places(spark):
    a, b = "a" * 64, "b" * 64
    words = [a + b + b + a, b + a + a + b, a + b + a + b, b + a + b + a, a + a + b + b, b + b + a + a, (a + b + b + a) * 3]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, 3, 90).collect())) == brute(list(enumerate(words)), 3, 90)
    assert len(set(word_keys(" ".join(words).encode())[0].tolist())) == len(words)


def test_few_files_and_bounded_batches(spark, monkeypatch):
    """op9 on a small table: no intermediate but those of the joins of hot keys has a file for each shuffle partition, and workers get small batches."""
    want = sorted(map(str, registry.op9_jaccard_join(spark, SF).collect()))
    files = defaultdict(list)

    def settled(df, name, *args, **options):
        out = common.settle(df, name, *args, **options)
        files[name].append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "settle", settled)
    monkeypatch.setattr(components, "settle", settled)
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(str, registry.op9_jaccard_join(spark, SF).collect()))
        batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert want and got == want
    few = {"classes", "screened", "index", "lists", "edges", "labels", "named"}
    assert few <= set(files) and all(set(files[name]) == {1} for name in few)
    assert int(batch) <= common.ARROW_BYTES


def test_boundary_follows_cost():
    assert boundary(90, {12: 1000}) >= 12 and boundary(90, {60: 1000}) < 60


def test_shingles_of_long_words():
    one = shingle_sets(["a" * 3_000_000 + " b c", "x " * 600_000], 3)
    assert one.n.tolist() == [1, 1]


def test_bpe_matches_library(spark):
    tokenizer, codec = Tokenizer.from_file(VOCABULARY), WordBpe(VOCABULARY)
    rng = random.Random(1)
    texts = ["", "  ", "Hello WORLD's it'll 123", "a<|endoftext|>b <|startoftext|>", "ΑΣ İ ß é é", "日本語 👍 ½", "a\x85b\x1cc\x00", "aaaaaaaaaaaaaaaaaaaaaaaaaa !!!!!!!!!!!!!!!!!! ", "ab" * 5000]
    texts += ["".join(rng.choice("abcdehilnorst'!?.é’ 0\n<|>") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        raw = codec.encode_bytes(t)
        assert array.array("I", raw).tolist() == want and "".join(codec.decoded(raw)) == tokenizer.decode(want, skip_special_tokens=False) == codec.decode(want)
    docs = spark.createDataFrame([(1, texts[2], 9), (2, None, 9), (None, "", 9), (1, texts[2], 9)], "doc_id long, text string, ids long")
    got = encode_documents(docs, VOCABULARY).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 8, 8] and max(got, key=lambda r: r["n_tokens"])["ids"] == codec.encode(texts[2])
    assert encode_documents(docs.limit(0), VOCABULARY).count() == 0


def test_bpe_of_long_texts():
    """Texts of several slices, a word longer than a slice, and more ids than are decoded at once."""
    tokenizer, codec = Tokenizer.from_file(VOCABULARY), WordBpe(VOCABULARY)
    for t in ("some words of ångström 12 <|endoftext|> " * 60_000, "abcde" * 300_000 + " end"):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        raw = codec.encode_bytes(t)
        assert array.array("I", raw).tolist() == want and "".join(codec.decoded(raw)) == tokenizer.decode(want, skip_special_tokens=False)


def test_batches_by_bytes():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["a" * 10, None, "", "b" * 100, "c", "d" * 10, "e"]})
    parts = [b.column(0).to_pylist() for b in by_bytes([batch, batch.slice(5)], 1, 20)]
    assert [x for p in parts for x in p] == [*range(7), 5, 6] and [3] in parts and by_bytes([batch.slice(0, 0)], 1, 20) is not None and list(by_bytes([batch.slice(0, 0)], 1, 20)) == []


def test_automaton_on_random_merges():
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        for _ in range(12):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        automaton = MergeAutomaton("ab", merges)
        for _ in range(40):
            word = [rng.choice("ab") for _ in range(rng.randint(1, 10))]
            want = list(word)
            for u, v in merges:  # merges in order, left to right
                i = 0
                while i < len(want) - 1:
                    if (want[i], want[i + 1]) == (u, v):
                        want[i : i + 2] = [u + v]
                    i += 1
            # of all ways to spell the word in tokens, the automaton has that one only
            text, paths = "".join(word), [([], -1, 0)]
            done = []
            while paths:
                path, state, at = paths.pop()
                if at == len(text):
                    done.append(path)
                for t in tokens:
                    if t in automaton.number and text.startswith(t, at) and automaton.has_arc(state, automaton.number[t]):
                        paths.append(([*path, t], automaton.number[t], at + len(t)))
            assert done == [want]


def test_memo_is_bounded():
    memo = Memo(len, limit=10)
    assert [memo["x" * i] for i in range(1, 60)] == list(range(1, 60)) and len(memo) + len(memo.old) <= 20


def segmentations(word, pieces):
    if not word:
        yield []
    for p in [p for p in pieces if word.startswith(p)] + ([] if word[:1] in pieces else [word[:1]] if word else []):
        yield from ([p, *rest] for rest in segmentations(word[len(p) :], pieces))


def test_language(spark):
    """Held-out accuracy, and each prediction against a sum over all segmentations."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, language.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    predicted = language.predict(docs, model).withColumn("out", remainder(F.col("doc_id"), 4) == 2).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in predicted if r["out"] and r["lang"]]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in predicted)
    odd = spark.createDataFrame(
        [(1, None, "a"), (2, "123 !!", "b"), (None, "the and of " * 50_000, "c"), (3, "x" * 5000, "d"), (4, "½ ² ٣ _ \u0301", "e"), (4, "½ ² ٣ _ \u0301", "e"), (5, "", "f")], "doc_id long, text string, score string"
    )
    rows = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, model).collect()}
    assert [rows[i] for i in (1, 2, 4, 5)] == ["und"] * 4 and rows[None] == "en" and rows[3] in model.langs
    assert language.predict(odd, model).count() == 7 and language.predict(odd.limit(0), model).count() == 0
    assert language.predict(odd, language.fit(docs.limit(0), ["a"])).where("lang_pred = 'und'").count() == 7


def test_language_by_brute_force(spark):
    pieces = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "cab"]
    texts = [("x", "abc ab cab a"), ("x", "cab cab b"), ("y", "bc bc abz c"), ("y", "bbc ccb"), ("y", "b" * 90)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string")
    model = language.fit(docs, pieces, by=1, held_out=5)
    chance = {lang: dict.fromkeys(pieces, 1 / len(pieces)) for lang in "xy"}
    odd = lambda lang, p: chance[lang].get(p, language.ODD)
    total = lambda lang, w: sum(np.prod([odd(lang, p) for p in s]) for s in segmentations(w, pieces))
    for _ in range(language.ROUNDS):
        new = {lang: dict.fromkeys(pieces, language.PRIOR) for lang in "xy"}
        for lang, text in texts[:4]:
            for w in text.split():
                for s in segmentations("▁" + w, pieces):
                    for p in s:
                        if p in pieces:
                            new[lang][p] += np.prod([odd(lang, q) for q in s]) / total(lang, "▁" + w)
        for w in ("▁" + "b" * 39, "b" * 40, "b" * 11):  # one way each
            for c in w:
                new["y"][c] += 1
        chance = {lang: {p: c / sum(new[lang].values()) for p, c in new[lang].items()} for lang in "xy"}
    assert model.langs == ["x", "y"] and all(np.allclose(model.pieces[p], [chance["x"][p], chance["y"][p]]) for p in pieces)
    some = ["cab bc", "z", "abz-cab a", "bbb"]
    rows = language.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for t, r in zip(some, rows):
        log = [sum(np.log(total(lang, "▁" + w)) for w in re.findall("[a-z]+", t)) for lang in "xy"]
        assert r["lang_pred"] == "xy"[int(np.argmax(log))] and np.isclose(r["score"], 1 / np.exp(np.array(log) - max(log)).sum())


def test_forward_sums_all_segmentations():
    model = language.PieceModel(["x"], {"▁": (0.1,), "a": (0.2,), "b": (0.3,), "ab": (0.15,), "▁a": (0.05,)})
    want = np.log(0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.05 * 0.3)
    assert np.isclose(model.scorer().words(["▁ab"])[0, 0], want) and np.isclose(language.forward("▁ab", language._trie(model.pieces), 1, 2)[0], want)
    long = "▁" + "abba" * 9
    assert np.isclose(model.scorer().words([long])[0, 0], language.forward(long, language._trie(model.pieces), 1, 2)[0])


def plain_features(text):
    """The features of each line, one line after the other."""
    out, seen = [], set()
    for line in text.split("\n"):
        raw = line.encode()
        n = max(len(raw), 1)
        count = lambda chars: sum(b in chars for b in raw) / n
        words = re.split("[\0-\x20]+", line.strip("".join(map(chr, range(33)))))
        words = words if words != [""] else []
        letters = {*range(65, 91), *range(97, 123), *range(128, 256)}
        shares = [count(x) for x in (letters, set(range(65, 91)), set(range(48, 58)), set(b" \t"), set(b".,;:?'\"-()"), set(b"#$%&*|!~^=<>{}[]\\@_+"))]
        stutter = sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else 0
        out.append([*shares, np.log1p(len(raw)) / 5, min(n / (sum(b in b" \t" for b in raw) + 1), 30) / 10, line in seen, not raw, stutter])
        seen.add(line)
    return np.array(out, dtype=float)


def test_line_features_by_brute_force(monkeypatch):
    texts = ["", "a b b\n\nA b b\na b b\n", "x" * 300 + "\n" + "é y " * 70 + "\n" + "x" * 300, "one line", "\n\n", "w w w # 12\t9"]
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(line_crf, "BLOCK", block)
        own, length, per_doc = line_crf.line_features(texts)
        assert per_doc.tolist() == [t.count("\n") + 1 for t in texts] and length.tolist() == [len(x.encode()) for t in texts for x in t.split("\n")]
        want = np.concatenate([plain_features(t) for t in texts])
        assert np.allclose(own[:, :-1], want[:, :-1]) and (block < 100 or np.allclose(own[:, -1], want[:, -1]))


def test_quality(spark):
    """Held-out accuracy, and scores against the field worked out line by line."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.fit(docs, labels)
    got = line_crf.score_quality(docs, model).withColumn("out", remainder(F.col("doc_id"), 3) == 1)
    held = [r for r in got.join(labels, "doc_id").collect() if r["out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    some = {r["doc_id"]: r for r in got.where("doc_id < 40").collect()}
    for i, text in [(r["doc_id"], r["text"] or "") for r in docs.where("doc_id < 40").collect()]:
        own = plain_features(text)
        pad = np.vstack([np.zeros(line_crf.N), own, np.zeros(line_crf.N)])
        e = np.hstack([own, pad[:-2], pad[2:], np.ones((len(own), 1))]) @ model.weights
        marginal, _ = line_crf.forward_backward(e, np.array([len(e)]), model.trans)
        weight = np.array([len(x.encode()) + 1 for x in text.split("\n")])
        want = model.score(np.array([(marginal * weight).sum() / weight.sum()]))[0]
        assert np.isclose(some[i]["score"], want, atol=1e-6) and some[i]["bad_lines"] == np.flatnonzero(marginal < 0.5).tolist()
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "\n\n", 0.5), (3, "word " * 500_000, 0.5), (3, "word " * 500_000, 0.5), (4, "a\n" * 50_000, 0.5)], "doc_id long, text string, score double")
    rows = line_crf.score_quality(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert {r["score"] for r in line_crf.score_quality(odd, line_crf.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert line_crf.score_quality(odd.limit(0), model).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    marginal, _ = line_crf.forward_backward(e, np.array([4, 1, 4]), trans)
    for first, n in ((0, 4), (4, 1), (5, 4)):
        total = np.zeros(n + 1)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[first + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += np.array([w * v for v in y] + [w])
        assert np.allclose(marginal[first : first + n], total[:n] / total[n])


def test_toxicity(spark):
    assert toxicity.fold("Y0u 1d10t!! ЅТUРІD ﬁne $cum### 42") == " you idiot stupid fine scum 42 "
    lexicon = toxicity.Lexicon({" trash ": 5.0, " idio": 6.0}, beta=[2.0, 1.0, 0.0, -4.0])
    automaton = lexicon.compiled()
    score = lambda t: lexicon.score(lexicon.features(automaton, t))
    assert score("you 1diot") > 0.7 > score("put it in the trash can") and score("") == score("fine words") < 0.1 and score("trash " + "fine " * 5000) < score("trash")
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = toxicity.learn(docs, labels)
    got = toxicity.score_toxicity(docs, learned).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93
    odd = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "idiot " * 1000, "c")], "doc_id long, text string, score string")
    assert toxicity.drop_toxic(odd, learned).columns == odd.columns
    assert toxicity.score_toxicity(odd, toxicity.learn(docs, labels.limit(0))).where("predicted = 1").count() == 0
