"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding: compatibility forms, lower case, look-alike letters of other scripts, and digits or signs that stand for letters inside a
word; what is not a letter or digit becomes one space. Entries are whole words or word beginnings. Their weights are log odds of
document frequencies in labelled documents. A match inside an exception phrase does not count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.llm.common import by_bytes, settle, tidy
from shelfgraph.llm.labelled import fit_logistic, labelled_sample

#: Labelled rows of each class that the lexicon and its calibration are learned from, at most.
PER_CLASS = 4000
#: Word beginnings of these lengths are candidates beside whole words.
STEM_LENGTHS = range(3, 9)
#: An entry needs so many toxic documents, and at least this share of the documents that have it must be toxic (classes weighing the same).
LEAST_DOCS, LEAST_PRECISION = 3, 0.93
#: Parts of the sample: each is scored with the entries that the others give, and the calibration is fitted on these scores.
FOLDS = 3
#: Bytes of text in one batch.
BATCH_BYTES = 4 << 20
#: Entries kept, the most telling first.
MAX_ENTRIES = 5000
#: Look-alikes of Latin letters, Cyrillic and others, then Greek.
HOMOGLYPHS = str.maketrans(dict(zip("авекмнорстухіјѕԁԛԝɡαβεηικνορτυχ", "abekmhopctyxijsdqwgabenikvoptux", strict=True)))
#: Digits and signs read as letters; where 1 or a bar stands for l, see ``_read_as_i``.
SIGNS = str.maketrans("013457@$!|", "oieastasii")
#: Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "class clown", "circus clown", "pond scum", "soap scum", "sore loser", "loser bracket")

_ODD = re.compile(r"[0-9@$!|]")
_FOREIGN = re.compile("[ɡͰ-ԯἀ-῿]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_REST = re.compile(r"[\W_]+")
_SIGNED = re.compile(r"\S*[0-9@$!|]\S*")
_ALIKE = re.compile("|".join(map(chr, HOMOGLYPHS)))
_STRANGE = re.compile(r"\S*[ɡͰ-ԯἀ-῿]\S*")


def _letters(m: re.Match) -> str:
    word = m[0].lstrip("!|#%&*.,;:?\"'()").rstrip("@$!|#%&*.,;:?\"'()")
    return word.translate(SIGNS) if re.search(r"[^\W\d_]", word) and _ODD.search(word) else word


def _look_alikes(text: str) -> str:
    """Look-alikes become Latin letters in words that mix scripts, and in words of look-alikes only if most of the text is Latin. Other words keep their script."""
    latin = sum(c.isascii() and c.isalpha() for c in text) > len(_FOREIGN.findall(text))

    def read(m: re.Match) -> str:
        word = m[0]
        greek = any("Ͱ" <= c <= "Ͽ" for c in word)
        mixed = re.search("[a-z]", word) or (greek and re.search("[Ѐ-ԯ]", word))
        return word.translate(HOMOGLYPHS) if mixed or (latin and not _FOREIGN.search(_ALIKE.sub("", word))) else word

    return _STRANGE.sub(read, text)


def fold(text: str) -> str:
    """Folded text with one space before and after each word."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _HIDDEN.sub("", text)
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = _look_alikes(text)
    if _ODD.search(text):
        text = _SIGNED.sub(_letters, text)
    return f" {_REST.sub(' ', text).strip()} "


def _read_as_i(entry: str) -> list[str]:
    """The entry, and as it is folded where a 1 or a bar was written for some of its l: each one, and all of them."""
    at = [i for i, c in enumerate(entry) if c == "l"]
    return [entry, *dict.fromkeys([entry[:i] + "i" + entry[i + 1 :] for i in at] + ([entry.replace("l", "i")] if at else []))]


@dataclass
class Lexicon:
    """``words`` and ``stems`` with their weights, exception phrases, and the calibration of (weight by length, strongest, weight) to a probability."""

    entries: dict[str, float]  # " word " or " stem"
    exceptions: tuple[str, ...] = EXCEPTIONS
    beta: list[float] = field(default_factory=lambda: [1.0, 1.0, 0.0, -4.0])

    def compiled(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            for form in _read_as_i(entry):
                if form == entry or form not in automaton:
                    automaton.add_word(form, (len(form), weight))
        for phrase in self.exceptions:
            for form in _read_as_i(fold(phrase)):
                automaton.add_word(form, (len(form), None))
        automaton.make_automaton()
        return automaton

    def features(self, automaton: ahocorasick.Automaton, text: str) -> tuple[float, float, float]:
        folded = fold(text)
        if not len(automaton):
            return 0.0, 0.0, 0.0
        best: dict[int, float] = {}  # the strongest entry for each place where a word begins
        free: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                free.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if free:  # both in order, walked once
            free.sort()
            i, until = 0, -1
            for at in sorted(best):
                while i < len(free) and free[i][0] <= at:
                    until, i = max(until, free[i][1]), i + 1
                if at < until:
                    del best[at]
        found = best.values()
        if not found:
            return 0.0, 0.0, 0.0
        words = folded.count(" ") - 1
        total = sum(found)
        return total / math.sqrt(max(words, 1)), max(found), min(total, 50.0) / 10

    def score(self, features: tuple[float, float, float]) -> float:
        z = sum(b * x for b, x in zip(self.beta, (*features, 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in STEM_LENGTHS if k <= len(word))
    return out


def _entries(counts: DataFrame, sizes: dict[tuple[int, int], int], left_out: int) -> dict[str, float]:
    """The telling entries by the counts of all folds but one."""
    folds = [f for f in range(FOLDS) if f != left_out]
    pos, neg = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
    if not pos:
        return {}
    p, q = (sum(F.coalesce(F.col(f"n{f}{y}"), F.lit(0)) for f in folds) for y in (1, 0))
    a, b = (p + 0.05) / (pos + 1), (q + 0.25) / (neg + 1)
    telling = counts.where((p >= LEAST_DOCS) & (a / (a + b) >= LEAST_PRECISION)).select("entry", F.log(a / b).alias("weight"), p.alias("p"))
    return {r["entry"]: r["weight"] for r in telling.orderBy(F.desc(F.col("weight") * F.log1p("p")), "entry").limit(MAX_ENTRIES).collect()}


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, by: int = 3, held_out: int = 1, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from a bounded sample of labelled documents. Its calibration is fitted on scores that each part of the sample gets from the entries of the others.

    Without labels, or without toxic ones, the lexicon is empty and every score is low.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class, by, held_out).select("doc_id", "text", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int").alias("fold"))
    sample = settle(sample, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0, BATCH_BYTES):
            n: dict[tuple[int, int], Counter] = {}
            for text, y, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n.setdefault((f, y), Counter()).update(_candidates(text))
            for (f, y), own in n.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([f] * len(own), pa.int32()), pa.array([y] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["entry", "fold", "y", "n"])

    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = Lexicon({}, tuple(exceptions))
    if not any(y for _, y in sizes):
        return lexicon
    counts = sample.select("text", "y", "fold").mapInArrow(tidy(count), "entry string, fold int, y int, n long")
    per = [F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n"))).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    counts = settle(counts.groupBy("entry").agg(*per).where(sum(F.coalesce(F.col(f"n{f}1"), F.lit(0)) for f in range(FOLDS)) >= LEAST_DOCS), "toxic-entries")
    rows: list = []
    for f in range(FOLDS):
        part = Lexicon(_entries(counts, sizes, f), tuple(exceptions))
        rows += _featured(sample.where(F.col("fold") == f), part, ["doc_id", "y"]).select("y", "a", "b", "c").collect()
    lexicon.entries = _entries(counts, sizes, -1)
    lexicon.beta = fit_logistic(np.array([r[1:] for r in rows]), np.array([r["y"] for r in rows])).tolist()
    return lexicon


def _featured(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep``, the three features a, b, c and the score of each row's text."""
    entries, exceptions, beta = lexicon.entries, lexicon.exceptions, lexicon.beta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(entries, exceptions, beta)
        automaton = own.compiled()
        for batch in by_bytes(batches, len(keep), BATCH_BYTES):
            found = [own.features(automaton, t.as_py() or "") for t in batch.column(len(keep))]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(3)] + [pa.array([own.score(f) for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], names=[*keep, "a", "b", "c", "score"])

    rows = rows.select(*keep, "text")
    schema = T.StructType([*rows.schema.fields[: len(keep)], *(T.StructField(k, T.DoubleType()) for k in ("a", "b", "c", "score"))])
    return rows.mapInArrow(tidy(run), schema)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row's whole text: score from 0 to 1, predicted 1 where it reaches ``threshold``.

    Null and empty texts have no match and get the score of a text without any. Whole texts of any length, repeated rows and null ids need no care; an empty table
    gives no rows; other columns are ignored. Nothing is shuffled.
    """
    scored = _featured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lexicon, ["doc_id"])
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns are kept, and nothing is shuffled. Null and empty texts stay."""
    entries, exceptions, beta, place = lexicon.entries, lexicon.exceptions, lexicon.beta, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(entries, exceptions, beta)
        automaton = own.compiled()
        for batch in by_bytes(batches, place, BATCH_BYTES):
            yield batch.filter(pa.array([own.score(own.features(automaton, t.as_py() or "")) < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
