"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. Each language has a probability for each piece. A word's probability is the sum over all ways
to cut it into pieces, by the forward algorithm; the probabilities are estimated by expectation maximisation, whose expected counts
are summed over all segmentations too. A text's score is the posterior of its language, all languages alike before the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.common import by_bytes, remainder, settle, tidy

#: Texts of each language, about, that the model is learned from.
TEXTS_PER_LANG = 1000
#: Rounds of expectation maximisation, what a piece has before any count, the chance of a letter outside the vocabulary.
ROUNDS, PRIOR, ODD = 2, 0.01, 1e-7
START = "▁"
#: Letters of a word that are scored side by side with other words; a longer one is scored by itself, and learned from in parts of so many letters.
SIDE = 40
#: Numbers that a worker's memory of pieces of text may hold, those of one table, bytes of text in one batch, and characters that are handled at once.
REMEMBERED, CELLS, BATCH_BYTES, SLICE = 2_000_000, 2_000_000, 4 << 20, 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(r"\s")
_ASCII = re.compile("[A-Za-z]+")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are letters, perhaps after a word's start, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and p.removeprefix(START).isalpha() or p == START})


def words_of(piece: str) -> list[str]:
    """Runs of letters (``str.isalpha``), in lower case, each after the mark of a word's start."""
    if piece.isalpha():
        return [START + piece.lower()]
    runs = _ASCII.findall(piece) if piece.isascii() else "".join([c if c.isalpha() else " " for c in piece]).split()
    return [START + w.lower() for w in runs]


def _trie(pieces: dict[str, tuple[float, ...]]) -> dict:
    root: dict = {}
    for piece, value in pieces.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = value
    return root


def forward(word: str, trie: dict, k: int, longest: int) -> list[float]:
    """log of the word's probability in each of ``k`` languages, over all segmentations. Only the places that a piece of ``longest`` letters can reach are
    held, and rescaled as it goes, so a word of any length will do."""
    n, odd, scale, span = len(word), (ODD,) * k, 0.0, longest + 1
    alpha: list[list[float] | None] = [None] * span
    alpha[0] = [1.0] * k
    for i in range(n):
        a = alpha[i % span]
        if i % 16 == 0:
            top = max(max(x) for x in alpha if x is not None)
            scale += math.log(top)
            for x in alpha:
                if x is not None:
                    x[:] = [max(v / top, 1e-250) for v in x]
        node, single = trie, False
        for j in range(i, n):
            node = node.get(word[j])
            if node is None:
                break
            p = node.get("")
            if p is not None:
                single = single or j == i
                at = alpha[(j + 1) % span]
                alpha[(j + 1) % span] = [x * y for x, y in zip(a, p)] if at is None else [z + x * y for x, y, z in zip(a, p, at)]
        if not single:
            at = alpha[(i + 1) % span]
            alpha[(i + 1) % span] = [x * y for x, y in zip(a, odd)] if at is None else [z + x * y for x, y, z in zip(a, odd, at)]
        alpha[i % span] = None
    return [math.log(max(x, 1e-300)) + scale for x in alpha[n % span]]


class Pieces:
    """The vocabulary as a sorted table of keys. The number after the last stands for what is no piece."""

    def __init__(self, pieces: list[str]):
        self.names = sorted(pieces, key=_key)
        self.keys = np.array([_key(p) for p in self.names], dtype=np.uint64)
        self.longest = max(map(len, pieces), default=1)

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[place] == h, place, len(self.keys))

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, the number of the piece that each word has from i to j) for words of one length."""
        n = len(words[0])
        codes = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        for i in range(n):
            h = np.zeros(len(words), dtype=np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * _P + codes[:, j]
                yield i, j + 1, self.find(h)

    def forward(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """log-probability of each word, all of one length of at most SIDE letters; ``chance`` has a row for each piece, a column for each language, and a last row of zeros."""
        n, k, none = len(words[0]), chance.shape[1], len(self.keys)
        alpha = np.zeros((n + 1, len(words), k))
        alpha[0] = 1.0
        for i, j, piece in self.arcs(words):
            p = chance[piece]
            if j == i + 1:
                p = np.where((piece < none)[:, None], p, ODD)
            alpha[j] += alpha[i] * p
        return np.log(np.maximum(alpha[n], 1e-300))

    def expected(self, words: list[str], times: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words of one length, each seen so many times, over all their segmentations in one language."""
        n, none = len(words[0]), len(self.keys)
        chance = np.append(chance, 0.0)
        alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        alpha[0] = beta[n] = 1.0
        arcs = [(i, j, piece, np.where(piece < none, chance[piece], ODD if j == i + 1 else 0.0)) for i, j, piece in self.arcs(words)]
        for i, j, _, p in arcs:
            alpha[j] += alpha[i] * p
        for i, j, _, p in reversed(arcs):
            beta[i] += p * beta[j]
        share = np.divide(times, alpha[n], out=np.zeros(len(words)), where=alpha[n] > 0)
        out = np.zeros(none + 1)
        for i, j, piece, p in arcs:
            out += np.bincount(piece, weights=alpha[i] * p * beta[j] * share, minlength=none + 1)
        return out[:none]


def _by_length(words: list[str], most: int) -> Iterator[list[int]]:
    """Places of words of one length, so many that their letters are at most ``most``."""
    groups: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        groups.setdefault(len(w), []).append(at)
    for n, at in groups.items():
        step = max(1, most // n)
        for i in range(0, len(at), step):
            yield at[i : i + step]


@dataclass
class PieceModel:
    langs: list[str]
    pieces: dict[str, tuple[float, ...]]  # probability in each language

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in one worker: many words side by side, each distinct piece of text once as long as it is remembered."""

    def __init__(self, model: PieceModel):
        self.langs, self.k = model.langs, len(model.langs)
        self.pieces = Pieces(list(model.pieces))
        self.chance = np.array([model.pieces[p] for p in self.pieces.names] + [(0.0,) * self.k]).reshape(len(model.pieces) + 1, self.k)
        self.trie = _trie(model.pieces)
        self.index: dict[str, int] = {}
        self.room = max(1000, REMEMBERED // (self.k + 1))
        self.rows = np.zeros((self.room, self.k + 1))

    def words(self, words: list[str]) -> np.ndarray:
        """log-probability of each word in each language, over all segmentations."""
        out = np.zeros((len(words), self.k))
        for at in _by_length(words, CELLS // max(self.k, 1)):
            if len(words[at[0]]) > SIDE:
                for i in at:
                    out[i] = forward(words[i], self.trie, self.k, self.pieces.longest)
            else:
                out[at] = self.pieces.forward([words[i] for i in at], self.chance)
        return out

    def _learn(self, pieces: list[str]) -> None:
        found = [words_of(p) for p in pieces]
        flat = sorted({w for ws in found for w in ws})
        number = {w: i for i, w in enumerate(flat)}
        scored = np.column_stack([self.words(flat), [float(len(w)) for w in flat]]) if flat else np.zeros((0, self.k + 1))
        start = len(self.index)
        block = np.zeros((len(pieces), self.k + 1))
        np.add.at(block, [i for i, ws in enumerate(found) for _ in ws], scored[[number[w] for ws in found for w in ws]] if flat else np.zeros((0, self.k + 1)))
        self.rows[start : start + len(pieces)] = block
        self.index.update(zip(pieces, range(start, start + len(pieces)), strict=True))

    def sums(self, parts: list[str]) -> np.ndarray:
        """The sum of each part's rows: log-probabilities and the number of letters."""
        split = [p.split() for p in parts]
        flat = [x for s in split for x in s]
        out = np.zeros((len(parts), self.k + 1))
        if not flat:
            return out
        distinct = set(flat)
        if len(self.index) + len(distinct) > self.room:
            self.index.clear()
            if len(self.rows) != max(self.room, len(distinct)):
                self.rows = np.zeros((max(self.room, len(distinct)), self.k + 1))
        fresh = [x for x in distinct if x not in self.index]
        if fresh:
            self._learn(fresh)
        rows = self.rows[np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))]
        sizes = np.array([len(s) for s in split])
        has = sizes > 0
        out[has] = np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]])[has])
        return out

    def best(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.k:
            return [("und", 0.0)] * len(texts)
        total = np.zeros((len(texts), self.k + 1))
        parts: list[str] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal parts, owner, held
            if parts:
                np.add.at(total, owner, self.sums(parts))
            parts, owner, held = [], [], 0

        for i, text in enumerate(texts):
            for part in _slices(text or ""):
                parts.append(part)
                owner.append(i)
                held += len(part)
                if held >= SLICE:
                    flush()
        flush()
        out = []
        for row in total:
            if not row[-1]:
                out.append(("und", 0.0))
                continue
            top = row[:-1].argmax()
            out.append((self.langs[top], float(1 / np.exp(np.maximum(row[:-1] - row[top], -700)).sum())))
        return out


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut after white space; a longer run without any is one part."""
    at = 0
    while at < len(text):
        m = _GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def _key(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_P) + ord(c)) % (1 << 64)
    return h


def fit(docs: DataFrame, pieces: list[str], by: int = 4, held_out: int = 2, texts: int = TEXTS_PER_LANG) -> PieceModel:
    """A model of every non-null lang, from a sample of about ``texts`` whole texts of each, never of rows whose crc32 of the id modulo ``by`` is ``held_out``.

    Every word of the sample counts. The counts and each round's expectations are worked out where the texts are; the driver gets a number for each language and piece.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.coalesce(remainder(F.col("doc_id"), by), F.lit(-1)) != held_out))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.xxhash64("doc_id", F.lit(3)) / F.lit(2.0**64) + 0.5
    sample = known.join(F.broadcast(sizes.select(F.col("lang").alias("_l"), "n")), F.col("lang") == F.col("_l")).where(draw * F.col("n") < texts).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            n: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = n.setdefault(lang.as_py(), Counter())
                for piece, times in Counter((text.as_py() or "").split()).items():
                    for w in words_of(piece):
                        for i in range(0, len(w), SIDE):
                            own[w[i : i + SIDE]] += times
            for lang, own in n.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    words = settle(sample.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = Pieces(pieces)
    names, number = table.names, {lang: i for i, lang in enumerate(langs)}
    chance = np.full((len(langs), len(names)), 1 / max(len(names), 1))
    for _ in range(ROUNDS if langs and names else 0):
        given = docs.sparkSession.sparkContext.broadcast(chance)

        def expect(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            chance, table = given.value, Pieces(names)
            total = np.zeros(chance.shape)
            for batch in batches:
                of, ws, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                own = np.array([number[x] for x in of])
                for k in np.unique(own).tolist():
                    mine = np.flatnonzero(own == k)
                    some = [ws[i] for i in mine]
                    for at in _by_length(some, CELLS // (2 * table.longest)):
                        total[k] += table.expected([some[i] for i in at], n[mine[at]].astype(float), chance[k])
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], names=["k", "piece", "c"])

        counted = words.mapInArrow(tidy(expect), "k int, piece int, c double").groupBy("k", "piece").agg(F.sum("c").alias("c"))
        new = np.full(chance.shape, PRIOR)
        for r in counted.collect():
            new[r["k"], r["piece"]] += r["c"]
        chance = new / new.sum(1, keepdims=True)
        given.destroy()
    return PieceModel(langs, {p: tuple(chance[:, i].tolist()) for i, p in enumerate(names)})


def predict(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text; ``und`` and 0 where the text is null or has no letter, or no language was learned.

    A letter is what ``str.isalpha`` takes for one. Equal scores give the language that is first by name. Texts of any length, repeated rows and null ids need no care; an
    empty table gives no rows; other columns are ignored. Nothing is shuffled.
    """
    langs, pieces = model.langs, model.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = PieceModel(langs, pieces).scorer()
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            found = scorer.best(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
