"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of byte classes, word and line shape and whether the line stood in the document before, of the line
itself and of its two neighbours; a table of four weights scores neighbouring labels. Forward-backward gives each line's marginal; weighted by
length these make the document's quality, which a fitted curve turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.common import by_bytes, tidy
from shelfgraph.llm.labelled import fit_logistic, labelled_sample
from shelfgraph.llm.shingles import byte_values

#: Labelled rows of each class that the field is fitted on, at most.
PER_CLASS = 1500
#: Steps of the fit, and bytes whose lines are counted at once.
STEPS, BLOCK = 80, 1 << 20
_SIGNS = b"#$%&*|!~^=<>{}[]\\@_+"
_CLASSES = np.zeros((6, 256))
_CLASSES[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters
_CLASSES[1, 65:91] = 1  # capitals
_CLASSES[2, 48:58] = 1  # digits
_CLASSES[3, list(b" \t")] = 1
_CLASSES[4, list(b".,;:?'\"-()")] = 1
_CLASSES[5, list(_SIGNS)] = 1
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, (64, 256), dtype=np.uint64)
#: Features of one line; with the neighbours' and a constant there are 3 * N + 1.
N = 11


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths in bytes, lines of each text). A text has at least one line, an empty one where it is empty.

    Bytes are counted a block at a time, and what a block says of a line is added to what the blocks before said, so memory grows with the lines only.
    """
    parts = [_counts(data, place) for data, place in _blocks(texts)]
    sums, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[i > 0 and parts[i - 1][2]] + [False] * (len(p[1]) - 1) for i, p in enumerate(parts)])  # goes on with the line before
    if first.any():
        line = np.flatnonzero(~first)
        sums, key = np.add.reduceat(sums, line), np.add.reduceat(key, line)
    length = sums[:, 6]
    per_doc = np.array([t.count("\n") + 1 for t in texts])
    size = np.maximum(length, 1)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    order = np.lexsort((np.arange(len(key)), key, doc))
    again = np.zeros(len(key))
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    stutter = np.divide(sums[:, 7], sums[:, 8], out=np.zeros(len(key)), where=sums[:, 8] > 0)
    own = np.column_stack([sums[:, :6] / size[:, None], np.log1p(length) / 5, np.minimum(size / (sums[:, 3] + 1), 30) / 10, again, (length == 0).astype(float), stutter])
    return own, length.astype(np.int64), per_doc


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """The texts' bytes, each text closed by a line's end, in blocks of about BLOCK bytes, with the place in its line that a block begins at. Blocks are cut
    behind a word where they can be."""
    held, place = bytearray(), 0

    def cut(raw: bytes) -> tuple[np.ndarray, int]:
        nonlocal place
        at, end = place, raw.rfind(b"\n")
        place = place + len(raw) if end < 0 else len(raw) - end - 1
        return np.frombuffer(raw, dtype=np.uint8), at

    for t in texts:
        for i in range(0, max(len(t), 1), BLOCK):
            held += t[i : i + BLOCK].encode("utf-8", "replace")
            if i + BLOCK >= len(t):
                held += b"\n"
            while len(held) > BLOCK:
                end = 1 + max(held.rfind(b" ", 0, BLOCK), held.rfind(b"\n", 0, BLOCK))
                end = end or BLOCK
                yield cut(bytes(held[:end]))
                del held[:end]
    if held:
        yield cut(bytes(held))


def _counts(data: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bytes of each class, length, stuttering words and words of each line, a hash of the line, whether the last line is open). The first word of a block has none before it."""
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends + 1]).astype(np.int64)
    is_open = data[-1] != 10
    if not is_open:
        starts = starts[:-1]
    span = np.diff(np.append(starts, len(data)))
    length = span - 1
    if is_open:
        length[-1] += 1
    at = np.arange(len(data)) - np.repeat(starts, span)
    at[: span[0]] += place
    key = np.add.reduceat(byte_values(data, at, _TABLE), starts)
    same, words = _stutter(data, starts)
    sums = [np.add.reduceat(c[data], starts) for c in _CLASSES]  # the line's end is in no class
    return np.column_stack([*sums, length, same, words]), key, is_open


def _stutter(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line how many of its words equal the word before, and its words."""
    space = data <= 32
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    lines = len(starts)
    if not len(begins):
        return np.zeros(lines), np.zeros(lines)
    word_of = np.cumsum(np.bincount(begins, minlength=len(data))) - 1
    place = np.arange(len(data)) - begins[np.maximum(word_of, 0)]
    value = byte_values(data, np.maximum(place, 0), _TABLE)
    value[space] = 0
    key = np.add.reduceat(value, begins)
    line = np.searchsorted(starts, begins, side="right") - 1
    same = (key[1:] == key[:-1]) & (line[1:] == line[:-1])
    return np.bincount(line[1:], weights=same, minlength=lines), np.bincount(line, minlength=lines).astype(float)


def _emission(own: np.ndarray, per_doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score of good over bad for each line, from its own features and its neighbours'."""
    before, after = own @ weights[N : 2 * N], own @ weights[2 * N : 3 * N]
    out = own @ weights[:N] + weights[-1]
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    inner = np.ones(len(own), dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    out[at] += before[at - 1]
    out[at - 1] += after[at]
    return out


def _with_neighbours(own: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    before[first] = 0
    after[first + per_doc - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def forward_backward(emission: np.ndarray, per_doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the label good for each line, and expected counts of the four label pairs for each document. ``emission`` is the score of
    good over bad; documents are handled side by side, line by line."""
    n = len(per_doc)
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    order = np.argsort(-per_doc, kind="stable")
    counts, at = per_doc[order], first[order]
    active = [int(k) for k in np.searchsorted(-counts, -np.arange(int(counts[0]) if n else 0), side="left")]  # documents with more than t lines
    e = np.clip(emission, -30, 30)
    emit = np.column_stack([np.ones(len(e)), np.exp(e)])
    emit /= emit.sum(1, keepdims=True)
    m = np.exp(trans)
    alpha, beta = np.zeros_like(emit), np.ones_like(emit)
    for t, k in enumerate(active):
        rows = at[:k] + t
        a = emit[rows] if t == 0 else (alpha[rows - 1] @ m) * emit[rows]
        alpha[rows] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((n, 2, 2))
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        rows = at[:k] + t
        later = emit[rows] * beta[rows]
        joint = alpha[rows - 1][:, :, None] * m[None] * later[:, None, :]
        pairs[order[:k]] += joint / joint.sum((1, 2), keepdims=True)
        b = later @ m.T
        beta[rows - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    curve: np.ndarray

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginal of good, length, lines of each text)."""
        own, length, per_doc = line_features(texts)
        marginal, _ = forward_backward(_emission(own, per_doc, self.weights), per_doc, self.trans)
        return marginal, length, per_doc

    def judged(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The length-weighted marginal of each text, and its lines' marginals."""
        if not texts:
            return np.zeros(0), []
        marginal, length, per_doc = self.lines(texts)
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        weight = length + 1.0
        return np.add.reduceat(marginal * weight, first) / np.add.reduceat(weight, first), np.split(marginal, first[1:])

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, by: int = 3, held_out: int = 1) -> LineField:
    """A field fitted on a bounded sample of labelled documents, every line labelled as its document. Without labels every score is 0.5."""
    rows = labelled_sample(docs, labels, "quality", per_class, by, held_out).select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    width = 3 * N + 1
    model = LineField(np.zeros(width), np.zeros((2, 2)), np.array([1.0, 0.0]))
    y = np.array([r["y"] for r in rows], dtype=float)
    if not 0 < y.sum() < len(y):
        return model
    own, length, per_doc = line_features([r["text"] for r in rows])
    x = _with_neighbours(own, per_doc)
    doc = np.repeat(np.arange(len(rows)), per_doc)
    good = y[doc]
    # a document weighs the same whatever its lines, and so does each class
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / per_doc
    seen = np.zeros((len(rows), 2, 2))
    seen[np.arange(len(rows)), y.astype(int), y.astype(int)] = per_doc - 1
    theta, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, STEPS + 1):  # Adam on the conditional likelihood
        marginal, pairs = forward_backward(x @ theta[:width], per_doc, theta[width:].reshape(2, 2))
        grad = np.concatenate([x.T @ ((marginal - good) * weigh[doc]), ((pairs - seen) * weigh[:, None, None]).sum(0).ravel()]) / len(rows) + 1e-3 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights, model.trans = theta[:width], theta[width:].reshape(2, 2)
    q = np.clip(model.judged([r["text"] for r in rows])[0], 1e-4, 1 - 1e-4)
    model.curve = fit_logistic(np.log(q / (1 - q))[:, None], y, l2=1e-2)
    return model


def score_quality(docs: DataFrame, model: LineField, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_lines, bad_lines) of each row's whole text; score from 0 to 1, predicted 1 where it reaches ``threshold``; bad_lines has the
    numbers, from 0, of the lines whose marginal says bad.

    A null or empty text is one empty line. Texts and lines of any length are handled, a few MB of texts at a time. Repeated rows and null ids need no care; an empty
    table gives no rows; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, BLOCK, 500):
            quality, lines = model.judged([t.as_py() or "" for t in batch.column(1)])
            bad = pa.array([np.flatnonzero(x < 0.5) for x in lines], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(quality)), pa.array([len(x) for x in lines], pa.int64()), bad], names=["doc_id", "score", "n_lines", "bad_lines"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), "doc_id long, score double, n_lines long, bad_lines array<long>")
    return out.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_lines", "bad_lines")
