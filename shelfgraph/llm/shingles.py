"""Hashed word shingles of texts, a block of texts at a time, without a loop over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at once, each of which needs some 50 bytes for a while; a longer word is taken whole.
SLICE = 1 << 18
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(11).integers(0, (1 << 64) - 1, (64, 256), dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray, by: np.uint64 = _B) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * by
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def byte_values(data: np.ndarray, place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A random number for each byte at its place in a run, of 64 places from the table; from then on times another odd factor for each 64 places, so
    that parts of a run that change places change the sum."""
    value = table[place & 63, data]
    far = np.flatnonzero(place >= 64)
    if len(far):
        value[far] *= mix((place[far] >> 6).astype(np.uint64) * _A + _C) | np.uint64(1)
    return value


def _slices(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            if cut < 0:
                m = _BREAK.search(raw, end)
                cut = m.start() if m else len(raw) - 1
            end = cut + 1
        yield at, raw[at:end]
        at = end


def word_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, its place); words are runs of bytes other than blank and 9 to 13."""
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, part in _slices(raw):
        data = _FOLD[np.frombuffer(part, dtype=np.uint8)]
        space = _SPACE[data]
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(begins):
            continue
        step = np.zeros(len(data), dtype=np.int64)
        step[begins] = np.diff(begins, prepend=0)
        inside = np.arange(len(data)) - np.cumsum(step)
        value = byte_values(data, inside, _TABLE)
        value[space] = 0
        keys.append(mix(np.add.reduceat(value, begins)))
        places.append(begins + at)
    return np.concatenate(keys), np.concatenate(places)


@dataclass
class Sets:
    """Shingle sets of a block of texts: sorted hashes one set after the other, the size of each, and a 128-bit key of each set."""

    hashes: np.ndarray
    n: np.ndarray
    k1: np.ndarray
    k2: np.ndarray

    def keys(self) -> list[str]:
        text = np.column_stack([self.k1, self.k2]).astype(">u8").tobytes().hex()
        return [text[i : i + 32] for i in range(0, len(text), 32)]

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64) if len(self.n) else np.zeros(0, np.int64)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def take(self, chosen: np.ndarray) -> Sets:
        """The sets whose flag is true."""
        return Sets(self.hashes[np.repeat(chosen, self.n)], self.n[chosen], self.k1[chosen], self.k2[chosen])


def shingle_sets(texts: list[str | None], k: int) -> Sets:
    """Distinct shingles of ``k`` words; of fewer words all of them are one shingle; without words the set is empty."""
    raw = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    keys, places = word_keys(b"".join(raw))
    bounds = np.cumsum([len(r) for r in raw])
    doc = np.searchsorted(bounds, places, side="right")
    words = np.bincount(doc, minlength=len(texts))
    h = np.zeros(max(len(keys) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        h = mix(h ^ _A) + keys[i : i + len(h)] * _B
    h = mix(h)
    whole = doc[: len(h)] == doc[k - 1 :][: len(h)]
    h, owner = h[whole], doc[: len(h)][whole]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(words)[:-1]])
        own = []
        for d in short:
            x = np.full(1, words[d], dtype=np.uint64) * _C
            for i in range(first[d], first[d] + words[d]):
                x = mix(x ^ _A) + keys[i : i + 1] * _B
            own.append(mix(x)[0])
        h, owner = np.concatenate([h, np.array(own, dtype=np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[new], owner[new]
    n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    sums = [np.zeros(len(texts), dtype=np.uint64) for _ in range(2)]
    if len(h):
        has = n > 0
        at = np.concatenate([[0], np.cumsum(n)[:-1]])[has]
        sums[0][has] = np.add.reduceat(mix(h, _A), at)
        sums[1][has] = np.add.reduceat(mix(h ^ _C), at)
    return Sets(h, n, mix(sums[0] + n.astype(np.uint64)), mix(sums[1] ^ _A))


def blocks(batches: Iterator[pa.RecordBatch], column: int, k: int, docs: int = 4096, size: int = 4 << 20) -> Iterator[tuple[list, Sets]]:
    """(the other columns' values by row, sets) for blocks of at most ``docs`` texts and about ``size`` characters, over batches."""
    rows: list = []
    texts: list[str | None] = []
    parts: list[Sets] = []
    held = chars = 0

    def shingled() -> None:
        nonlocal texts, chars
        parts.append(shingle_sets(texts, k))
        texts, chars = [], 0

    def joined() -> Sets:
        return Sets(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("hashes", "n", "k1", "k2")))

    for batch in batches:
        others = [batch.column(i) for i in range(batch.num_columns) if i != column]
        for i, text in enumerate(batch.column(column)):
            t = text.as_py()
            texts.append(t)
            rows.append(tuple(o[i].as_py() for o in others))
            chars += len(t or "")
            held += len(t or "")
            if chars >= SLICE:
                shingled()
            if len(rows) >= docs or held >= size:
                if texts:
                    shingled()
                yield rows, joined()
                rows, parts, held = [], [], 0
    if rows:
        if texts:
            shingled()
        yield rows, joined()
