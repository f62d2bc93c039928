"""BPE by a tokenization automaton that is compiled merge by merge.

The automaton reads tokens. It starts with one state that has an arc to itself for every base symbol. A merge (u, v) -> w adds
one gadget: the arcs labelled u are led to a copy of their target that lacks the arc v, and every state that still has an arc u
gets an arc w to where v led. What remains are exactly the paths that the merges in order produce, so each prefix of a word has one
path, and each place of a word one state: encoding fills in the states that lead to the word's end.

All arcs with one label lead to one state, so a state goes by the label of the arcs into it. The table holds for each state the arcs that it lacks.
A gadget takes from a state the arc v and with it every arc that a later merge would have made from v. Labels are numbered so that these are
neighbours: tokens are a forest in which a token hangs below its left part, numbered in preorder with the latest merge first. So one gadget is one
interval of labels, a state is a short sorted list of intervals, and a transition is one binary search in it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.llm.cache import Memo
from shelfgraph.llm.common import by_bytes, kept, tidy

#: White space as the vocabulary's splitter sees it (the property White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that str.split() takes for white space and the splitter does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: In the trie of reversed tokens: the word's end, and the key of a node's label.
END, LABEL = "\n", ""
#: Lower case by characters: no final sigma, and letters that Unicode got after version 15.
LOWER = str.maketrans({"Σ": "σ", **{chr(a): chr(b) for a, b in ((0x1C89, 0x1C8A), (0xA7CB, 0x264), (0xA7CC, 0xA7CD), (0xA7DA, 0xA7DB), (0xA7DC, 0x19B))}, **{chr(c): chr(c + 32) for c in range(0x10D50, 0x10D66)}})
#: Pieces kept in a worker's memo, and the longest of them.
KEPT, KEPT_CHARS = 150_000, 48
#: Characters of one text, bytes of texts in one output batch, and ids that are handled at once.
SLICE, BATCH_BYTES, IDS = 1 << 20, 2 << 20, 1 << 16


class MergeAutomaton:
    """The table of states. ``base`` symbols and the results of ``merges`` are the tokens; no two merges may make one token."""

    def __init__(self, base: Iterable[str], merges: Iterable[tuple[str, str]]):
        tokens = list(base)
        place = {t: i for i, t in enumerate(tokens)}
        steps: list[tuple[int, int]] = []
        for u, v in merges:
            if u + v in place:
                raise ValueError(f"two ways to make {u + v!r}")
            steps.append((place[u], place[v]))
            place[u + v] = len(tokens)
            tokens.append(u + v)
        symbols = len(tokens) - len(steps)
        # the forest by left parts, in preorder, the latest merge first
        below: list[list[int]] = [[] for _ in tokens]
        for time, (u, _) in enumerate(steps):
            below[u].append(symbols + time)
        size = [1] * len(tokens)
        for w in range(len(tokens) - 1, symbols - 1, -1):
            size[steps[w - symbols][0]] += size[w]
        label = [0] * len(tokens)
        at = 0
        for t in range(symbols):
            label[t], at = at, at + size[t]
        for t in range(len(tokens)):  # a token comes after its left part
            at = label[t] + 1
            for w in reversed(below[t]):
                label[w], at = at, at + size[w]
        # one gadget for each merge: the new state is a copy of its right part's, and the left part's loses an interval, apart from those that it lost before.
        # Where an earlier gadget has taken the arc already, the two never meet, and the merge makes nothing
        lacks: list[list[int]] = [[] for _ in tokens]  # sorted: first label << 32 | label behind the last
        idle: set[int] = set()
        first_below = [0] * len(tokens)
        for time, (u, v) in enumerate(steps):
            w = symbols + time
            if u in idle or v in idle or self._lacks(lacks[u], label[v]):
                idle.add(w)
                continue
            lacks[w] = lacks[v][:]
            own, k = below[v], first_below[v]
            while k < len(own) and own[k] < w:
                k += 1
            first_below[v] = k
            insort(lacks[u], label[v] << 32 | (label[own[k - 1]] if k else label[v] + size[v]))
        self.names = [""] * len(tokens)  # by label
        order = [0] * len(tokens)
        for i, n in enumerate(label):
            self.names[n], order[n] = tokens[i], i
        self.number = {t: label[i] for i, t in enumerate(tokens) if i not in idle}
        self.starts, self.ends, self.offsets = array("i"), array("i"), array("i", [0])
        for i in order:
            self.starts.extend(x >> 32 for x in lacks[i])
            self.ends.extend(x & 0xFFFFFFFF for x in lacks[i])
            self.offsets.append(len(self.starts))

    @staticmethod
    def _lacks(intervals: list[int], label: int) -> bool:
        i = bisect_right(intervals, label << 32 | 0xFFFFFFFF)
        return i > 0 and label < intervals[i - 1] & 0xFFFFFFFF

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the state after the arc ``state`` (-1: the start, which lacks none) has the arc ``label``."""
        if state < 0:
            return True
        low = self.offsets[state]
        i = bisect_right(self.starts, label, low, self.offsets[state + 1])
        return i == low or label >= self.ends[i - 1]


class WordBpe:
    """Encoder and decoder for a vocabulary file of kind: NFC, lower case, pre-split words, byte symbols, word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {u + v for u, v in merges}
        self.automaton = MergeAutomaton([t for t in ids if t not in made], merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        #: what an arc emits, by id, and the id of each arc
        self.names = {i: t for t, i in {**ids, **self.special}.items()}
        self.ids = array("I", [ids[t] for t in self.automaton.names])
        self.spelled = array("i", [len(t.removesuffix(self.end)) + t.endswith(self.end) for t in self.automaton.names])
        self.trie: dict = {}
        for token, label in self.automaton.number.items():
            node = self.trie
            for c in reversed(token.removesuffix(self.end) + (END if token.endswith(self.end) else "")):
                node = node.setdefault(c, {})
            node[LABEL] = label
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"[^\s", f"[^{SPACE}"))
        # bytes as printable characters: the printable ones stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.breaks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.word_memo = Memo(self._word, KEPT // 4, KEPT_CHARS)
        self.memo = Memo(self._piece, KEPT, KEPT_CHARS)

    def _word(self, word: str) -> bytes:
        """Ids of the one path that spells the word. Each place is reached by one arc only, so it has one state, which is worked out once and if asked for:
        of the tokens that end there, the one whose arc the state at its beginning has."""
        spelled = word + END
        n = len(spelled)
        starts, ends, offsets, size = self.automaton.starts, self.automaton.ends, self.automaton.offsets, self.spelled
        state: dict[int, int] = {}
        asked, arcs = [n], [self._arcs(spelled, n)]
        while asked:
            j, labels = asked[-1], arcs[-1]
            label = labels[-1]
            i = j - size[label]
            if i:
                here = state.get(i)
                if here is None:
                    asked.append(i)
                    arcs.append(self._arcs(spelled, i))
                    continue
                low = offsets[here]
                at = bisect_right(starts, label, low, offsets[here + 1])
                if at > low and label < ends[at - 1]:
                    labels.pop()
                    continue
            state[j] = label
            asked.pop()
            arcs.pop()
        path = array("I")
        while n:
            label = state[n]
            path.append(self.ids[label])
            n -= size[label]
        path.reverse()
        return path.tobytes()

    def _arcs(self, spelled: str, end: int) -> list[int]:
        """Labels of the tokens that the word has before ``end``, the longest last."""
        node, found = self.trie, []
        for i in range(end - 1, -1, -1):
            node = node.get(spelled[i])
            if node is None:
                break
            label = node.get(LABEL)
            if label is not None:
                found.append(label)
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without white space, as little-endian 32-bit integers."""
        if piece.isascii() and piece.isalpha():
            return self._word(piece.lower())
        text = unicodedata.normalize("NFC", piece).translate(LOWER).lower()
        symbols = self.symbols
        return b"".join([self.word_memo[w if w.isascii() and w.isprintable() else "".join([symbols[b] for b in w.encode("utf-8")])] for w in self.words.findall(text)])

    def _plain(self, text: str) -> bytes:
        pieces = [p for p in self.spaces.split(text) if p] if any(c in text for c in NOT_SPACE) else text.split()
        return b"".join(map(self.memo.__getitem__, pieces))

    def forget(self) -> None:
        """Empty the memos."""
        for memo in (self.memo, self.word_memo):
            memo.clear()
            memo.old.clear()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Null is empty. Special tokens in the text count as such."""
        return b"".join([self._slice(s) for s in _slices(text or "")])

    def _slice(self, text: str) -> bytes:
        if not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join([array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.breaks.split(text)])

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """What the arcs emit, special tokens too, with spaces between."""
        return " ".join(map(self.names.__getitem__, ids))

    def decoded(self, ids: bytes) -> Iterator[str]:
        """The decoded text in parts of a bounded number of ids."""
        for at in range(0, len(ids), 4 * IDS):
            yield (" " if at else "") + self.decode(array("I", ids[at : at + 4 * IDS]))


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut behind a blank; a longer run without one is one part."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + SLICE)
        end = len(text) if cut < 0 else cut + 1
        yield text[at:end]
        at = end


def _codec(path: str) -> WordBpe:
    """One compiled automaton for each worker process and vocabulary, as long as the process does nothing else."""
    return kept("bpe", path, lambda: WordBpe(path))


COLUMNS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def _column(kind: str, encoded: list[bytes], codec: WordBpe) -> pa.Array:
    if kind == "n_tokens":
        return pa.array([len(x) // 4 for x in encoded], pa.int64())
    if kind == "ids":  # the encoder's bytes are the column's
        values = pa.Array.from_buffers(pa.int32(), sum(map(len, encoded)) // 4, [None, pa.py_buffer(b"".join(encoded))])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in encoded)]), pa.int32()), values)
    if kind == "ids_sha256":
        return pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string())
    if kind == "decoded":
        return pa.array(["".join(codec.decoded(x)) for x in encoded], pa.string())
    out = []
    for x in encoded:
        sha = hashlib.sha256()
        for part in codec.decoded(x):
            sha.update(part.encode())
        out.append(sha.hexdigest())
    return pa.array(out, pa.string())


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's whole text encoded, and its ids decoded again: (id, *outputs), of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    ``path`` is a vocabulary file that every executor can read. Null and empty texts have no tokens; texts of any length, repeated rows and null
    ids need no care; an empty table gives no rows; other columns are ignored. Rows leave in batches of a few MB. Nothing is shuffled.
    """
    if unknown := set(outputs) - set(COLUMNS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            encoded = [codec.encode_bytes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_column(k, encoded, codec) for k in outputs)], names=[id_col, *outputs])
        codec.forget()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = T.StructType([rows.schema[0], *(T.StructField(k, COLUMNS[k]) for k in outputs)])
    return rows.mapInArrow(tidy(run, keeps="bpe"), schema)
