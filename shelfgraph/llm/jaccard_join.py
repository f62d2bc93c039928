"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones, the boundary chosen by cost.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. Equal sets are one class from the start, so copies are
never paired. A pair of sizes n and m links when the sets share o(n, m) = ceil(p (n + m) / (100 + p)) shingles, p being the threshold in percent.

* Light: sets up to the boundary list the hashes of all their subsets of the sizes o that some light partner asks for. Sets under one subset hash are
  linked to the smallest of them, which loses no connection: whoever links to another set there links to the smallest too.
* Heavy: pairs with a set above the boundary meet in inverted lists. First a screen, which is exact: of the shingles whose hash falls into a fixed share of
  all hashes, a set with any partner shares all but n - ceil(p n / 100). Then, for the sets that are left, each set puts its rarest shingles into lists, as
  many as a partner cannot all lack. In each list all sets are checked against a leader, the set that shares most. Only a set that
  is not in the leader's class is then checked against the others of its list, if what the two can still share from that shingle on suffices for a link.
  So a large group of near copies costs its size, not its square.

Candidates are always verified on the whole sets. Nothing is sampled or capped; the screen's share of hashes only decides what is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.common import files_for, filter_bits, keep_chosen, settle, tidy, tidy_group
from shelfgraph.llm.components import components
from shelfgraph.llm.shingles import Sets, blocks, mix

#: Sets up to this size may be light; their shingles are kept beside their keys.
SMALL = 64
#: Entries of an inverted list that the cost model reckons with, for each shingle put into a list.
LIST_COST = 8
#: Entries in one bucket of hashes, about.
BUCKET = 500_000
#: A shingle that at least one in so many sets has gets the last rank at once, so at most this many times the mean set size are held in memory.
COMMON = 2000
#: The most bits of the filter over sets that pass the screen: 32 MB in each worker. It has 16 for each set; a fuller one lets more sets pass and loses none.
MOST_BITS = 1 << 28
#: A set that at least one row in so many has is joined to the rows by broadcast, so at most this many are.
HEAVY = 1000


def need(p: int, n: int, m: int) -> int:
    """Shared shingles that a pair of sizes n and m must have."""
    return -(-p * (n + m) // (100 + p))


def _light_sizes(p: int, n: int, top: int) -> set[int]:
    """Sizes of the subsets that a light set of size n lists."""
    lo, hi = -(-p * n // 100), min(top, 100 * n // p)
    return {need(p, n, m) for m in range(lo, hi + 1) if need(p, n, m) <= min(n, m)}


def _light_cost(p: int, n: int, top: int) -> int:
    return sum(math.comb(n, c) for c in _light_sizes(p, n, top))


def boundary(p: int, histogram: dict[int, int]) -> int:
    """The largest light size, for the least cost over the sets that are there: subsets listed against shingles shuffled and list entries read."""
    best, best_cost = 0, math.inf
    for top in range(SMALL + 1):
        light = {n: _light_cost(p, n, top) for n in range(1, top + 1)}
        if any(v > 100_000 for v in light.values()):
            break
        indexed = -(-p * (top + 1) // 100)
        cost = sum(histogram.get(n, 0) * v for n, v in light.items())
        cost += sum(c * (2 * n + LIST_COST * (n - -(-p * n // 100) + 1)) for n, c in histogram.items() if n >= indexed)
        if cost < best_cost:
            best, best_cost = top, cost
    return best


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(docs: DataFrame, k: int, share: int) -> DataFrame:
    """(doc_id, text_key, n, key, ck, sampled, small): of each row the size and key of its set, how many hashes fall into the share, and the set itself if it is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in blocks(batches, 2, k):
            inside = np.bincount(sets.owner()[_sampled(sets.hashes, share)], minlength=len(rows))
            starts = sets.starts()
            small = [sets.hashes[s : s + n].tobytes() if n <= SMALL else None for s, n in zip(starts.tolist(), sets.n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sets.n), pa.array(sets.keys(), pa.string()), pa.array(_longs(sets.k1)), pa.array(inside), pa.array(small, pa.binary())],
                names=["doc_id", "text_key", "n", "key", "ck", "sampled", "small"],
            )

    return docs.mapInArrow(tidy(run), "doc_id long, text_key long, n long, key string, ck long, sampled long, small binary")


def _sampled(h: np.ndarray, share: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(1000) < np.uint64(share)


def _distinct(sets: Sets, least: int) -> Sets:
    """One set of each key, of those with at least ``least`` shingles."""
    _, first = np.unique(np.column_stack([sets.k1, sets.k2]).view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_index=True)
    chosen = np.zeros(len(sets.n), dtype=bool)
    chosen[first] = True
    return sets.take(chosen & (sets.n >= least))


def _screen_rows(docs: DataFrame, k: int, least: int, share: int, buckets: int) -> DataFrame:
    """(kind, value, n): kind 0, the number of sampled shingles that the set with the key ``value`` shares with another set, in parts; kind 1, how often the
    shingle ``value`` was seen, in parts, where it is frequent in a block. What a block can settle itself is summed there, so a shingle has one entry for each block."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, sets) in enumerate(blocks(batches, 0, k)):
            sets = _distinct(sets, least)
            if not len(sets.n):
                continue
            seen, times = np.unique(sets.hashes, return_counts=True)
            often = times >= 4
            inside = _sampled(sets.hashes, share)
            h, owner = sets.hashes[inside], sets.owner()[inside]
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            u, at, count = np.unique(h, return_index=True, return_counts=True)
            single = at[count == 1]
            several = np.repeat(count > 1, count)
            credit = np.bincount(owner[several], minlength=len(sets.n))
            has = credit > 0
            out: list[tuple[int, bytes]] = []
            for values, extra, kind in ((h[single], sets.k1[owner[single]], 0), (u[count > 1], None, 1), (seen[often], times[often].astype(np.uint64), 2)):
                place = (values >> np.uint64(8)) % np.uint64(buckets)
                order = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[order], np.arange(buckets + 1).astype(np.uint64))
                for b in range(buckets):
                    s = order[edges[b] : edges[b + 1]]
                    if len(s):
                        out.append((b, bytes([kind]) + values[s].tobytes() + (b"" if extra is None else extra[s].tobytes())))
            if has.any():
                out.append((number % buckets, b"\x03" + sets.k1[has].tobytes() + credit[has].astype(np.uint64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "payload"])

    def gather(rows: pa.Table) -> pa.Table:
        parts: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: [], 3: []}
        for p in rows.column("payload"):
            raw = p.as_py()
            parts[raw[0]].append(np.frombuffer(raw, dtype=np.uint64, offset=1))
        halves = {x: [np.concatenate([a[i * len(a) // 2 : (i + 1) * len(a) // 2] for a in parts[x]] or [np.zeros(0, np.uint64)]) for i in range(2)] for x in (0, 2, 3)}
        known = np.unique(np.concatenate(parts[1] or [np.zeros(0, np.uint64)]))
        h, ck = halves[0]
        u, back, count = np.unique(h, return_inverse=True, return_counts=True)
        # a copy of one set in two blocks is no partner: count keys, not entries
        pairs = np.unique(np.column_stack([back.astype(np.uint64), ck]), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
        sets_of = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(u))
        shared = (sets_of > 1) | np.isin(u, known)
        who, credit = np.unique(pairs[shared[pairs[:, 0].astype(np.int64)], 1], return_counts=True)
        kinds = np.concatenate([np.zeros(len(who) + len(halves[3][0]), np.int8), np.ones(len(halves[2][0]), np.int8)])
        values = np.concatenate([who, halves[3][0], halves[2][0]])
        n = np.concatenate([credit.astype(np.uint64), halves[3][1], halves[2][1]])
        return pa.table({"kind": pa.array(kinds), "value": pa.array(_longs(values)), "n": pa.array(_longs(n))})

    return docs.select("text").mapInArrow(tidy(put), "bucket int, payload binary").groupBy("bucket").applyInArrow(tidy_group(gather), "kind byte, value long, n long")


def _index(docs: DataFrame, k: int, p: int, least: int, buckets: int, flags: np.ndarray, common: np.ndarray) -> DataFrame:
    """(key, n, able, prefix, shared): of each set that passes the screen the shingles that it shares with another such set, how many, and those to be listed."""
    context = docs.sparkSession.sparkContext
    given = context.broadcast((flags, common))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, common = given.value
        for _, sets in blocks(batches, 0, k):
            place = sets.k1 & np.uint64(8 * len(flags) - 1)
            passed = (flags[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            sets = _distinct(sets.take(passed.astype(bool)), least)
            if not len(sets.n):
                continue
            h, owner = sets.hashes, sets.owner()
            # frequent shingles go by the key of the set: their rank is known, they need not meet
            frequent = np.isin(h, common)
            bucket = np.where(frequent, sets.k1[owner], h) >> np.uint64(8)
            bucket = (bucket % np.uint64(buckets)).astype(np.int64) * 2 + frequent
            order = np.lexsort((h, owner, bucket))
            h, owner, bucket = h[order], owner[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(2 * buckets + 1))
            out: list[tuple[int, bytes]] = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[b], edges[b + 1])
                own, count = np.unique(owner[s], return_counts=True)
                head = np.column_stack([sets.k1[own], sets.k2[own], sets.n[own].astype(np.uint64), count.astype(np.uint64)]).ravel()
                out.append((b // 2, bytes([b % 2]) + len(own).to_bytes(4, "little") + head.tobytes() + h[s].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bucket", "payload"])

    def gather(rows: pa.Table) -> pa.Table:
        heads: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        frequent: list[np.ndarray] = []
        for payload in rows.column("payload"):
            raw = payload.as_py()
            n = int.from_bytes(raw[1:5], "little")
            head = np.frombuffer(raw, dtype=np.uint64, count=4 * n, offset=5).reshape(n, 4)
            heads.append(head)
            hashes.append(np.frombuffer(raw, dtype=np.uint64, offset=5 + 32 * n))
            frequent.append(np.full(len(hashes[-1]), raw[0] == 1))
        head, h, last = np.concatenate(heads), np.concatenate(hashes), np.concatenate(frequent)
        who, back = np.unique(head[:, :3], axis=0, return_inverse=True)
        owner = np.repeat(back.ravel(), head[:, 3].astype(np.int64))
        order = np.lexsort((owner, h))
        h, owner, last = h[order], owner[order], last[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner, last = h[new], owner[new], last[new]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        df = np.where(last, 1 << 40, count[back.ravel()]).astype(np.int64)
        keep = df > 1
        h, owner, df = h[keep], owner[keep], df[keep]
        order = np.argsort(owner, kind="stable")
        h, owner, df = h[order], owner[order], df[order]
        own, at = np.unique(owner, return_index=True)
        ends = np.append(at[1:], len(h))
        return pa.table(
            {
                "k1": pa.array(_longs(who[own, 0].copy())),
                "k2": pa.array(_longs(who[own, 1].copy())),
                "n": pa.array(who[own, 2].astype(np.int64)),
                "h": pa.array([h[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                "df": pa.array([df[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
            }
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(out: list, k1: int, k2: int, n: int, hs: list[bytes], dfs: list[bytes]) -> None:
            h, df = np.frombuffer(b"".join(hs), np.uint64), np.frombuffer(b"".join(dfs), np.int64)
            able, least = len(h), -(-p * n // 100)
            if able < least:
                return
            order = np.lexsort((h, df))[: n - least + 1 - (n - able)]
            key = np.array([k1, k2], dtype=np.int64).view(np.uint64).astype(">u8").tobytes().hex()
            out.append((key, n, able, _longs(h[order]), np.sort(h).tobytes()))

        held: tuple | None = None
        hs: list[bytes] = []
        dfs: list[bytes] = []
        for batch in batches:
            out: list = []
            for k1, k2, n, h, df in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held != (k1, k2, n):
                    if held:
                        finish(out, *held, hs, dfs)
                    held, hs, dfs = (k1, k2, n), [], []
                hs.append(h)
                dfs.append(df)
            yield packed(out)
        if held:
            out = []
            finish(out, *held, hs, dfs)
            yield packed(out)

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[4] for o in out], pa.binary())],
            names=["key", "n", "able", "prefix", "shared"],
        )

    lists = docs.select("text").mapInArrow(tidy(put), "bucket int, payload binary").groupBy("bucket").applyInArrow(tidy_group(gather), "k1 long, k2 long, n long, h binary, df binary")
    parts = lists.repartition("k1", "k2", "n").sortWithinPartitions("k1", "k2", "n")
    return parts.mapInArrow(tidy(merge), "key string, n long, able long, prefix array<long>, shared binary")


def _may_link(p: int, n: Column, left: Column, m: Column, m_left: Column) -> Column:
    """Sizes and the shingles that are left allow a link."""
    o = F.ceil(F.lit(p) * (n + m) / F.lit(100 + p) - 1e-9)
    return (o <= F.least(left, m_left)) & (F.lit(100) * F.least(n, m) >= F.lit(p) * F.greatest(n, m))


def _verified(pairs: DataFrame, sets: DataFrame, p: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, sa, nb, sb = (batch.column(i) for i in range(6))
            hit = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                o = int((x[at] == y).sum()) if len(x) else 0
                hit.append(100 * o >= p * (na[i].as_py() + nb[i].as_py() - o))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(tidy(run), "a string, b string")


def _heavy_links(sets: DataFrame, p: int, files: int) -> DataFrame:
    """(a, b): links between large sets, enough of them to connect whatever all links connect. ``files`` bounds those of the lists; steps where a set in many lists or pairs is joined stay in
    as many tasks as Spark has split them into."""
    # left: what a pair can share at most if this is the first shingle in rank that it shares; every pair is judged in the list of its first
    entries = sets.select("key", "n", "able", F.posexplode("prefix").alias("pos", "h")).select("key", "n", "able", "h", (F.col("able") - F.col("pos")).alias("left"))
    rank = F.struct((F.col("able") / F.col("n")).alias("r"), F.col("n").alias("ln"), F.col("left").alias("lleft"), F.col("key").alias("lead"))
    lists = settle(entries.groupBy("h").agg(F.max(rank).alias("top"), F.min("n").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "top", "least"), "lists", files)
    star = entries.join(lists, "h").where((F.col("key") != F.col("top.lead")) & _may_link(p, F.col("n"), F.col("left"), F.col("top.ln"), F.col("top.lleft")))
    pairs = star.select(F.col("key").alias("a"), F.col("top.lead").alias("b")).distinct()
    first = settle(_verified(pairs, sets, p), "links-1")
    # the class that a set is known to be in so far: of its leaders the one of the highest rank
    ranks = sets.select(F.col("key").alias("b"), F.struct((F.col("able") / F.col("n")).alias("r"), "n", "key").alias("rank"))
    label = settle(first.join(ranks, "b").groupBy(F.col("a").alias("key")).agg(F.max("rank").alias("rank")).select("key", F.col("rank.key").alias("label")), "labels", files)
    named = entries.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    lead = lists.select("h", "least", F.col("top.lead").alias("lead")).join(label.select(F.col("key").alias("lead"), F.col("label").alias("lead_label")), "lead", "left").withColumn("lead_label", F.coalesce("lead_label", "lead"))
    in_lists = settle(named.join(lead, "h").withColumn("out", (F.col("label") != F.col("lead_label")) & (F.col("key") != F.col("lead")) & (F.col("least") <= F.floor(F.col("left") * (100 + p) / F.lit(p)) - F.col("n"))), "entries")
    x = in_lists.where("out").select("h", F.col("key").alias("a"), F.col("n").alias("na"), F.col("left").alias("ea"), F.col("label").alias("la"))
    y = in_lists.where(F.col("key") != F.col("lead")).select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("left").alias("eb"), F.col("label").alias("lb"), F.col("out").alias("ob"))
    rest = x.join(y, (x["h"] == y["h"]) & (F.col("la") != F.col("lb")) & (~F.col("ob") | (F.col("a") < F.col("b"))) & _may_link(p, F.col("na"), F.col("ea"), F.col("nb"), F.col("eb")))
    second = _verified(rest.select("a", "b").distinct(), sets, p)
    return settle(first.unionByName(second), "links-2")


def _light_links(classes: DataFrame, p: int, top: int) -> DataFrame:
    """(a, b): links between sets of at most ``top`` shingles, by the hashes of their subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {n: sorted(_light_sizes(p, n, top)) for n in range(1, top + 1)}
        for batch in batches:
            for key, n, small in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = mix(np.frombuffer(small, np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
                total = h.sum(dtype=np.uint64)
                for c in sizes[n]:
                    gone = n - c
                    sums = np.full(1, total) if not gone else total - h if gone == 1 else total - np.array([h[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), gone)], dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(_longs(mix(sums))), pa.array([c] * len(sums), pa.int64()), pa.array([key] * len(sums), pa.string()), pa.array([n] * len(sums), pa.int64())], names=["subset", "c", "key", "n"])

    listed = classes.where((F.col("n") > 0) & (F.col("n") <= top)).select("key", "n", "small").mapInArrow(tidy(run), "subset long, c long, key string, n long")
    listed = settle(listed, "subsets")
    least = listed.groupBy("subset", "c").agg(F.min(F.struct("n", "key")).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("subset", "c", "least")
    found = listed.join(settle(least, "subset-lists"), ["subset", "c"]).where((F.col("key") != F.col("least.key")) & (F.ceil(F.lit(p) * (F.col("n") + F.col("least.n")) / F.lit(100 + p) - 1e-9) <= F.col("c")))
    return found.select(F.col("key").alias("a"), F.col("least.key").alias("b")).distinct()


def _linked(docs: DataFrame, k: int, p: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, key), and classes of equal sets (key, component_id, first_null, first_id, first_key): the smallest id of the class's
    component, and that of its rows that comes first by id, null ids last, and then by a hash of the text."""
    if not 50 <= p <= 100:
        raise ValueError("percent is from 50 to 100")
    share = min(1000, max(50, 25 * (100 - p)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    texts = rows.select("text")
    described = settle(_describe(rows, k, share), "sets")
    files = files_for(described.count())
    first = F.struct(F.col("doc_id").isNull().alias("first_null"), F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"))
    classes = settle(
        described.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.min(first).alias("row"), *(F.first(c).alias(c) for c in ("n", "ck", "sampled", "small"))), "classes", files
    )
    capped = F.least(F.col("n"), F.lit(4 * SMALL))
    histogram = {r["n"]: r["c"] for r in classes.groupBy(capped.alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    top = boundary(p, histogram)
    links = _light_links(classes, p, top)
    least = -(-p * (top + 1) // 100)
    count, sampled, tokens = classes.where(F.col("n") >= least).agg(F.count(F.lit(1)), F.coalesce(F.sum("sampled"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count:
        screened = settle(_screen_rows(texts, k, least, share, max(32, sampled // BUCKET)), "screen")
        credit = screened.where("kind = 0").groupBy(F.col("value").alias("ck")).agg(F.sum("n").alias("credit"))
        may_lack = F.col("n") - F.ceil(F.lit(p) * F.col("n") / 100 - 1e-9)
        left = classes.where(F.col("n") >= least).join(credit, "ck", "left").where(F.coalesce("credit", F.lit(0)) >= F.col("sampled") - may_lack)
        left = settle(left.select("n", "ck"), "screened", files)
        kept, kept_tokens = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        bits = filter_bits(kept, MOST_BITS)
        v = (F.col("ck").bitwiseAND(F.lit(bits - 1)) + 1).alias("v")
        flags = np.zeros(bits // 8, dtype=np.uint8)
        for r in left.select(v).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect():
            flags[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        often = screened.where("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") * COMMON >= max(count, 4 * COMMON))
        common = np.sort(np.array([r["value"] for r in often.collect()], dtype=np.int64).view(np.uint64))
        if kept_tokens:
            sets = settle(_index(texts, k, p, least, max(16, kept_tokens // (2 * BUCKET)), flags, common), "index", files)
            links = links.unionByName(_heavy_links(sets, p, files))
    label = components(links, files)
    members = classes.select("key", "id", "row").join(label.select(F.col("node").alias("key"), "component"), "key")
    smallest = members.groupBy("component").agg(F.min("id").alias("_id"), F.min("row").alias("_row"))
    linked = members.select("key", "component").join(smallest, "component").select("key", "_id", "_row")
    named = classes.select("key", "id", "row").join(linked, "key", "left").select("key", F.coalesce("_id", "id").alias("component_id"), F.coalesce("_row", "row").alias("row"))
    return described.select("doc_id", "text_key", "n", "key"), settle(named.select("key", "component_id", "row.*"), "named", files)


def _with_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with the columns of their class, null for empty sets. Classes of many rows are few, so they are broadcast and their rows stay where they are."""
    total = rows.count()
    often = rows.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * HEAVY > total).select("key")
    often = settle(named.join(often, "key"), "heavy")
    keyed = rows.withColumn("key", F.when(F.col("n") > 0, F.col("key")))
    hot = keyed.join(F.broadcast(often.select("key", F.lit(True).alias("hot"))), "key", "left")
    return hot.where("hot").drop("hot").join(F.broadcast(often), "key").unionByName(hot.where("hot IS NULL").drop("hot").join(named, "key", "left"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by the Jaccard similarity of their sets of ``k``-word shingles, at least ``percent`` hundredths: (doc_id, n_shingles, component_id).

    A-Z are lower-cased; words are runs other than blanks and the characters 9 to 13, of any length. A text of fewer words is one shingle; a null text or one without words has an empty
    set and links with nothing, so its component_id is its own id. component_id is the smallest id that links reach. Returns one row for each row of ``docs``, repeated rows
    too; null ids are never the smallest. An empty table gives no rows. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    rows, named = _linked(docs, k, percent, id_col, text_col)
    return _with_class(rows, named).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents, the one with the smallest id, and all documents that link with nothing; all columns are kept.

    Null ids come last; of rows that share an id, the hash of the text decides; of rows alike in id and text, one is kept. Rows with a null text or without
    words are all kept. An empty table gives no rows.
    """
    rows, named = _linked(docs, k, percent, id_col, text_col)
    best = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    decided = _with_class(rows, named).where("n > 0").select("doc_id", F.col("text_key").alias("key"), best.alias("kept"))
    return keep_chosen(docs, decided, F.xxhash64(docs[text_col]), id_col)
