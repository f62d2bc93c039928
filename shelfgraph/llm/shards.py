"""Sharding by sampled splitters, with DataFrame functions only.

Keys are 64-bit hashes of the text, so equal texts are neighbours. A sample weighted by size gives splitters at quantiles of
the bytes; they cut the keys into many more ranges than shards. The exact weight of each range is then summed over all rows.
A range that is overfull is subdivided: each heavy key in it becomes a range of its own, and a key that alone exceeds a
shard's fair share is divided further by document id. Ranges are dealt to shards, largest first, to the shard with the
fewest bytes. Equal texts thus share a shard unless their group is larger than a shard's fair share.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfgraph.llm.common import settle

#: Ranges for each shard: the bound of everything the driver holds is shards * RANGES_PER_SHARD.
RANGES_PER_SHARD = 64
#: Rows expected in the sample, for each range.
SAMPLES_PER_RANGE = 256
#: Rows that one numbering task gets at most, about.
ROWS_PER_BLOCK = 250_000


def _range_of(key: Column, starts: list[int]) -> Column:
    """Index of the last start that is not above ``key``, by binary search; starts[0] is the least long."""
    steps = [1 << i for i in reversed(range(max(1, len(starts).bit_length())))]
    bounds = F.lit(starts)

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to < len(starts)) & (F.element_at(bounds, F.least(to + 1, F.lit(len(starts)))) <= key), to).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in a shard from 0 to shards - 1, with near equal bytes in each.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``. size: UTF-8 bytes of the text plus 1, a null text
    counts as no bytes and has the crc of the empty string. slot runs from 0 without gaps in each shard, in order of id within blocks. Rows
    alike in id and text are interchangeable and share a shard; a null id is a value as any other. An empty table gives no rows. Other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))
    rows = settle(rows, "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = shards * RANGES_PER_SHARD
    least = -(1 << 63)
    # size-weighted sample: a row of size s is drawn with probability rate * s, by a hash of its id
    rate = SAMPLES_PER_RANGE * wanted / max(total, 1)
    draw = (F.xxhash64("doc_id", "key", F.lit(17)) / F.lit(2.0**64)) + 0.5
    sample = rows.where(draw < F.col("size") * rate)
    cuts = sample.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("q")).first()["q"] or []
    starts = sorted({least, *cuts})
    weights = {r["range"]: r["w"] for r in rows.groupBy(_range_of(F.col("key"), starts).alias("range")).agg(F.sum("size").alias("w")).collect()}
    fair_range, fair_shard = total / wanted, total / shards
    overfull = sorted(i for i, w in weights.items() if w > 1.5 * fair_range)
    heavy = []
    if overfull:
        in_over = F.element_at(F.lit([i in set(overfull) for i in range(len(starts))]), _range_of(F.col("key"), starts) + 1)
        # at most total / fair_range = wanted keys are this heavy
        heavy = rows.where(in_over).groupBy("key").agg(F.sum("size").alias("w")).where(F.col("w") > fair_range).collect()
    whole = {r["key"]: r["w"] for r in heavy}
    starts = sorted({*starts, *whole, *(k + 1 for k in whole if k < (1 << 63) - 1)})
    pieces = [math.ceil(whole[s] / fair_range) if whole.get(s, 0) > fair_shard else 1 for s in starts]
    placed = rows.withColumn("range", _range_of(F.col("key"), starts))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.element_at(F.lit(pieces), F.col("range") + 1).cast("long")).cast("int"))
    filled = placed.groupBy("range", "piece").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    load = [(0, 0, s) for s in range(shards)]
    deal: dict[tuple[int, int], int] = {}
    for r in sorted(filled, key=lambda r: (-r["w"], r["range"], r["piece"])):
        w, n, s = heapq.heappop(load)
        deal[r["range"], r["piece"]] = s
        heapq.heappush(load, (w + r["w"], n + r["n"], s))
    table = [[deal.get((i, p), 0) for p in range(k)] for i, k in enumerate(pieces)]
    flat, offset = [s for t in table for s in t], [0]
    for t in table:
        offset.append(offset[-1] + len(t))
    shard = F.element_at(F.lit(flat), F.element_at(F.lit(offset), F.col("range") + 1) + F.col("piece") + 1)
    # numbering: blocks of at most about an average range's rows, whose counts are summed first, then a row number within each block
    rows_per_block = min(ROWS_PER_BLOCK, max(1, math.ceil(count / wanted)))
    held = {(r["range"], r["piece"]): r["n"] for r in filled}
    blocks = [max(1, math.ceil(held.get((i, p), 0) / rows_per_block)) for i, k in enumerate(pieces) for p in range(k)]
    block = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.element_at(F.lit(blocks), F.element_at(F.lit(offset), F.col("range") + 1) + F.col("piece") + 1).cast("long"))
    placed = placed.select("doc_id", "size", "text_crc32", "range", "piece", block.alias("block"), shard.alias("shard"))
    counts = placed.groupBy("shard", "range", "piece", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "piece", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("range", "piece", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("range", "piece", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    small = F.broadcast(first) if sum(blocks) <= 100_000 else first
    return numbered.join(small, ["range", "piece", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
