"""Exact dedup over a log-structured merge index of digests, with DataFrame functions only.

* Memtable and flush: each task sorts its (digest, row) entries by digest and writes them; the files of a flush are dealt to several runs of tier 0. Every
  run has a bit filter on its digests, sized by the number of its entries and kept beside it.
* Compaction: runs of one tier are merged into a run of the next, which has one entry for each digest: the smallest identifier (or the largest, as the policy
  says) and the number of rows. Spark sums within each task first, so a digest that a third of the rows share costs little. From tier 1 on, runs
  are merged in pairs, and their filters are read first: entries that the other run cannot have are passed on as they are, only the rest meet in a shuffle.
* Lookups read a run's filter first and probe the run only for the digests that it may have.
* Hits, that is rows whose digest has more than one entry, are verified by bytes: their texts are grouped by the whole text. A filter over the hits
  drops all other texts at the scan. Where different texts share a digest, each text is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm.common import MOST_BITS, bit_filter, filter_bits, keep_chosen, may_hold, maybe_in, new_path, settle

#: Runs that a flush writes, and runs of tier 0 that are merged at a time.
RUNS, FANOUT = 8, 4
#: A digest that at least one row in so many has is joined by broadcast, so at most this many entries are.
HEAVY = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Run:
    """A sorted run and its filter. Tier 0 has one entry for each row (digest, id, flush, row), the others one for each digest (digest, best, n)."""

    entries: DataFrame
    tier: int
    n: int
    bits: int
    filter: DataFrame

    @property
    def selective(self) -> bool:
        """Whether the filter has room for the entries; a fuller one would let nearly all pass."""
        return 2 * self.n <= self.bits


class DigestIndex:
    """The index in the shared folder: runs by tier. ``compact`` leaves one run, the level."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.spark, self.keep, self.digest, self.id_col, self.text_col, self.most_bits = spark, keep, digest, id_col, text_col, most_bits
        self.runs: list[Run] = []
        self.flushed: list[DataFrame] = []

    def text(self) -> Column:
        return F.coalesce(F.col(self.text_col), F.lit(""))

    def _rank(self) -> Column:
        """max() of it gives the kept row: null ids lose, equal ids are told apart by the flush and the row's place in it."""
        # ~id orders the other way round for every long; a negated id would overflow at the least one
        by_id = F.bitwise_not(F.col("id")) if self.keep == "smallest" else F.col("id")
        return F.struct(by_id.alias("by_id"), F.bitwise_not(F.col("flush")).alias("flush"), F.bitwise_not(F.col("row")).alias("row"))

    def keep_id(self) -> Column:
        return F.bitwise_not(F.col("best.by_id")) if self.keep == "smallest" else F.col("best.by_id")

    @staticmethod
    def is_best() -> Column:
        return (F.bitwise_not(F.col("flush")) == F.col("best.flush")) & (F.bitwise_not(F.col("row")) == F.col("best.row"))

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write the entries of ``docs`` as sorted runs of tier 0; returns all of them as read back."""
        entries = docs.select(
            F.col(self.id_col).cast("long").alias("id"), self.digest(self.text()).alias("digest"), F.lit(len(self.flushed)).alias("flush"), F.monotonically_increasing_id().alias("row"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run")
        )
        path = new_path(self.spark, "digest-runs")
        entries.sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(path)
        back = self.spark.read.schema(entries.schema).parquet(path)
        sizes = {r["run"]: r["n"] for r in back.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
        bits = filter_bits(max(sizes.values(), default=0), self.most_bits)
        filters = settle(bit_filter(back, "digest", bits, "run"), "digest-filters")
        for run, n in sorted(sizes.items()):
            self.runs.append(Run(back.where(F.col("run") == run).drop("run"), 0, n, bits, filters.where(F.col("run") == run).drop("run")))
        self.flushed.append(back.drop("run"))
        return self.flushed[-1]

    def _written(self, merged: DataFrame, tier: int) -> Run:
        entries = settle(merged.sortWithinPartitions("digest"), f"digest-tier-{tier}")
        n = entries.count()
        bits = filter_bits(n, self.most_bits)
        return Run(entries, tier, n, bits, settle(bit_filter(entries, "digest", bits), "digest-filter"))

    def _merge_rows(self, runs: list[Run]) -> Run:
        """Runs of tier 0 as one of tier 1."""
        rows = runs[0].entries
        for r in runs[1:]:
            rows = rows.unionByName(r.entries)
        return self._written(rows.groupBy("digest").agg(F.max(self._rank()).alias("best"), F.count(F.lit(1)).alias("n")), 1)

    def _merge_pair(self, a: Run, b: Run) -> Run:
        """Two runs of higher tiers as one. Entries that the other's filter excludes need not meet any."""

        def parted(own: Run, other: Run) -> tuple[DataFrame, DataFrame | None]:
            if not other.selective:
                return own.entries, None
            flagged = may_hold(own.entries, F.col("digest"), other.filter, other.bits, "_lsm_met")
            return flagged.where("_lsm_met").drop("_lsm_met"), flagged.where("NOT _lsm_met").drop("_lsm_met")

        (met_a, alone_a), (met_b, alone_b) = parted(a, b), parted(b, a)
        merged = met_a.unionByName(met_b).groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        for alone in (alone_a, alone_b):
            merged = merged if alone is None else merged.unionByName(alone)
        return self._written(merged, max(a.tier, b.tier) + 1)

    def compact(self) -> DataFrame:
        """Merge all runs, tier by tier, into one level: (digest, best, n), one entry for each digest."""
        fresh = [r for r in self.runs if r.tier == 0]
        runs = [r for r in self.runs if r.tier]
        runs += [self._merge_rows(fresh[i : i + FANOUT]) for i in range(0, len(fresh), FANOUT)]
        while len(runs) > 1:  # the two lowest and smallest first
            runs.sort(key=lambda r: (r.tier, r.n))
            runs = [*runs[2:], self._merge_pair(runs[0], runs[1])]
        self.runs = runs
        return self.level()

    def level(self) -> DataFrame:
        if len(self.runs) == 1 and self.runs[0].tier:
            return self.runs[0].entries
        if not self.runs:
            empty = self.spark.createDataFrame([], "id long, digest binary, flush int, row long")
            return empty.groupBy("digest").agg(F.max(self._rank()).alias("best"), F.count(F.lit(1)).alias("n"))
        return self.compact()

    def lookup(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` with keep_id, the identifier that the index keeps for their digest, null where it has none; candidates only, see ``verify``.

        A run's filter is read first; rows that the run cannot have are not joined with it.
        """
        level = self.level()
        probe = docs.withColumn("_lsm_digest", self.digest(self.text()))
        found = level.select(F.col("digest").alias("_lsm_found"), self.keep_id().alias("keep_id"))
        if not self.runs or not self.runs[0].selective:
            return probe.join(found, F.col("_lsm_digest") == F.col("_lsm_found"), "left").drop("_lsm_digest", "_lsm_found")
        flagged = may_hold(probe, F.col("_lsm_digest"), self.runs[0].filter, self.runs[0].bits, "_lsm_met")
        met = flagged.where("_lsm_met").drop("_lsm_met").join(found, F.col("_lsm_digest") == F.col("_lsm_found"), "left").drop("_lsm_digest", "_lsm_found")
        return met.unionByName(flagged.where("NOT _lsm_met").drop("_lsm_met", "_lsm_digest").withColumn("keep_id", F.lit(None).cast("long")))

    def verify(self, docs: DataFrame, hits: DataFrame, filt: DataFrame, bits: int) -> DataFrame:
        """(digest, variants) for each digest of ``hits``, where variants is the number of different texts, compared byte by byte."""
        texts = docs.select(self.text().alias("text")).withColumn("digest", self.digest(F.col("text")))
        near = maybe_in(texts, F.col("digest"), filt, bits)
        same = near.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))  # the grouping compares whole texts
        return same.groupBy("digest").agg(F.count(F.lit(1)).alias("variants")).join(hits.select("digest"), "digest", "left_semi")


def dedup_exact(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    A group is all rows with the same text, byte for byte, of any length; a null text counts as empty. The row with the smallest (or largest) id stays; of rows
    alike in id too, one stays. Null ids lose against others; a group of null ids only keeps one of them, with a null keep_id. An empty table gives
    no rows. Other columns are ignored.
    """
    index = DigestIndex(docs.sparkSession, keep, digest, id_col, text_col)
    runs = index.flush(docs)
    level = index.compact()
    hits = settle(level.where("n > 1"), "digest-hits")
    n_hits, rows = hits.count(), level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = filter_bits(n_hits)
    filt = settle(bit_filter(hits, "digest", bits), "digest-hit-filter")
    variants = settle(index.verify(docs, hits, filt, bits).where("variants > 1"), "digest-clash")
    is_sha = digest is sha256
    text_sha = F.lower(F.hex("digest")).alias("text_sha256")

    def decided(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").alias("doc_id"), index.keep_id().alias("keep_id"), F.col("n").alias("group_size"), index.is_best().alias("kept"), text_sha)

    # few digests can have that many rows; all others of several rows are joined by shuffle, and rows that the filter excludes not at all
    often = hits.where(F.col("n") * HEAVY > rows)
    flagged = may_hold(runs, F.col("digest"), filt, bits, "_hit").join(F.broadcast(often), "digest", "left")
    heavy = decided(flagged.where("n IS NOT NULL"))
    rest = flagged.where("n IS NULL").drop("best", "n")
    alone = lambda df: df.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha)
    met = rest.where("_hit").join(hits.where(F.col("n") * HEAVY <= rows), "digest", "left")
    out = heavy.unionByName(decided(met.where("n IS NOT NULL"))).unionByName(alone(met.where("n IS NULL"))).unionByName(alone(rest.where("NOT _hit")))
    if is_sha and variants.isEmpty():
        return out
    # different texts with one digest: these groups are formed again, by whole text (with a weaker digest, so is the sha)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), index.text().alias("text")).withColumn("digest", digest(F.col("text"))).withColumn("flush", F.lit(0)).withColumn("row", F.monotonically_increasing_id())
    clash = texts.join(variants.select("digest"), "digest", "left_semi") if is_sha else texts
    again = settle(clash.withColumn("sha", sha256(F.col("text"))), "digest-clash-rows")
    groups = settle(again.groupBy("digest", "sha", "text").agg(F.max(index._rank()).alias("best"), F.count(F.lit(1)).alias("n")), "digest-clash-groups")
    redone = decided(again.join(groups, ["digest", "sha", "text"]).drop("digest").withColumnRenamed("sha", "digest"))
    clashing = variants.select(F.lower(F.hex("digest")).alias("text_sha256"))
    return redone if not is_sha else out.join(clashing, "text_sha256", "left_anti").select(redone.columns).unionByName(redone)


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns and in no order; of rows alike in id and text, one is kept.

    Null texts count as empty, null ids lose; an empty table gives no rows; other columns may have any name.
    """
    found = dedup_exact(docs, keep, id_col=id_col, text_col=text_col).where("group_size > 1").select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return keep_chosen(docs, found, F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256), id_col)
