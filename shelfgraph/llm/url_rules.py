"""URL filters: host-suffix and path-prefix expressions, joined to rules by a short hash prefix, then confirmed by full digest.

A url is expanded into every (host suffix, path prefix) expression that some rule could equal. The suffixes are whole
labels; the prefixes have the lengths that occur among the rules, so a rule's path need not end at a slash. An expression
meets a rule by an equi-join on the first characters of its digest; the full digests are compared next, and among the rules
that hold the longest wins (equally long: the longer host, then the stricter verdict).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.common import lower_ascii

#: Hexadecimal digits of the digest that the equi-join compares.
PREFIX_DIGITS = 8
#: Rules up to this number are broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_RULES = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
    path is what follows up to ``?``, ``#`` or the end. Both are empty for null and for a url without ``://``."""
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdict of ``rules(host, path, verdict)`` on every row of ``pages``.

    Returns one row per row of ``pages``, repeated rows too: (id, host, path, rule, verdict); ``rule`` is host and path of the winning rule, null
    where none holds, and then the verdict is ``default``. A null or empty url and an empty table of rules get the default. Rules with a null
    host, path or verdict are left out; repeated rules count once. Other columns of ``pages`` are ignored.
    """
    host, path = split_url(F.col("_url"))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", "_url", host.alias("_host"), path.alias("_path"))
    known = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    known = known.groupBy("r_host", "r_path").agg(F.max_by("r_verdict", F.when(F.col("r_verdict") == "block", 1).otherwise(0)).alias("r_verdict"))
    known = known.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, PREFIX_DIGITS))
    # what the rules ask of the expansion: a few distinct numbers, bounded by the longest rule
    asked = known.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels"),
        F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    labels = F.split("_host", r"\.")
    suffixes = F.filter(F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in asked["labels"]]) if asked["labels"] else F.array().cast("array<string>"), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("_path") >= k, F.substring("_path", 1, k)) for k in asked["lengths"]]) if asked["lengths"] else F.array().cast("array<string>"), lambda x: x.isNotNull())
    urls = base.where(F.col("_url").isNotNull()).select("_id", "_url", suffixes.alias("s"), prefixes.alias("p"))
    grams = urls.select("_id", "_url", F.explode("s").alias("x_host"), "p").select("_id", "_url", "x_host", F.explode("p").alias("x_path"))
    grams = grams.withColumn("x_digest", _digest(F.col("x_host"), F.col("x_path"))).withColumn("short", F.substring("x_digest", 1, PREFIX_DIGITS)).drop("x_host", "x_path")
    side = F.broadcast(known) if asked["n"] <= BROADCAST_RULES else known
    held = grams.join(side, "short").where(F.col("x_digest") == F.col("r_digest"))
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("c"), "r_host", "r_path", "r_verdict")
    best = held.groupBy(F.col("_id").alias("b_id"), F.col("_url").alias("b_url")).agg(F.max(order).alias("best"))
    out = base.join(best, F.col("_id").eqNullSafe(F.col("b_id")) & (F.col("_url") == F.col("b_url")), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.concat("best.r_host", "best.r_path").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )
