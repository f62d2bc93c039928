"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, units after numbers and names become typed placeholders; the rest is words in lower case. Windows of three forms of a text are hashed and joined: as it
reads, with the capitalised words inside sentences as names, and with all capitalised words as names. A document is contaminated by an item if it holds enough of the
item's windows, or a long run of them, and if the slots agree: on one diagonal that alone has enough windows (where none has, on that with most), each value of the
item must stand for one value of the document and the other way round. So an item that was asked again with other numbers or names is found, and a text that only has the item's shape is not. A copy that reads like the item needs no slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfgraph.llm.common import bit_filter, maybe_in, settle

#: Words in a window; an item of fewer is one window.
WINDOW = 8
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Windows of a long item on one diagonal that suffice whatever their share: 23 words in a row, half of the shortest long item.
RUN = 16
#: Words by which the parts of a short item may be shifted against each other in a document.
SHIFT = 8
#: Share of an item's windows that a document must hold as they read, to need no agreement of slots: one changed value of a short item stays below.
LITERAL = 0.8
#: Item windows up to this number are broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Documents to be dropped, up to this number, are broadcast (about 20 bytes each).
BROADCAST_GONE = 500_000
#: Benchmark rows, and windows of items, in one file of an intermediate.
ITEMS_A_FILE, WINDOWS_A_FILE = 10_000, 100_000
#: Bits of the filter over documents whose slots are compared.
FILTER_BITS = 1 << 24
#: Units that become a placeholder after a number.
UNITS = "km|m|cm|mm|mi|ft|in|kg|g|mg|lb|lbs|oz|l|ml|s|sec|min|h|hr|hrs|ms|usd|eur|gbp|kmh|mph|hours|minutes|seconds|meters|metres|miles|feet|inches|grams|pounds|dollars|euros|degrees|percent|years|days|weeks|months"
#: Marks before a capitalised word inside a sentence, a unit, and any other capitalised word; the last is the placeholder of a number.
_NAME, _UNIT, _CAPITAL, _NUMBER = "\x01", "\x02", "\x03", "\x04"
#: The forms of a text.
_READS, _NAMED, _CAPITALS = range(3)
_PAIR = ["doc_id", "text_key", "item_id", "item_key"]


def _bound(value: Column, make) -> Column:
    """``make`` of a variable that holds ``value``, which is so worked out once for a row and not once for each use."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _marked(text: Column) -> Column:
    """The text in lower case, with capitalised words and units behind a mark and the digits of one number joined. Texts that have none of these skip the costly patterns."""
    clean = F.translate(F.coalesce(text, F.lit("")), _NAME + _UNIT + _CAPITAL + _NUMBER, "    ")
    capitals = F.regexp_replace(clean, r"(\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{L}+)", _CAPITAL + "$1")
    named = F.regexp_replace(capitals, rf"([\p{{Ll}},;])\s+{_CAPITAL}", f"$1 {_NAME}")

    def measured(s: Column) -> Column:
        joined = F.regexp_replace(s, r"(?<=[0-9])[.,](?=[0-9])", "")
        return F.when(s.rlike("[0-9]"), F.regexp_replace(joined, rf"(?<=[0-9])\s*({UNITS})(?![\p{{L}}\p{{N}}])", f" {_UNIT}$1")).otherwise(s)

    return _bound(F.lower(named), measured)


def _words(text: Column) -> Column:
    """Words in lower case, capitalised ones and units behind a mark."""
    return F.array_remove(F.split(_marked(text), r"[^\p{L}\p{N}\x01\x02\x03]+"), "")


def _is(w: Column, *marks: str) -> Column:
    return F.ascii(w).isin([ord(m) for m in marks])


def _is_number(w: Column) -> Column:
    return F.ascii(w).between(ord("0"), ord("9"))


def _is_name(w: Column, form: int) -> Column:
    return _is(w, _NAME, _CAPITAL) if form == _CAPITALS else _is(w, _NAME)


def _is_typed(w: Column, form: int) -> Column:
    return _is_number(w) | _is(w, _UNIT) | _is_name(w, form)


def _said(w: Column) -> Column:
    """The word without its mark."""
    return F.when(F.ascii(w) < 4, w.substr(F.lit(2), F.length(w))).otherwise(w)


def _hashes(words: Column) -> Column:
    """A hash of each word as it reads. Compared as bytes, only words with a mark are below the number's placeholder."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w < F.lit(_NUMBER), w.substr(F.lit(2), F.length(w))).otherwise(w)))


def _kinds(words: Column) -> Column:
    """The first character of each word that can be a slot; of all others, the one behind the digits."""
    return F.transform(words, lambda w: F.when(w < F.lit(":"), F.ascii(w)).otherwise(ord(":")))


def _form(hashes: Column, kinds: Column, form: int) -> Column:
    """A hash of each word as it stands in a form, of its hash as it reads and its kind."""
    if form == _READS:
        return hashes
    named = [ord(m) for m in ((_NAME, _CAPITAL) if form == _CAPITALS else (_NAME,))]
    return F.zip_with(hashes, kinds, lambda h, k: F.when(k == ord(":"), h).when(k >= ord("0"), F.xxhash64(F.lit(_NUMBER))).when(k.isin(named), F.xxhash64(F.lit(_NAME))).when(k == ord(_UNIT), F.xxhash64(F.lit(_UNIT))).otherwise(h))


def _joined(a: Column, b: Column, by: int) -> Column:
    return F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + by)))


def _runs(hashes: Column, sizes: list[int]) -> Column:
    """For each size an array with a hash of the words from each place on, from runs of 1, 2, 4 and so on; those that would pass the end are of no use."""

    def of(have: dict[int, Column], size: int) -> Column:
        out, n = None, 0
        for p in sorted(have, reverse=True):
            if size & p:
                out, n = (have[p] if out is None else _joined(out, have[p], n)), n + p
        return out

    def grow(have: dict[int, Column]) -> Column:
        p = max(have)
        if 2 * p <= max(sizes):
            return _bound(_joined(have[p], have[p], p), lambda c: grow(have | {2 * p: c}))
        return F.array(*(of(have, s) for s in sizes))

    return _bound(hashes, lambda h: grow({1: h}))


def _grams(words: Column, sizes: list[int]) -> Column:
    """For each place the hashes of the windows that begin there, by form and size, null where an earlier form has the same; n is at the first place the number of words."""
    k, none = range(len(sizes)), F.array().cast("array<array<bigint>>")
    new = lambda a, *old: F.zip_with(a, old[0], lambda x, y: F.when(x != y, x)) if len(old) == 1 else F.zip_with(F.zip_with(a, old[0], lambda x, y: F.when(x != y, x)), old[1], lambda x, y: F.when(y.isNull() | (x != y), x))

    def forms(reads: Column, hashes: Column, kinds: Column) -> Column:
        named = _bound(_runs(_form(hashes, kinds, _NAMED), sizes), lambda a: F.array(*(new(F.get(a, j), F.get(reads, j)) for j in k)))
        every = lambda a: _bound(_runs(_form(hashes, kinds, _CAPITALS), sizes), lambda b: F.concat(reads, a, F.array(*(new(F.get(b, j), F.get(reads, j), F.get(a, j)) for j in k))))
        return F.when(F.exists(kinds, lambda k: k < ord(":")), _bound(named, every)).otherwise(F.concat(reads, none))

    def zipped(w: Column) -> Column:
        read = lambda hashes: _bound(_runs(hashes, sizes), lambda reads: _bound(_kinds(w), lambda kinds: forms(reads, hashes, kinds)))
        arrays = _bound(_hashes(w), read)
        return _bound(arrays, lambda a: F.arrays_zip(F.array(F.size(w)).alias("n"), *(F.coalesce(F.get(a, j), F.array().cast("array<bigint>")).alias(f"h{j}") for j in range(3 * len(sizes)))))

    return _bound(words, zipped)


def _size(n: Column, size: int) -> Column:
    """Words in a window of an item of ``n`` words: so few that one changed word leaves half of the windows of an item of 8 words or more."""
    return F.when(n < size, n).when(n < size * 3 // 2, max(size * 3 // 8, 1)).when(n < 3 * size - 1, max(size // 2, 1)).otherwise(size)


def _listed(items: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each item, place and hash: item_id, item_key, n, size, windows, at, h, named (it is of the form with names) and open (at least half of its words are no slots)."""

    def at(form: int) -> Column:
        runs = lambda s: F.get(_runs(_form(_hashes(F.col("words")), _kinds(F.col("words")), form), sizes), F.array_position(F.lit(sizes), s).cast("int") - 1)
        cut = F.slice(runs(F.col("size")), F.lit(1), F.col("windows"))
        return F.transform(cut, lambda h, i: F.struct(i.alias("at"), h.alias("h"), F.lit(form).alias("form"), (2 * F.size(F.filter(F.slice(F.col("words"), i + 1, F.col("size")), lambda w: _is_typed(w, form))) <= F.col("size")).alias("open")))

    rows = items.select("item_id", "item_key", "n", "size", "windows", F.explode(F.concat(*(at(f) for f in range(3)))).alias("w")).select("*", "w.*")
    return rows.groupBy("item_id", "item_key", "n", "size", "windows", "at", "h").agg(F.bool_or(F.col("form") == _NAMED).alias("named"), F.bool_or("open").alias("open"))


def _hits(docs: DataFrame, known: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """Windows that a document and an item share: the pair, pos, at, and the form by which they are alike."""
    places = docs.select("doc_id", "text_key", F.posexplode_outer(_grams(_words(F.col("text")), sizes)).alias("pos", "w"))
    # the outer forms, since for the inner ones the optimiser would work the windows out once more to filter by their number; the join drops nulls
    grams = places.select("doc_id", "text_key", "pos", F.col("w.n").alias("doc_n"), F.posexplode_outer(F.array(*(F.col(f"w.h{j}") for j in range(3 * len(sizes))))).alias("slot", "h"))
    side = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    form = F.floor(F.col("slot") / len(sizes)).cast("int")
    whole = (F.col("pos") == 0) & F.coalesce(F.col("doc_n") == F.col("n"), F.lit(False))
    like = F.when(form == _READS, _READS).when((form == _NAMED) & F.col("named") & ((F.col("n") >= size) | F.col("open") | whole), _NAMED).when(F.col("open") | whole, _CAPITALS)
    return grams.join(side, "h").select(*_PAIR, "size", "windows", "pos", "at", like.alias("form")).where(F.col("form").isNotNull()).distinct()


def _slots(asked: Column, said: Column, held: Column, size: Column, diagonal: Column, form: int) -> Column:
    """The different pairs of values that stand for each other in the windows held."""
    places = F.array_distinct(F.flatten(F.transform(held, lambda a: F.sequence(a, a + size - 1))))
    z = F.transform(places, lambda p: F.struct(F.get(asked, p).alias("asked"), F.get(said, p + diagonal).alias("said")))
    both = lambda x: (_is_number(x["asked"]) & _is_number(x["said"])) | (_is_name(x["asked"], form) & _is_name(x["said"], form))
    return F.array_distinct(F.transform(F.filter(z, both), lambda x: F.struct(_said(x["asked"]).alias("asked"), _said(x["said"]).alias("said"))))


def _agree(z: Column) -> Column:
    n = lambda c: F.size(F.array_distinct(z[c]))
    return (n("asked") == F.size(z)) & (n("said") == F.size(z))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and an item that it holds: (doc_id, text_key, item_id, matched, windows, coverage, slots, changed).

    matched and windows count places of the item's windows; slots counts the different values compared, changed those that differ. text_key is a hash of the text, which tells
    rows of one id apart. Rows alike give one pair. Null and empty texts and items hold nothing; null ids are values as any other. Empty tables give no pairs. Other columns are ignored.
    """
    n = F.size("words")
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct().select("item_id", F.xxhash64("text").alias("item_key"), _words(F.col("text")).alias("words"))
    items = items.where(n > 0).select("*", n.alias("n"), _size(n, size).alias("size")).withColumn("windows", F.col("n") - F.col("size") + 1)
    # the shuffles' number of partitions follows the documents; each file that a task writes to a local disk costs three processes (chmod)
    items = settle(items.coalesce(benchmark.count() // ITEMS_A_FILE + 1), "items")
    by_size = {r["size"]: r["w"] for r in items.groupBy("size").agg(F.sum("windows").alias("w")).collect()}
    sizes = sorted(by_size) or [size]
    known = settle(_listed(items, sizes).coalesce(3 * sum(by_size.values()) // WINDOWS_A_FILE + 1), "item-windows")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    hits = _hits(keyed, known, sizes, size)
    held = lambda *forms: F.collect_set(F.when(F.col("form").isin(*forms), F.col("at")))
    lines = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*_PAIR, "size", "windows", "diagonal").agg(held(0).alias("reads"), held(0, 1).alias("named"), held(0, 1, 2).alias("every"))
    lines = settle(lines, "diagonals")
    # small windows count only near each other: in one of the overlapping bands of diagonals, each of twice the shift
    band = F.floor((F.col("diagonal") + F.lit(SHIFT) * F.col("half")) / (2 * SHIFT)) * 2 + F.col("half")
    banded = lines.withColumn("half", F.explode(F.when(F.col("size") < size, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("band", F.when(F.col("size") < size, band).otherwise(0))
    total = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    enough = lambda n: (n >= coverage * F.col("windows")) | ((F.col("size") == size) & (n >= RUN))
    parts = banded.groupBy(*_PAIR, "size", "windows", "band").agg(total("every").alias("matched"), total("named").alias("n_named"), total("reads").alias("n_reads"), F.max(F.size("every")).alias("longest"))
    parts = parts.where((F.col("matched") >= coverage * F.col("windows")) | enough(F.col("longest")))
    found = parts.groupBy(*_PAIR).agg(*(F.max(c).alias(c) for c in ("matched", "n_named", "n_reads")))
    # slots: only of the documents found
    on = lambda a, b, keys: [a[k].eqNullSafe(b[f"f_{k}"]) for k in keys]
    f = found.select(*(F.col(k).alias(f"f_{k}") for k in _PAIR), "matched", "n_named", "n_reads")
    near = lines.join(f, on(lines, f, _PAIR)).select(*lines.columns, "matched", "n_named", "n_reads", enough(F.size("every")).alias("alone"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*_PAIR).orderBy(F.desc(F.size("every")), "diagonal"))).where("rank = 1 OR alone")
    named_fit = enough(F.size("named")) | (~F.col("alone") & (F.col("n_named") >= coverage * F.col("windows")))
    literal = (F.greatest(F.size("reads"), "n_reads") >= LITERAL * F.col("windows")) | ((F.col("size") == size) & (F.size("reads") >= RUN))
    near = near.select(*lines.columns, "matched", named_fit.alias("named_fit"), literal.alias("literal"))
    words = items.select(F.col("item_key").alias("i_key"), F.col("words").alias("asked")).dropDuplicates(["i_key"])
    near = near.join(words, F.col("item_key") == F.col("i_key"))
    lists = settle(near.groupBy(F.col("doc_id").alias("f_doc_id"), F.col("text_key").alias("f_text_key")).agg(F.collect_list(F.struct("item_id", "item_key", "size", "windows", "matched", "diagonal", "named_fit", "literal", "named", "every", "asked")).alias("lines")), "found")
    texts = maybe_in(keyed, F.col("text_key"), bit_filter(lists, "f_text_key", FILTER_BITS), FILTER_BITS)

    def judged(c: Column, said: Column) -> Column:
        def verdict(named: Column, every: Column) -> Column:
            pairs = F.when(c["named_fit"] & _agree(named), named).when(_agree(every) | c["literal"], every)
            return F.struct(c["item_id"].alias("item_id"), c["matched"].alias("matched"), c["windows"].cast("long").alias("windows"), pairs.alias("pairs"))

        slots = lambda held, form: _slots(c["asked"], said, c[held], c["size"], c["diagonal"], form)
        return _bound(slots("named", _NAMED), lambda a: _bound(slots("every", _CAPITALS), lambda b: verdict(a, b)))

    out = texts.join(lists, on(texts, lists, ["doc_id", "text_key"])).select("doc_id", "text_key", F.explode(_bound(_words(F.col("text")), lambda said: F.transform("lines", lambda c: judged(c, said)))).alias("c"))
    out = out.select("doc_id", "text_key", "c.*").where(F.col("pairs").isNotNull())
    counts = F.struct((F.col("matched") / F.col("windows")).alias("coverage"), "matched", "windows", (-F.size(F.filter("pairs", lambda x: x["asked"] != x["said"]))).cast("long").alias("unchanged"), F.size("pairs").cast("long").alias("slots"))
    return out.groupBy("doc_id", "text_key", "item_id").agg(F.max(counts).alias("c")).select("doc_id", "text_key", "item_id", "c.matched", "c.windows", "c.coverage", "c.slots", (-F.col("c.unchanged")).alias("changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold an item of ``benchmark``; all columns are kept."""
    gone = settle(find_contamination(docs, benchmark, size, coverage).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(side, (key == F.col("_key")) & docs["doc_id"].eqNullSafe(F.col("_doc")), "left_anti")
