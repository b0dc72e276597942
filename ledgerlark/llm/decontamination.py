"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders.  Windows of ``WINDOW`` words are hash-joined
by their template, or by their plain words whatever the case; so a question with other numbers
or names is caught, and so is a copy in capitals or one made of placeholders.  A template
counts if it holds a placeholder and ``LITERALS`` words that are none; other windows have their
plain words only.

Two passes.  The first seeks each item's *anchors* in all documents.  Windows that many items
share are no anchors, as long as they can't cover ``share`` of the item by themselves: a
contaminated document then holds an anchor too, and common phrases give no rows.  The second
takes the distinct texts that the first found and matches whole items in them.  Matches at
one distance between text and item form a placement; it counts if its slots agree, which is
that one value of the item always stands for one value of the text.  A text is contaminated if
the placements that count cover ``share`` of an item's words.

The benchmark goes through the first pass in blocks of at most ``BLOCK_WINDOWS`` anchors, (hash,
item) pairs of 16 bytes, which bounds a broadcast; each block meets all documents.

Defined cases: null text has no words; an item with fewer words than a window takes its own
length as window; verdicts are of texts, so rows that repeat or have null or equal ids each get
their own; repeated items are each reported; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .native import WHITE, let, total
from .storage import save

#: Private-use characters, which are taken out of texts.
NUMBER, NAME, UNIT = "", "", ""
#: Units of measure, time and money that may follow a number.
UNITS = "mm cm m km in ft yd mi miles? met(?:re|er)s? mg g kg lbs? oz tons? ml l lit(?:re|er)s? s sec seconds? min minutes? h hr hours? days? weeks? months? years? usd eur gbp dollars? euros? pounds? cents? percent mph kph kmh".split()
#: Characters that are no part of a word.
MARKS = ".,;:!?\"'`()[]{}<>*#&%$|~^_=+-/\\@’‘“”«»…–—¡¿" + NUMBER + NAME + UNIT
WINDOW, LITERALS, SHARE = 5, 2, 0.8
BLOCK_WINDOWS = 1_000_000


def _bare(text: Column) -> Column:
    """The text with one kind of white space, ahead of it too, and without marks."""
    return F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), WHITE + MARKS, " " * len(WHITE)))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def raw_words(text: Column) -> Column:
    """Words without marks and in lower case; as many as template words, in the same places."""
    return _split(F.lower(_bare(text)))


def template_words(text: Column) -> Column:
    """Words with numbers, units after numbers, and capitalised words as placeholders."""
    text = F.regexp_replace(_bare(text), r" \p{N}[^ ]*", " " + NUMBER)
    text = F.regexp_replace(text, rf"(?i)({NUMBER} +)(?:{'|'.join(UNITS)})(?![^ ])", "$1" + UNIT)
    return _split(F.lower(F.regexp_replace(text, r" \p{Lu}[^ ]*", " " + NAME)))


def _keys(at: Column, n: int) -> list[Column]:
    """Hashes of the window at ``at``: of its plain words, and of its template, which is null where it doesn't count."""
    held = reduce(Column.__add__, (F.get("held", at + k) for k in range(n)))
    template = F.when(held.between(1, n - min(LITERALS, n)), F.xxhash64(F.lit(-n), *(F.get("w", at + k) for k in range(n))))
    return [F.xxhash64(F.lit(n), *(F.get("raw", at + k) for k in range(n))), template]


def _windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (with ``text``), one for each position ``at`` and each ``key`` of it, with ``raw`` and ``w``."""
    rows = rows.withColumn("raw", raw_words(F.col("text"))).withColumn("w", template_words(F.col("text")))
    rows = rows.withColumn("held", F.transform("w", lambda x: x.isin(NUMBER, NAME, UNIT).cast("int")))
    # no filter here: it would make the words of every text once more
    rows = rows.withColumn("at", F.explode(F.when(F.size("raw") > 0, F.sequence(F.lit(0), F.size("raw") - 1))))
    # a window that runs past the end has null words; its hash is taken out by its place
    keys = [F.when(F.col("at") + n <= F.size("raw"), k) for n in lengths for k in _keys(F.col("at"), n)]
    return rows.withColumn("key", F.explode(F.array(*keys))).where("key IS NOT NULL")


def _covered(places: Column, n: Column) -> Column:
    """Words that windows of ``n`` words at the sorted ``places`` cover."""
    return total(F.transform(places, lambda p, j: F.least(n, F.coalesce(F.get(places, j + 1) - p, n))), "int")


def benchmark_windows(items: DataFrame, share: float = SHARE) -> DataFrame:
    """``item_key``, ``item_words``, ``n`` (length), ``item_at``, ``key``, ``slots`` (raw words at placeholders, else null)
    and ``anchor`` of the windows of items (item_key, text), one or two rows a window."""
    w = items.select("item_key", "text").withColumn("item_words", F.size(raw_words(F.col("text")))).where("item_words > 0")
    w = w.withColumn("n", F.least(F.lit(WINDOW), F.col("item_words")))
    w = reduce(DataFrame.unionByName, [_windows(w.where(F.col("n") == n), [n]) for n in range(1, WINDOW + 1)])
    slots = F.transform(F.slice("w", F.col("at") + 1, F.col("n")), lambda x, k: F.when(x.isin(NUMBER, NAME, UNIT), F.get("raw", F.col("at") + k)))
    w = save(w.select("item_key", "item_words", "n", F.col("at").alias("item_at"), "key", slots.alias("slots")))
    often = w.groupBy("key").agg(F.count("*").alias("times"))
    spots = w.join(often, "key").groupBy("item_key", "item_words", "n", "item_at").agg(F.max("times").alias("times"))
    spots = spots.groupBy("item_key", "item_words", "n").agg(F.array_sort(F.collect_list(F.struct("item_at", "times"))).alias("spots"))
    # the least bound so that windows more frequent than it can't make up the share
    over = lambda bound: _covered(F.transform(F.filter("spots", lambda s: s["times"] > bound), lambda s: s["item_at"]), F.col("n"))
    bounds = F.filter(F.array(*[F.lit(1 << k).cast("long") for k in range(0, 62, 2)]), lambda b: over(b) < F.col("item_words") * share)
    anchors = spots.withColumn("bound", F.get(bounds, F.lit(0))).select("item_key", "bound", F.explode("spots").alias("s"))
    anchors = anchors.select(F.col("item_key").alias("a_item"), F.col("s.item_at").alias("a_at"), (F.col("s.times") <= F.col("bound")).alias("anchor"))
    return save(w.join(anchors, (F.col("item_key") == F.col("a_item")) & (F.col("item_at") == F.col("a_at"))).drop("a_item", "a_at"))


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _candidates(texts: DataFrame, bench: DataFrame, lengths: list[int]) -> DataFrame:
    """(digest, text, items): the distinct texts that hold an anchor of an item, with these items."""
    anchors = save(bench.where("anchor").select(F.col("key").alias("a_key"), "item_key").distinct())
    blocks = max(1, -(-anchors.count() // BLOCK_WINDOWS))
    part = lambda b: anchors.where(F.pmod(F.xxhash64("a_key", "item_key"), F.lit(blocks)) == b)
    found = [_windows(texts, lengths).join(F.broadcast(part(b)), F.col("key") == F.col("a_key")) for b in range(blocks)]
    pairs = save(reduce(DataFrame.unionByName, found).select(_digest(F.col("text")).alias("p_digest"), "item_key").distinct().groupBy("p_digest").agg(F.collect_list("item_key").alias("items")))
    # only now are the texts fetched, one of each
    held = texts.withColumn("digest", _digest(F.col("text"))).join(pairs.select("p_digest"), F.col("digest") == F.col("p_digest"), "left_semi")
    return held.groupBy("digest").agg(F.first("text").alias("text")).join(pairs, F.col("digest") == F.col("p_digest")).drop("p_digest")


def contaminated_texts(texts: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``digest`` (md5 of the text), ``item_key``, ``item_words``, ``n_covered`` and ``n_changed`` of the contaminated
    ones of ``texts`` (text), for items (item_key, text)."""
    bench = benchmark_windows(items, share)
    lengths = [r["n"] for r in bench.select("n").distinct().orderBy("n").collect()] or [WINDOW]  # at most WINDOW rows
    # a text and its items are brought together once, however many anchors and copies were found
    pairs = save(_candidates(texts, bench, lengths))
    # rows carry the words of their window, never those of the whole text, and get the text's items when windows of no item have gone
    own = _windows(pairs.select("digest", "text"), lengths).select("digest", "at", "key", F.slice("raw", F.col("at") + 1, WINDOW).alias("window"))
    own = own.join(bench.select(F.col("key").alias("b_key")).distinct(), F.col("key") == F.col("b_key"), "left_semi")
    items_of = pairs.select(F.col("digest").alias("i_digest"), F.explode("items").alias("of_item"))
    own = own.join(items_of, F.col("digest") == F.col("i_digest")).drop("i_digest")
    found = own.join(bench.withColumnRenamed("key", "b_key"), (F.col("key") == F.col("b_key")) & (F.col("of_item") == F.col("item_key")))
    values = F.transform("slots", lambda x, k: F.when(x.isNotNull(), F.struct(x.alias("of"), F.get("window", k).alias("to"))))
    found = found.select("digest", "item_key", "item_words", "n", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", F.array_compact(values).alias("pairs"))
    # a placement has at most as many windows as its item
    placed = found.groupBy("digest", "item_key", "item_words", "n", "shift").agg(F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    placed = placed.where(F.size(F.array_distinct(F.col("pairs.of"))) == F.size("pairs"))
    placed = placed.withColumn("n_changed", F.size(F.filter("pairs", lambda p: p["of"] != p["to"]))).withColumn("n_found", F.size("ats"))
    # placements of a pair are joined per item position, so a text with many of them stays small
    best = F.max(F.struct(F.col("n_found"), (-F.col("n_changed")).alias("same")))
    spots = placed.groupBy("digest", "item_key", "item_words", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("ats"), (-best["same"]).alias("n_changed"))
    spots = spots.withColumn("n_covered", let(F.col("ats"), lambda a: _covered(a, F.col("n"))))
    return spots.where(F.col("n_covered") >= F.col("item_words") * share).select("digest", "item_key", "item_words", "n_covered", "n_changed")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """``id``, ``item``, ``item_words``, ``n_covered`` and ``n_changed`` (slots with another value) for each contaminated document and item."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).withColumn("item_key", F.xxhash64("item", "text"))
    found = save(contaminated_texts(rows.select("text"), bench.select("item_key", "text").distinct(), share))
    named = found.join(bench.select("item", F.col("item_key").alias("i_key")), F.col("item_key") == F.col("i_key"))
    rows = rows.select("id", _digest(F.col("text")).alias("row_digest"))
    return rows.join(named, F.col("row_digest") == F.col("digest")).select("id", "item", "item_words", "n_covered", "n_changed")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is contaminated."""
    bench = items.select(F.xxhash64(item_id, item_text).alias("item_key"), F.col(item_text).cast("string").alias("text")).distinct()
    bad = save(contaminated_texts(docs.select(F.col(text_col).cast("string").alias("text")), bench).select(F.col("digest").alias("bad_digest")).distinct())
    # a null text has a null digest and stays; the row is a struct meanwhile, so that its columns may have any names
    rows = docs.select(F.struct("*").alias("own_row"), _digest(F.col(text_col).cast("string")).alias("own_digest"))
    return rows.join(bad, F.col("own_digest") == F.col("bad_digest"), "left_anti").select("own_row.*")
