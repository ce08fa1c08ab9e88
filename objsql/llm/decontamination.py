"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question whose
numbers or names were changed has the template of the original. Windows of a
benchmark item's template are joined by hash with those of documents. A pair
that shares enough windows is then checked slot by slot, for each occurrence of
the item in the document: a name or unit of the item must always stand as the
same thing there and the other way round, or the likeness is one of form only.
A number is only held to its place, as two numbers can be equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import settled, small_side

#: Canonical tokens in a window, share of an item's windows that make a document suspect, placeholders in a window at most.
WINDOW, COVERAGE, MOST_SLOTS = 8, 0.5, 4

# The characters that mark a placeholder's token.
NAME, NUMBER, UNIT, POINT = "\x02", "\x03", "\x04", "\x06"
# Units that are canonicalised after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "l", "s", "sec", "min", "h", "hr", "hrs", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz",
    "w", "kw", "v", "a", "j", "n", "pa", "k", "c", "f", "mph", "kmh", "usd", "eur", "gbp", "percent", "dollars", "euros", "pounds", "cents", "meters", "metres", "miles", "feet", "inches",
    "grams", "kilograms", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
)


def tokens(text: Column) -> Column:
    """Lower-case words, with names, numbers and units behind their marker.

    A name is a capitalised word after another word or a comma on its line, a
    number is digits with inner points or commas, a unit follows a number.
    """
    # A unit's word is looked for before lower-casing by (?i); the markers themselves can't occur in the result otherwise.
    marked = F.regexp_replace(text, "[\x01-\x06]", " ")
    marked = F.regexp_replace(marked, r"(?<=[\p{L}\p{N},;] )(?=\p{Lu})", NAME)
    marked = F.regexp_replace(marked, r"(?<=\d)[.,](?=\d)", POINT)
    marked = F.regexp_replace(marked, rf"\d[\d{POINT}]*", f" {NUMBER}$0 ")
    marked = F.regexp_replace(marked, rf"(?i)(?<=\d ) ?(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}\p{{N}}]))", f" {UNIT}")
    return F.array_remove(F.split(F.lower(marked), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}{POINT}]+"), "")


def canonical(words: Column) -> Column:
    """Each token, a placeholder's cut down to its marker."""
    return F.transform(words, lambda w: F.when(w < F.lit("\x05"), F.substring(w, 1, 1)).otherwise(w))


def windows(words: Column, size: int) -> Column:
    """Hash of each window of ``size`` tokens; a shorter text has none."""
    # The inner functions take the hashes as an argument: an expression there would be evaluated for each window.
    def each(hashed: Column) -> Column:
        starts = F.when(F.size(hashed) >= size, F.sequence(F.lit(1), F.size(hashed) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.xxhash64(F.slice(hashed, k, size)))

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), each), 1)


def _word_windows(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """``keep``, place, hash and words (the tokens) of each window of ``text``; a row of the explode holds one window, not its text."""

    def each(words: Column) -> Column:
        slices = lambda a: F.transform(F.when(F.size(a) >= size, F.sequence(F.lit(1), F.size(a) - (size - 1))).otherwise(F.array().cast("array<int>")), lambda k: F.slice(a, k, size))
        return F.arrays_zip(windows(canonical(words), size).alias("hash"), slices(words).alias("words"))

    both = F.element_at(F.transform(F.array(tokens(F.col("text"))), each), 1)
    return df.select(*keep, F.posexplode(both).alias("place", "w")).select(*keep, "place", "w.hash", "w.words")


def _verbatim(plain: DataFrame, items: DataFrame, size: int, coverage: float) -> DataFrame | None:
    """(id, item, share) by windows of real words, for items that templates don't cover: short ones, as one window, and those with windows mostly of placeholders. None if there are no such items."""
    dense = _word_windows(items, size, "item").where(F.size(F.filter("words", lambda w: w < F.lit("\x05"))) > MOST_SLOTS).select("item").distinct()
    # A marker depends on what stands around a text.
    real = F.transform(tokens(F.col("text")), lambda w: F.translate(w, NAME + NUMBER + UNIT, ""))
    cut = items.select("item", real.alias("words")).where(F.size("words") > 0)
    hard = settled(cut.where(F.size("words") < size).union(cut.where(F.size("words") >= size).join(dense, "item", "left_semi")))
    lengths = sorted(r.n for r in hard.select(F.least(F.size("words"), F.lit(size)).alias("n")).distinct().collect())
    if not lengths:
        return None

    def with_length(n: int):
        return lambda h: F.xxhash64(F.lit(n), h)

    def of(words: Column, kept: Column | None = None) -> Column:
        parts = [F.transform(windows(words, n), with_length(n)) for n in lengths]
        return F.concat(*[p if kept is None else F.when(kept == n, p).otherwise(F.array().cast("array<bigint>")) for n, p in zip(lengths, parts)])

    keys = settled(hard.select("item", F.explode(of(F.col("words"), F.least(F.size("words"), F.lit(size)))).alias("hash")).distinct())
    sizes = settled(keys.groupBy("item").agg(F.count(F.lit(1)).alias("n_all")))
    shared = plain.select("id", F.explode(F.element_at(F.transform(F.array(real), lambda words: of(words)), 1)).alias("hash")).join(small_side(keys), "hash")
    counted = shared.groupBy("id", "item").agg(F.count_distinct("hash").alias("n")).join(small_side(sizes), "item")
    return counted.where(F.col("n") >= coverage * F.col("n_all")).select("id", "item", (F.col("n") / F.col("n_all")).alias("share"))


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, coverage: float = COVERAGE
) -> DataFrame:
    """(id, item, coverage, exact, consistent) for documents that share ``coverage`` or more of an item's windows."""
    plain = docs.where(docs[id_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    items = benchmark.where(benchmark[item_col].isNotNull() & benchmark[item_text_col].isNotNull()).select(benchmark[item_col].alias("item"), benchmark[item_text_col].cast("string").alias("text")).distinct()
    spread = _word_windows(items, size, "item")
    # A window of placeholders mostly says nothing.
    spread = settled(spread.where(F.size(F.filter("words", lambda w: w < F.lit("\x05"))) <= MOST_SLOTS))
    sizes = spread.groupBy("item").agg(F.count_distinct("hash").alias("n_windows"), (F.max("place") + size).alias("length"))
    keys = settled(spread.select("item", "hash").distinct())

    shared = plain.select("id", F.explode(windows(canonical(tokens(F.col("text"))), size)).alias("hash")).join(small_side(keys), "hash")
    counted = shared.groupBy("id", "item").agg(F.count_distinct("hash").alias("n_shared")).join(small_side(settled(sizes)), "item")
    suspects = settled(counted.where(F.col("n_shared") >= coverage * F.col("n_windows")))

    # Slot by slot, for suspects only: their texts are read again, not carried along.
    who = settled(suspects.select("id").distinct())
    there = _word_windows(plain.join(small_side(who), "id"), size, "id").withColumnRenamed("words", "found").withColumnRenamed("place", "at").join(small_side(keys), "hash")
    met = settled(there.join(small_side(suspects.select("id", "item", "n_windows", "length")), ["id", "item"]).join(small_side(spread), ["item", "hash"]))
    exact = met.where("words = found").groupBy("id", "item").agg(F.count_distinct("hash").alias("n_exact"))
    # An occurrence has one shift, or some that differ by less than the item's length where words were put in or left out:
    # these meet in one of two rows of stretches. The whole document counts as one occurrence, too.
    shift = F.col("at") - F.col("place")
    kinds = [F.lit(0).cast("long"), shift.cast("long"), F.floor(shift / F.col("length")), F.floor(shift / F.col("length") + 0.5)]
    one = ["id", "item", "kind", "nth"]
    within = met.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("nth")) for k, n in enumerate(kinds)]))).select("*", "o.kind", "o.nth")
    enough = settled(within.groupBy(*one).agg(F.count_distinct("hash").alias("n_met"), F.first("n_windows").alias("n_windows")).where(F.col("n_met") >= coverage * F.col("n_windows")).select(*one))
    slot = F.explode(F.filter(F.transform(F.arrays_zip("words", "found"), lambda s, k: F.struct(s["words"].alias("asked"), s["found"].alias("given"), (F.col("place") + k).alias("place"))), lambda s: s["asked"] < F.lit("\x05")))
    number = F.col("slot.asked").startswith(NUMBER)
    slots = within.join(enough, one, "left_semi").select(*one, slot.alias("slot"))
    slots = slots.select(*one, number.alias("number"), F.col("slot.asked").alias("asked"), F.when(number, F.col("slot.place")).otherwise(-1).alias("place"), F.col("slot.given").alias("given")).distinct()
    by_value = slots.groupBy(*one).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("asked", "place").alias("n_asked"), F.count(F.when(~F.col("number"), 1)).alias("n_named"), F.count_distinct(F.when(~F.col("number"), F.col("given"))).alias("n_given")
    )
    fine = F.col("n_pairs").isNull() | ((F.col("n_pairs") == F.col("n_asked")) & (F.col("n_named") == F.col("n_given")))
    fits = enough.join(by_value, one, "left").groupBy("id", "item").agg(F.max(fine).alias("fits"))
    pairs = suspects.join(exact, ["id", "item"], "left").join(fits, ["id", "item"], "left")
    same = F.coalesce("fits", F.lit(False))
    full = F.coalesce("n_exact", F.lit(0)) / F.col("n_windows")
    pairs = pairs.select("id", "item", (F.col("n_shared") / F.col("n_windows")).alias("coverage"), full.alias("exact"), (same | (full >= coverage)).alias("consistent"))
    verbatim = _verbatim(plain, items, size, coverage)
    if verbatim is None:
        return pairs
    by_template = F.coalesce("consistent", F.lit(False)) | F.col("share").isNull()
    either = [F.when(by_template, F.col(c)).otherwise(F.col("share")).alias(c) for c in ("coverage", "exact")]
    return pairs.join(verbatim, ["id", "item"], "full").select("id", "item", *either, F.when(by_template, F.col("consistent")).otherwise(True).alias("consistent"))


def decontamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, coverage: float = COVERAGE
) -> DataFrame:
    """One row per document: ``id_col``, contaminated, n_items and, of the item most covered, best_item, coverage, exact.

    - contaminated: the document shares ``coverage`` or more of an item's
      windows of ``size`` canonical tokens, and the slots are consistent in
      one occurrence of that coverage, or over the whole document, or that
      share of windows is word for word the same.
    - n_items counts such items; best_item is the one with the greatest
      coverage, of equals the least. Without any, coverage and exact are 0.
    - Windows of placeholders mostly have no template. Items that have such
      windows also match by ``coverage`` of all their windows word for word,
      items of fewer than ``size`` tokens as a whole and word for word.
    - A repeated id counts as one document; null ids are left out. Empty
      tables give nothing, or nothing contaminated. Other columns are ignored.
    """
    pairs = contaminated_pairs(docs, benchmark, id_col, text_col, item_col, item_text_col, size, coverage).where("consistent")
    best = pairs.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("coverage")).alias("least"), "item", "exact")).alias("best"))
    ids = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias(id_col)).distinct()
    return ids.join(small_side(settled(best)), F.col(id_col) == F.col("_id"), "left").select(
        id_col, F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"), F.col("best.item").alias("best_item"),
        F.coalesce(-F.col("best.least"), F.lit(0.0)).alias("coverage"), F.coalesce("best.exact", F.lit(0.0)).alias("exact"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; rows with a null id stay."""
    bad = contaminated_pairs(docs, benchmark, id_col, text_col, **options).where("consistent").select(F.col("id").alias("_bad")).distinct()
    return docs.join(small_side(settled(bad)), docs[id_col] == F.col("_bad"), "left_anti")
