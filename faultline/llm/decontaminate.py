"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words of benchmark items and of documents become templates: names, numbers and units after a number turn into typed placeholders, so
a re-parameterised question has the template of its original. What is a name depends on capitals and spaces, so each window comes in a second form too, as
plain lower-cased words, by which a verbatim passage is found however it is capitalised or wrapped. All windows of WINDOW words of all documents, in both forms, are probed
against the benchmark's by one hash join on 64-bit hashes. Windows that meet at one alignment of a document and an item are one
occurrence; it falls into runs, stretches whose every word is in such a window. A run is consistent if each value of the item stands for one value of the document throughout.
In one that isn't, windows whose slots differ can't convict, and those that hold a value with several counterparts don't count. A window whose slots are all equal convicts whatever it is made of. A re-parameterised one of placeholders alone can't: one window of such an occurrence needs MIN_FIXED fixed words.
An item dense in slots, which has no such window ("What is 12 + 30 + ..."), is met as a whole: where a window of it with LEAST_FIXED fixed words is found, the template of
the whole item is compared with the document's words there, and convicts if it is equal and its slots are consistent. Items with fewer fixed words than that in every window, mere lists of numbers or names, are found by equal values only.

The benchmark's windows are broadcast while they number at most BROADCAST_WINDOWS; beyond that the join shuffles hashes, never texts.

Nulls and edge cases: a null or empty text, of a document or an item, has no window. An item with fewer words than a window is
one window of its own length. Documents without an id are left out, as the result names documents. Repeated items or documents act as one.
Empty tables give no rows. Extra columns are dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stored

WINDOW = 8
#: Fixed words that one window of a re-parameterised occurrence needs, and that every window whose slots differ needs to take part in the slot check.
MIN_FIXED, LEAST_FIXED = 4, 2
#: Rows of about 100 bytes.
BROADCAST_WINDOWS = 400_000

#: Units that count as slots after a number.
UNITS = "mm|cm|m|km|mg|g|kg|t|ml|l|s|sec|min|h|hr|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inches|pounds?|lbs?|dollars?|euros?|cents?|percent|mph"

_NAME_MARK, _NUMBER_MARK, _UNIT_MARK = "\ue001", "\ue002", "\ue003"
_MARKS = "\ue001-\ue003"
# Each begins with the character that is rarest in a text, so that the search fails fast.
#: A capitalised word within a sentence.
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},] \p{Lu})\p{Ll}+(?!\p{L})"
_NUMBER = r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,:/][0-9]+)*"
_UNIT = rf"({_NUMBER_MARK}[0-9.,:/]+ ?)({UNITS})(?!\p{{L}})"
#: Least and greatest logarithm of the bits of the filter that windows pass before they become rows; 16 bits for each benchmark window
#: between. It only spares rows: the join decides.
FILTER_BITS = 16, 23


def marked(text: Column) -> Column:
    """The text with a mark before each name, number and unit, without marks of its own and without punctuation."""
    x = text
    for mark in (_NAME_MARK, _NUMBER_MARK, _UNIT_MARK):
        x = F.replace(x, F.lit(mark), F.lit(""))
    x = F.regexp_replace(x, F.lit(_NAME), F.lit(f"{_NAME_MARK}$0"))
    x = F.regexp_replace(x, F.lit(_NUMBER), F.lit(f"{_NUMBER_MARK}$0"))
    x = F.when(x.contains(_NUMBER_MARK), F.regexp_replace(x, F.lit(_UNIT), F.lit(f"$1{_UNIT_MARK}$2"))).otherwise(x)
    return F.lower(F.regexp_replace(x, F.lit(rf"[^\p{{L}}\p{{M}}\p{{N}}{_MARKS}\x20\x09-\x0D]+"), F.lit("")))


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+", -1)


def _has_mark(x: Column) -> Column:
    return x.contains(_NAME_MARK) | x.contains(_NUMBER_MARK) | x.contains(_UNIT_MARK)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def hashed(rows: DataFrame, keep: str, length: int, whole: bool = False) -> DataFrame:
    """One row for each text: keep, p (hashes of its windows of `length` plain words), t (of template words; null without any slot), v (slot values by
    word, null where there is none). whole: only texts of just that length."""
    # no filter on computed columns: the optimiser would compute them again below it
    rows = rows.select(keep, marked(F.coalesce("text", F.lit(""))).alias("m"))
    rows = rows.select(keep, "m", _has_mark(F.col("m")).alias("has"))
    template = F.regexp_replace("m", F.lit(f"([{_MARKS}])[^{_MARKS}\\x20\\x09-\\x0D]*"), F.lit("$1"))
    plain = F.when(F.col("has"), F.translate("m", _NAME_MARK + _NUMBER_MARK + _UNIT_MARK, "")).otherwise(F.col("m"))
    rows = rows.select(keep, _words(plain).alias("p"), F.when(F.col("has"), _words(F.col("m"))).alias("w"), F.when(F.col("has"), _words(template)).alias("t"))
    fits = (F.size("p") == length if whole else F.size("p") >= length) & (F.element_at("p", 1) != "")
    rows = rows.select(
        keep, F.when(fits, F.transform("p", lambda w: F.xxhash64(w))).alias("p"), F.when(fits, F.transform("t", lambda w: F.xxhash64(w))).alias("t"), F.transform("w", lambda w: F.when(_has_mark(w), w)).alias("v")
    )
    places = F.sequence(F.lit(1), F.size("p") - (length - 1))

    def ends(h: str) -> Column:
        return F.when(F.col(h).isNotNull(), F.transform(places, lambda i: F.xxhash64(F.slice(h, i, length))))

    return rows.select(keep, F.coalesce(ends("p"), _none("bigint")).alias("p"), ends("t").alias("t"), "v")


def _places() -> Column:
    return F.when(F.size("p") > 0, F.sequence(F.lit(1), F.size("p"))).otherwise(_none("int"))


def doc_windows(docs: DataFrame, length: int, bits: list[int]) -> DataFrame:
    """One row for each window whose hash is set in the filter: doc_id, at (from 0), hash, slots. A window with slots comes in both forms, the plain one with null for slots."""
    mask, table = 64 * len(bits) - 1, F.from_json(F.lit(json.dumps(bits)), "array<bigint>")  # folded to a constant

    def passes(x: Column) -> Column:
        slot = x.bitwiseAND(mask)
        return F.getbit(F.element_at(table, (F.shiftright(slot, 6) + 1).cast("int")), slot.bitwiseAND(63).cast("int")) == 1

    def window(h: str, slots: Column):
        return lambda i: F.struct((i - 1).alias("at"), F.element_at(h, i).alias("hash"), slots(i).alias("slots"))

    plain = F.transform(F.filter(_places(), lambda i: passes(F.element_at("p", i))), window("p", lambda i: F.lit(None).cast("array<string>")))
    # a window without slots has the same hash in both forms
    template = F.transform(F.filter(_places(), lambda i: (F.element_at("t", i) != F.element_at("p", i)) & passes(F.element_at("t", i))), window("t", lambda i: F.slice("v", i, length)))
    both = F.when(F.col("t").isNull(), plain).otherwise(F.concat(plain, template))
    return hashed(docs, "doc_id", length).select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.at", "x.hash", "x.slots")


def item_windows(items: DataFrame, length: int, whole: bool) -> DataFrame:
    """One row for each window and form: item_id, item_at (from 0), hash, same (the plain form), item_slots, fixed (number of fixed words)."""
    rows = hashed(items, "item_id", length, whole).select("item_id", "t", "v", F.posexplode("p").alias("item_at", "p"))
    slots = F.slice("v", F.col("item_at") + 1, F.lit(length))
    rows = rows.select("item_id", "item_at", "p", F.coalesce(F.element_at("t", F.col("item_at") + 1), "p").alias("t"), slots.alias("item_slots"))
    fixed = length - F.coalesce(F.size(F.filter("item_slots", lambda x: x.isNotNull())), F.lit(0))
    forms = F.array(F.struct(F.col("p").alias("hash"), F.lit(True).alias("same")), F.struct(F.col("t").alias("hash"), F.lit(False).alias("same")))
    rows = rows.select("item_id", "item_at", "item_slots", fixed.alias("fixed"), F.explode(F.when(F.col("t") == F.col("p"), F.slice(forms, 1, 1)).otherwise(forms)).alias("x"))
    return rows.select("item_id", "item_at", "x.hash", "x.same", "item_slots", "fixed")


def _filter(own: DataFrame, windows: int) -> list[int]:
    """The windows' hashes as bits of 64-bit numbers; the driver reads a row for each number that isn't 0, 2**FILTER_BITS[1] / 64 at most."""
    size = 1 << min(max((16 * windows).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.col("hash").bitwiseAND(size - 1)
    rows = own.groupBy(F.shiftright(slot, 6).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("b")).collect()
    bits = [0] * (size // 64)
    for r in rows:
        bits[r["k"]] = r["b"]
    return bits


def _worded(rows: DataFrame, keep: str) -> DataFrame:
    """keep, t (a hash of each word's template), v (slot values by word)."""
    return hashed(rows, keep, 1).select(keep, F.coalesce("t", "p").alias("t"), "v")


def whole_items(docs: DataFrame, items: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Of places (doc_id, item_id, shift) those at which a document has the template of the whole item, with consistent slots: doc_id, item_id, n, exact, item_windows."""
    wanted = _worded(items.join(places.select("item_id").distinct(), "item_id", "left_semi"), "item_id").select("item_id", F.col("t").alias("item_t"), F.col("v").alias("item_v"))
    held = _worded(docs.join(small(stored(places.select("doc_id").distinct(), "held")), "doc_id", "left_semi"), "doc_id")
    at, n = F.col("shift") + 1, F.size("item_t")
    rows = places.where("shift >= 0").join(wanted, "item_id").join(held, "doc_id").where(F.slice("t", at, n) == F.col("item_t"))
    pairs = F.arrays_zip(F.col("item_v").alias("b"), F.slice("v", at, n).alias("d"))
    pairs = F.array_distinct(F.filter(pairs, lambda p: p["b"].isNotNull()))
    rows = rows.where(F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs))
    windows = (n - window + 1).cast("bigint")
    return rows.select("doc_id", "item_id", windows.alias("n"), F.lit(False).alias("exact"), windows.alias("item_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document and item that meet: doc_id, item_id, n_windows (consistent ones of the best alignment), item_windows, exact (no slot differs)."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    size = F.size(_words(marked(F.col("text"))))
    lengths = [r[0] for r in items.where("text is not null").select(F.least(size, F.lit(window)).alias("n")).distinct().collect()]  # `window` values at most
    found = dense = None
    for length in sorted(lengths):
        own = item_windows(items, length, whole=length < window)
        own = own.withColumn("strong", F.col("fixed") >= min(MIN_FIXED, -(-length // 2)))
        own = own.withColumn("dense", ~F.bool_or("strong").over(Window.partitionBy("item_id"))).where(F.col("same") | F.col("strong") | (F.col("fixed") >= LEAST_FIXED)).drop("fixed")
        own = stored(own.withColumn("item_windows", F.count_if("same").over(Window.partitionBy("item_id"))), "items")
        n = own.count()
        bits = _filter(own, n)
        if length == window:
            dense = own.where("dense and not same").select("item_id").distinct()
        own = own.drop("dense")
        if n <= BROADCAST_WINDOWS:
            own = F.broadcast(own)
        hit = doc_windows(docs, length, bits).join(own, "hash")
        # a plain hit has the item's own values; a template hit with these is found as a plain one too
        hit = hit.withColumn("slots", F.when(F.col("same"), F.col("item_slots")).otherwise(F.col("slots"))).where("same or not (slots <=> item_slots)")
        hit = hit.select("doc_id", "item_id", "item_windows", (F.col("at") - F.col("item_at")).alias("shift"), F.struct("item_at", "same", "strong", "item_slots", "slots").alias("x"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("item_windows"), F.lit(True).alias("exact")).where("false")
    whole = None
    if dense is not None and dense.limit(1).count():
        found = stored(found, "hits")
        places = stored(found.where("not x.same").select("doc_id", "item_id", "shift").distinct().join(dense, "item_id", "left_semi"), "places")
        whole = whole_items(docs, items, places, window)
    # an occurrence has a window for each place of the item at most, repeated documents included
    one = found.groupBy("doc_id", "item_id", "shift").agg(F.max("item_windows").alias("item_windows"), F.collect_set("x").alias("x"))
    rows = one.select("doc_id", "item_id", "shift", "item_windows", F.explode("x").alias("x")).select("doc_id", "item_id", "shift", "item_windows", "x.*")
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")), lambda p: p["b"].isNotNull())
    by = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_at")
    # a run ends where a word is in no window
    rows = rows.withColumn("p", F.coalesce(pairs, F.array())).withColumn("first", (F.col("item_at") - F.lag("item_at").over(by) > window).cast("int"))
    rows = rows.withColumn("run", F.coalesce(F.sum("first").over(by), F.lit(0)))
    runs = rows.groupBy("doc_id", "item_id", "shift", "run").agg(F.max("item_windows").alias("item_windows"), F.collect_list(F.struct("item_at", "same", "strong", "p")).alias("x"))
    runs = runs.withColumn("b", F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("x", lambda x: x["p"]))), lambda p: p["b"])))
    runs = runs.withColumn("clash", F.filter("b", lambda b, i: F.coalesce(b == F.get("b", i - 1), F.lit(False))))  # values that meet several
    kept = F.filter("x", lambda x: x["same"] | ~F.arrays_overlap(F.transform(x["p"], lambda p: p["b"]), F.col("clash")))
    met = F.exists("x", lambda x: x["same"]) | ((F.size("clash") == 0) & F.exists("x", lambda x: x["strong"]))
    runs = runs.withColumns({"n": F.size(F.array_distinct(F.transform(kept, lambda x: x["item_at"]))).cast("bigint"), "met": met, "exact": F.forall("x", lambda x: x["same"])})
    one = runs.groupBy("doc_id", "item_id", "shift").agg(F.sum("n").alias("n"), F.bool_and("exact").alias("exact"), F.max("item_windows").alias("item_windows"), F.bool_or("met").alias("met")).where("met")
    if whole is not None:
        one = one.select("doc_id", "item_id", "n", "exact", "item_windows").unionByName(whole)
    best = F.max(F.struct("n", "exact", "item_windows"))
    return one.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", F.col("item_id").cast("bigint"), F.col("b.n").alias("n_windows"), F.col("b.item_windows").alias("item_windows"), F.col("b.exact").alias("exact"))
