"""Mixing sources to target weights: a low-discrepancy schedule of equal blocks, in DataFrame expressions only.

Weights. Sources in order of their code points, null last, weigh WEIGHTS in turn. Targets share the words of all sources by weight, none above CAP times its
source's words; the excess goes to the others by weight (water filling, in closed form over sources sorted by the level at which they are full).

Schedule. Slot k has the van der Corput point of k, its low 32 bits reversed. Cumulative shares cut the 32-bit range into one interval a source, and the slot
belongs to the source whose interval holds its point. A slot's rank among those of its source is the number of earlier points in the interval. Earlier slots
are at most 32 aligned runs of 2^i slots, whose points lie evenly, so this number is a sum of 32 quotients: no window, no order, no shuffle.

Blocks. A source's documents, shuffled by a hash of their id, form a stream of words that repeats as often as the target asks. Slot of rank j takes words
[j BLOCK, (j + 1) BLOCK) of it, cut at the target, so each source takes its target but for a fraction of a word, and no document more than CAP times its
size. A source that got fewer slots than its target needs (low discrepancy: a few) has the rest at the end; slots beyond a source's need are left out.

Places in a stream come from sums within buckets of about 256 documents by hash, buckets within groups of 256, and groups within the source, so no task
gathers a source. Equal rows are counted first. Moved: about 40 bytes a document, three times.

Edge cases: null and empty texts have no words, are taken 0 times and stay in the result; a null source is a source, and so is an empty name; null and
repeated ids are fine (equal rows share the takes as they come); an empty table gives none; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stored

WEIGHTS, CAP = (5, 2, 1), 3
#: Words of a slot.
BLOCK = 4096
#: Documents of a bucket, about; buckets of a group.
BUCKET, GROUP_BITS = 256, 8
#: Equal rows are counted in so many parts, so that the parts can be told apart again by many tasks.
COPIES = 4096
#: Sources up to so many are broadcast; beyond, they are joined in SALTS parts each.
SOURCES, SALTS = 100_000, 64

#: The number of van der Corput points of slots 0 to k - 1 that lie in [lo, hi). State: the number, the bits of k above the current one, reversed.
_RANK = """aggregate(sequence(31, 0, -1), named_struct('r', 0L, 'd', 0L), (a, i) -> if((shiftright({k}, i) & 1L) = 1L, named_struct(
    'r', a.r + shiftright(hi - a.d + shiftleft(1L, 32 - i) - 1L, 32 - i) - shiftright(lo - a.d + shiftleft(1L, 32 - i) - 1L, 32 - i),
    'd', a.d + shiftleft(1L, 31 - i)), a), a -> a.r + shiftright({k}, 32) * (hi - lo))"""


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def reversed_bits(k: Column) -> Column:
    """The low 32 bits of a long in reverse order."""
    x = k.bitwiseAND(0xFFFFFFFF)
    for width, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(mask), width).bitwiseOR(F.shiftright(x, width).bitwiseAND(mask))
    return x


def sized(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """source, doc_id, size, h (60 bits that shuffle), salt, n (equal rows). Stored, as all that follows starts from it."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(COPIES)).cast("int")
    rows = docs.select("source", "doc_id", (words(F.col("text")) if size is None else size).alias("size"), h.alias("h"), salt.alias("salt"))
    return stored(rows.groupBy("source", "doc_id", "size", "h", "salt").agg(F.count("*").alias("n")), "mix-sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: source_no, source_size, weight, target, need (whole words), slots, lo and hi of its interval, n_docs."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    order, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    number = F.row_number().over(order) - 1
    per = per.withColumn("source_no", number.cast("bigint"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    # the level at which a source is full is CAP * source_size / weight; those before it in this order are full
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    full = CAP * F.col("source_size").cast("double")
    room = (F.sum("source_size").over(everything) - F.coalesce(F.sum(CAP * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double")
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumns({"_room": room, "_rest": rest, "_at": F.row_number().over(fill)})
    level = F.min_by(F.col("_room") / F.col("_rest"), F.when(F.col("_room") * F.col("weight") <= full * F.col("_rest"), F.col("_at"))).over(everything)
    per = per.withColumn("target", F.coalesce(F.least(level * F.col("weight"), full), F.lit(0.0))).drop("_room", "_rest", "_at")
    per = per.withColumn("need", F.floor("target")).withColumn("slots", F.expr(f"(need + {BLOCK - 1}) div {BLOCK}"))
    first, total = F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum("slots").over(everything)
    point = lambda place: F.when(total > 0, F.floor(place / total * float(1 << 32))).otherwise(0).cast("bigint")
    return stored(per.withColumns({"lo": point(first), "hi": point(first + F.col("slots"))}), "mix-sources")


def schedule(sources: DataFrame) -> DataFrame:
    """slot, source_no, rank: each rank below a source's number of slots once. Slots that find their source satisfied are missing."""
    spark = sources.sparkSession
    known = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    n, bits = known["n"], min(30, max(10, (4 * known["sources"]).bit_length()))
    cells = sources.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(lo, {32 - bits}), shiftright(hi - 1, {32 - bits}))")))
    points = spark.range(0, n, 1, max(1, -(-n // 65536))).select(F.col("id").alias("slot"), reversed_bits(F.col("id")).alias("x"))
    points = points.withColumn("cell", F.shiftright("x", 32 - bits)).join(cells.select("cell", "source_no", "lo", "hi", "slots"), "cell").where("lo <= x and x < hi")
    dealt = points.withColumn("rank", F.expr(_RANK.format(k="slot"))).where("rank < slots").select("slot", "source_no", "rank")
    left = sources.withColumn("had", F.least("slots", F.expr(_RANK.format(k=f"{n}L"))))
    before = F.coalesce(F.sum(F.col("slots") - F.col("had")).over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = left.withColumn("before", before).where("slots > had").withColumn("rank", F.explode(F.expr("sequence(had, slots - 1)")))
    return dealt.unionByName(rest.select((F.lit(n) + F.col("before") + F.col("rank") - F.col("had")).alias("slot"), "source_no", "rank"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (source) with the columns of their source. Many sources are joined in parts, as one may hold a third of all rows."""
    renamed = sources.withColumnRenamed("source", "_source")
    if sources.count() <= SOURCES:
        return rows.join(small(renamed), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    parts = renamed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("h", "salt"), F.lit(SALTS)).cast("int"))
    return dealt.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_part"))).drop("_source", "_salt", "_part")


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with `start`, its first word's place in its source's stream, and the columns of its source."""
    rows = _with_source(sizes, sources.drop("lo", "hi", "slots", "weight"))
    rows = rows.withColumn("bucket", F.expr(f"shiftright(shiftright(h, 28) * ((n_docs + {BUCKET - 1}) div {BUCKET}), 32)"))
    here = lambda *keys: Window.partitionBy(*keys)
    before = lambda value, keys, order: F.coalesce(F.sum(value).over(here(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = rows.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("held")).withColumn("group", F.shiftright("bucket", GROUP_BITS))
    groups = buckets.groupBy("source_no", "group").agg(F.sum("held").alias("all")).withColumn("_far", before("all", ["source_no"], ["group"]))
    buckets = buckets.withColumn("_near", before("held", ["source_no", "group"], ["bucket"])).join(groups, ["source_no", "group"])
    buckets = buckets.select("source_no", "bucket", (F.col("_near") + F.col("_far")).alias("_before"))
    rows = rows.withColumn("_in", before(F.col("size") * F.col("n"), ["source_no", "bucket"], ["h", "doc_id", "size", "salt"]))
    rows = rows.join(buckets, ["source_no", "bucket"]).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return rows.withColumn("start", F.col("_before") + F.col("_in") + F.col("_copy") * F.col("size")).select(
        "source", "source_no", "source_size", "target", "need", "doc_id", "size", "start"
    )


def source_mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """The mix as pieces of documents: slot, at (place in the slot), source, source_no, source_size, target, doc_id, size, start (place in the source's
    stream), word (first word of the document) and length. In order of slot and at it is the training order. A document that the mix doesn't take has one row with a null slot and length 0.

    size: the size of a document, a long, words of its text unless given."""
    sizes = sized(docs, size)
    sources = targets(sizes)
    placed = streams(sizes, sources)
    taken = placed.where("size > 0 and start < need").withColumn("_cycle", F.explode(F.expr("sequence(0L, (need - 1 - start) div source_size)")))
    taken = taken.withColumn("_p", F.expr("_cycle * source_size + start")).withColumn("_e", F.expr("least(_p + size, need)"))
    taken = taken.withColumn("rank", F.explode(F.expr(f"sequence(_p div {BLOCK}, (_e - 1) div {BLOCK})")))
    taken = taken.withColumn("_b", F.expr(f"greatest(_p, rank * {BLOCK})")).withColumn("length", F.expr(f"least(_e, (rank + 1) * {BLOCK}) - _b"))
    taken = taken.withColumns({"word": F.col("_b") - F.col("_p"), "at": F.col("_b") - F.col("rank") * BLOCK}).join(schedule(sources), ["source_no", "rank"])
    kept = ["slot", "at", "source", "source_no", "source_size", "target", "doc_id", "size", "start", "word", "length"]
    none = F.lit(None).cast("bigint")
    rest = placed.where("size <= 0 or start >= need").withColumns({"slot": none, "at": none, "word": none, "length": F.lit(0).cast("bigint")})
    return taken.select(*kept).unionByName(rest.select(*kept))


def taken_words(mix: DataFrame) -> DataFrame:
    """A row for each document of a mix: doc_id, size, source_size, target, taken. Documents without words are told apart by no place, so they pass as they are."""
    out = ["doc_id", "size", "source_size", "target"]
    some = mix.where("slot is not null").groupBy("source_no", "start", *out).agg(F.sum("length").alias("taken")).select(*out, "taken")
    return some.unionByName(mix.where("slot is null").select(*out, F.col("length").alias("taken")))
