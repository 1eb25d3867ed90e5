"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of n-grams is that of their 64-bit hashes, cut into fragments of equal width; a set falls into segments, one for each fragment.

1. Frequencies of all shingles are counted into a sketch of fixed size. Documents with equal shingle sets form a class; one member stands for it.
2. Candidates. Two sets that reach the threshold differ in d shingles at most, d following from their sizes; of 2 d + 1 fragments they hold at
   least d + 1 alike. Each set emits the hashes of its d + 1 strongest segments as keys (strength: rare shingles, by the sketch; an order of
   contents alone, so two sets drop the same segments first). Any such pair shares a key, whatever is common or hot. The number of fragments
   follows from a class of sizes; a set emits for its class and the next.
3. Blocks. Representatives that share keys, directly or through others, form a cell; a cell of more than BLOCK documents is cut into blocks, and
   documents that share a key's first document stand together. Two blocks meet only if a document of one shares a key with one of the other.
4. Partial overlaps. The segments of all sets in cells are dealt by (pair of blocks, fragment). There n-grams become posting lists, the partial
   overlaps of all pairs are counted, and pairs that can't reach the threshold with all that their sets hold in other fragments are pruned. At least
   FRAGMENTS fragments, and so many that the largest set of a cell has about FRAGMENT shingles in each, so memory is bounded for texts of any length.
5. Sums. The partial overlaps of a pair of blocks meet in one row for each fragment and are summed per pair; the exact test decides. One row for
   each linked document leaves a task, never one for each pair.
6. Linked documents are joined to components.

Keys of very common shingles and keys of classes with many copies are salted, so no key's rows meet in one task; a cell of any size is worked in full.

Nulls and edge cases: a null or empty text, or one without words, has no shingle and links with nothing; its component
is its own id. A text with fewer words than a shingle counts whole as one. Repeated rows are equal sets. Rows that share an id
are one node with the links of all its texts. Rows without an id are returned with component null. An empty table gives
an empty result; extra columns are dropped.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_arrow, discard, small, stored

SKETCH_BITS = 19
SALTS = 32
#: A key all of whose shingles are counted so far above the mean in the sketch is salted.
HOT = 2000
#: Salts of the keys of classes, by which copies find their class.
COPY_SALTS = 16
BLOCK = 256
#: Fragments in which overlaps are counted, at least, and shingles of the largest set of a cell in each, about.
FRAGMENTS, FRAGMENT = 4, 2048
#: Documents in cells whose ids are broadcast to the scan of the texts, at most; beyond that the texts are shuffled.
BROADCAST_DOCS = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, k: int, table: _Hashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; A-Z are lower-cased, words end at \\x20 and \\x09-\\x0D."""
    words = (text or b"").lower().split()  # of bytes: ASCII only, both
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], np.uint64))
    s = h[: len(h) - k + 1] * _ODD[0]
    for i in range(1, k):
        s = s + h[i : len(h) - k + 1 + i] * _ODD[i]
    return np.unique(_mixed(s))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all documents' shingles in 2**SKETCH_BITS buckets: 4 MB, whatever the input."""
    chunk = 1 << (SKETCH_BITS - 4)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _Hashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = [_bucket(shingles(t, k, table)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=1 << SKETCH_BITS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(16)), pa.array([total[i * chunk : (i + 1) * chunk].astype(np.int32).tobytes() for i in range(16)])], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()])], ["chunk", "counts"])

    schema = "chunk bigint, counts binary"
    rows = docs.select("text").mapInArrow(partial, schema).repartition(16, "chunk").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.collect():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] += np.frombuffer(bytes(r["counts"]), np.int64)
    return out


@functools.lru_cache(maxsize=4)
def size_classes(percent: int, top: int = 1 << 40) -> tuple[int, ...]:
    """First sizes of the classes; sets that can link lie in one class or in neighbouring ones."""
    first = [1]
    while first[-1] < top:
        first.append(max(first[-1] + 1, -(-100 * first[-1] // percent)))
    return tuple(first)


def segment_keys(s: np.ndarray, counts: np.ndarray, percent: int, hot: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set, and whether each is hot."""
    if not len(s):
        return s, np.zeros(0, bool)
    first = size_classes(percent)
    own = bisect_right(first, len(s)) - 1
    bucket = counts[_bucket(s)]
    common = bucket > hot
    mean = max(1.0, hot - HOT)
    over = bucket - mean  # about the documents that hold it, where it stands out of the sketch's noise
    weight = np.where(over > 4 * np.sqrt(mean), 1 / np.maximum(over, 1), 1.0)
    keys, warm = [], []
    for g in (own, own + 1):
        d = (100 - percent) * 2 * (first[g + 1] - 1) // (100 + percent)
        m = 2 * d + 1
        fragment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32) if m < 1 << 31 else s // np.uint64((1 << 64) // m + 1)
        fragment = fragment.astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        at = fragment[start]
        content = np.add.reduceat(s, start)
        strength, rare = np.add.reduceat(weight, start), ~np.logical_and.reduceat(common, start)
        key = _mixed(content * _ODD[0] + at.astype(np.uint64) * _ODD[1] + _ODD[2:3] * np.uint64(g + 1))
        if len(at) > d + 1:
            keep = np.lexsort((key, strength))[-(d + 1) :]
        else:  # fewer fragments with shingles than keys: all of them, and empty ones by their place
            keep = np.arange(len(at))
            empty = np.setdiff1d(np.arange(m), at)
            blank = _mixed(empty.astype(np.uint64) * _ODD[1] + _ODD[2:3] * np.uint64(g + 1))
            blank = np.sort(blank)[-(d + 1 - len(at)) :] if d + 1 > len(at) else blank[:0]
            keys.append(blank)
            warm.append(np.ones(len(blank), bool))
        keys.append(key[keep])
        warm.append(~rare[keep])
    return np.concatenate(keys), np.concatenate(warm)


def _keys(docs: DataFrame, k: int, percent: int, counts) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, c = _Hashes(), counts.value
        hot = c.mean() + HOT
        for batch in batches:
            ids, sizes, sets, cold, warm_keys, ends, warm_ends = batch.column(0), [], [], [], [], [0], [0]
            for doc, t in zip(ids.to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                s = shingles(t, k, table)
                head, warm = segment_keys(s if doc is not None else s[:0], c, percent, hot)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                cold.append(head[~warm])
                warm_keys.append(head[warm])
                ends.append(ends[-1] + len(cold[-1]))
                warm_ends.append(warm_ends[-1] + len(warm_keys[-1]))
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate(x).view(np.int64))) for e, x in ((ends, cold), (warm_ends, warm_keys))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), *lists], ["doc", "n", "key", "keys", "hot_keys"])

    return docs.mapInArrow(run, "doc bigint, n bigint, key binary, keys array<bigint>, hot_keys array<bigint>")


def _stars(first: DataFrame) -> DataFrame:
    """Rows (doc, centre): representatives with a common key, doc itself and the smallest of them. Those that share a key share its centre."""
    post = first.select("doc", F.size("keys").alias("n"), F.posexplode(F.concat("keys", "hot_keys")).alias("pos", "token"))
    post = post.select("doc", "token", F.when(F.col("pos") < F.col("n"), 0).otherwise(1 + F.pmod("doc", F.lit(SALTS))).cast("int").alias("salt"))
    run = Window.partitionBy("token", "salt").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = stored(post.withColumn("centre", F.first("doc").over(run)).where("doc <> centre or salt > 0"), "join-runs")
    hot = stored(runs.where("salt > 0").groupBy("token").agg(F.min("centre").alias("least"), F.max("doc").alias("last")).where("least <> last").drop("last"), "join-hot")
    hot = runs.where("salt > 0").join(small(hot, BROADCAST_DOCS), "token").select("doc", F.col("least").alias("centre"))
    out = stored(runs.where("salt = 0").select("doc", "centre").unionByName(hot).distinct(), "join-stars")
    discard(runs)
    return out


def _blocks(cells: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """cells (doc, cell, copies, n) to (doc, block, copies, fragments), and the pairs of blocks that share a centre, as all do that share a key, as (block, b1, b2, side); a block that isn't named there meets itself only."""
    fragments = F.greatest(F.lit(FRAGMENTS), F.ceil(F.max("n") / FRAGMENT)).cast("int").alias("fragments")
    stats = stored(cells.groupBy("cell").agg(F.count("*").alias("m"), fragments), "join-cell-sizes")
    placed = stored(cells.join(stats, "cell").select("doc", "cell", "copies", "fragments", "m"), "join-placed")
    inside = placed.where(F.col("m") <= BLOCK).select("doc", F.col("cell").alias("block"), "copies", "fragments")
    large = placed.where(F.col("m") > BLOCK)
    if not stats.where(F.col("m") > BLOCK).limit(1).count():
        return inside, None
    both = stars.unionByName(stars.select(F.col("centre").alias("doc"), "centre").distinct()).distinct()
    members = stored(both.join(small(large.select("doc", "cell"), BROADCAST_DOCS), "doc"), "join-members")
    homes = stored(members.groupBy("doc", "cell").agg(F.min("centre").alias("home")), "join-homes")
    sizes = homes.groupBy("cell", "home").agg(F.count("*").alias("c"))
    # homes of half a block or more are cut, smaller ones share blocks
    wide = sizes.where(F.col("c") >= BLOCK // 2).select("cell", "home", F.ceil(F.col("c") / BLOCK).alias("parts"))
    narrow = sizes.where(F.col("c") < BLOCK // 2).groupBy("cell").agg(F.ceil(F.sum("c") / BLOCK).alias("shared"))
    blocks = homes.join(small(stored(wide, "join-wide"), BROADCAST_DOCS), ["cell", "home"], "left").join(small(stored(narrow, "join-narrow"), BROADCAST_DOCS), "cell", "left")
    name = F.when(F.col("parts").isNotNull(), F.xxhash64("cell", "home", F.pmod(F.xxhash64("doc"), F.col("parts")))).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("home"), F.col("shared"))))
    blocks = stored(blocks.select("doc", name.alias("block")), "join-blocks")
    met = members.join(small(blocks, BROADCAST_DOCS), "doc").groupBy("centre").agg(F.collect_set("block").alias("all"))  # a block for BLOCK documents
    pairs = met.select("all").distinct().select(F.explode("all").alias("b1"), "all").select("b1", F.explode(F.filter("all", lambda x: x >= F.col("b1"))).alias("b2")).distinct()
    sides = F.when(F.col("b1") == F.col("b2"), F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side")))
    )
    pairs = stored(pairs.select("b1", "b2", F.explode(sides).alias("x")).select("x.block", "b1", "b2", "x.side"), "join-block-pairs")
    return inside.unionByName(large.join(blocks, "doc").select("doc", "block", "copies", "fragments")), pairs


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def partial_overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all segments of left with all of right (of left with itself where right is None)."""
    sets = left if right is None else left + right
    if len(sets) == 2:
        one = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[one]]) if right is not None else np.array([[len(sets[0]), one], [one, len(sets[1])]])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.flatnonzero(n > 1)
    column = np.full(len(n), -1)
    column[shared] = np.arange(len(shared))
    at = column[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")  # posting lists
    row, at = row[order], at[order]
    total = np.zeros((len(left), len(left) if right is None else len(right)), np.float64)
    for start in range(0, len(shared), FRAGMENT):
        a, b = np.searchsorted(at, (start, start + FRAGMENT))
        part = np.zeros((len(sets), min(FRAGMENT, len(shared) - start)), np.float32)
        part[row[a:b], at[a:b] - start] = 1
        x = part[: len(left)]
        total += x @ (x if right is None else part[len(left) :]).T
    return total.astype(np.int64)


def counted(group: list[tuple], same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """group: (side, node, doc, copies, n, segment) by side and node. The people (node, doc, copies, n) and the pairs (i, j, partial overlap) of one fragment that may still link, i and j places in people."""
    group = [g for i, g in enumerate(group) if not i or g[:2] != group[i - 1][:2]]
    cut = len(group) if same else sum(not g[0] for g in group)
    none = np.zeros((0, 4), np.int64), np.zeros((0, 3), np.int32)
    if len(group) < 2 or not cut or (not same and cut == len(group)):
        return none
    people = np.array([g[1:5] for g in group], np.int64)
    got = partial_overlaps([g[5] for g in group[:cut]], None if same else [g[5] for g in group[cut:]])
    n, rest = people[:, 3], people[:, 3] - np.array([len(g[5]) for g in group])
    other = slice(0, cut) if same else slice(cut, None)
    total = n[:cut, None] + n[None, other]
    best = got + np.minimum(rest[:cut, None], rest[None, other])  # the overlap if all that lies in other fragments is alike
    may = (got > 0) & ((100 + percent) * best >= percent * total) & (people[:cut, :1] != people[None, other, 0])
    i, j = np.nonzero(np.triu(may, 1) if same else may)
    if not len(i):
        return none
    pairs = np.stack([i, j + (0 if same else cut), got[i, j]], 1)
    used, flat = np.unique(pairs[:, :2], return_inverse=True)
    pairs[:, :2] = flat.reshape(-1, 2)
    return people[used], pairs.astype(np.int32)


def summed(parts: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple]:
    """Sum the partial overlaps of all fragments per pair; rows (doc, root, links) of the documents that have a link."""
    people, where = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
    where, size = where.reshape(-1), len(people)
    keys, counts, at = [], [], 0
    for own, pairs in parts:
        place = where[at : at + len(own)]
        keys.append(place[pairs[:, 0]] * size + place[pairs[:, 1]])
        counts.append(pairs[:, 2])
        at += len(own)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.bincount(back.reshape(-1), np.concatenate(counts), len(key)).astype(np.int64)
    i, j = key // size, key % size
    n = people[:, 3]
    link = 100 * both >= percent * (n[i] + n[j] - both)
    i, j = i[link], j[link]
    links = (np.bincount(i, people[j, 2], size) + np.bincount(j, people[i, 2], size)).astype(np.int64)
    parent = np.arange(size)
    for a, b in zip(i.tolist(), j.tolist()):
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[b] = a
    linked = np.flatnonzero(links)
    roots = [_find(parent, k) for k in linked.tolist()]
    low: dict[int, int] = {}
    for k, r in zip(linked.tolist(), roots):
        doc = int(people[k, 1])
        low[r] = min(low.get(r, doc), doc)
    return [(int(people[k, 1]), low[r], int(links[k])) for k, r in zip(linked.tolist(), roots)]


_SEGMENTS = "block bigint, fragment int, node bigint, doc bigint, copies bigint, n bigint, segment binary"
_PARTS = "b1 bigint, b2 bigint, people binary, pairs binary"


def _links(docs: DataFrame, cells: DataFrame, pairs: DataFrame | None, k: int, percent: int) -> DataFrame:
    """docs (doc, text), cells (doc, block, copies, fragments), pairs (block, b1, b2, side) to rows (doc, root, links)."""

    def batches_of(rows: Iterator[tuple], schema: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
        some, held = [], 0
        for r in rows:
            some.append(r)
            held += 64 + sum(len(x) for x in r if isinstance(x, bytes))
            if held >= most:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)
                some, held = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = _Hashes()
            for batch in batches:
                for doc, text, block, copies, m in zip(*[(c.cast(pa.binary()) if i == 1 else c).to_pylist() for i, c in enumerate(batch.columns)]):
                    s = shingles(text, k, table)
                    node = int(_mixed(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), doc & 0xFFFFFFFF)], np.uint64)).view(np.int64)[0])
                    ends = np.searchsorted(s, np.array([(f << 64) // m for f in range(1, m)], np.uint64)).tolist()
                    for f, (a, b) in enumerate(zip([0, *ends], [*ends, len(s)])):
                        if a < b:
                            yield block, f, node, doc, copies, len(s), s[a:b].tobytes()

        yield from batches_of(rows(), _SEGMENTS)

    def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
        """Rows that agree in the first `width` columns, as they stand together."""
        key, group = None, []
        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns]):
                if row[:width] != key:
                    if group:
                        yield key, group
                    key, group = row[:width], []
                group.append(row[width:])
        if group:
            yield key, group

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (b1, b2, _), group in grouped(batches, 3):
                people, found = counted([(*g[:5], np.frombuffer(g[5], np.uint64)) for g in group], b1 == b2, percent)
                if len(found):
                    yield b1, b2, people.tobytes(), found.tobytes()

        yield from batches_of(rows(), _PARTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in grouped(batches, 2):
                yield from summed([(np.frombuffer(p, np.int64).reshape(-1, 4), np.frombuffer(x, np.int32).reshape(-1, 3)) for p, x in group], percent)

        yield from batches_of(rows(), "doc bigint, root bigint, links bigint")

    rows = docs.join(cells, "doc").select("doc", "text", "block", "copies", "fragments").mapInArrow(cut, _SEGMENTS)
    if pairs is None:
        rows = rows.withColumns({"b1": F.col("block"), "b2": F.col("block"), "side": F.lit(0)})
    else:
        rows = rows.join(small(pairs, BROADCAST_DOCS), "block", "left").withColumns({"b1": F.coalesce("b1", "block"), "b2": F.coalesce("b2", "block"), "side": F.coalesce("side", F.lit(0))})
    key = ["b1", "b2", "fragment"]
    rows = rows.select(*key, "side", "node", "doc", "copies", "n", "segment").repartition(*key).sortWithinPartitions(*key, "side", "node")
    parts = rows.mapInArrow(count, _PARTS).repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    return parts.mapInArrow(add, "doc bigint, root bigint, links bigint")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(COPY_SALTS)))


def _for_all_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPY_SALTS - 1).cast("bigint"))))


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, n_links (documents linked with it, equal sets included)."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(frequencies(docs, k))
    keyed = stored(_keys(docs, k, percent, counts), "join-keys")
    heads = stored(keyed.select("doc", "n", "key"), "join-heads")
    classes = heads.where("key is not null and doc is not null").groupBy("key").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = stored(classes, "join-classes")
    several = _for_all_salts(classes.where("copies > 1").select("key", "rep"))
    copied = stored(_salted(heads).join(several, ["key", "salt"]).where("doc <> rep").select("key", "doc").distinct(), "join-copied")
    first = keyed.where("doc is not null").join(small(copied, BROADCAST_DOCS), ["key", "doc"], "left_anti").select("doc", "keys", "hot_keys")
    stars = _stars(first)
    discard(keyed)
    inside = components(stars.select(F.col("doc").alias("a"), F.col("centre").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("cell"))
    each = classes.groupBy(F.col("rep").alias("doc")).agg(F.max("copies").alias("copies"), F.max("n").alias("n"))
    cells, pairs = _blocks(stored(inside.join(each, "doc"), "join-cells"), stars)
    cells = small(stored(cells, "join-dealt"), BROADCAST_DOCS)
    discard(stars)
    links = stored(_links(docs, cells, pairs, k, percent), "join-links")
    found = components(links.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    per = links.groupBy("doc").agg(F.sum("links").alias("links")).join(found.withColumnRenamed("node", "doc"), "doc")
    info = classes.join(per.withColumnRenamed("doc", "rep"), "rep", "left").where("copies > 1 or links is not null")
    info = info.select("key", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    info = _for_all_salts(stored(info, "join-info"))
    rows = _salted(heads.select("doc", "n", F.coalesce("key", F.encode(F.col("doc").cast("string"), "UTF-8")).alias("key")))  # no hot null key
    return rows.join(info, ["key", "salt"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
