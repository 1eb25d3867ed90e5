"""Quality rules by compression bands.

The zstandard ratio (UTF-8 bytes over compressed bytes) of a whole document and of its fixed chunks must lie in the band of its
length: text above it repeats itself, text below it is noise. The bands are fitted to the documents themselves. Texts that pass the
base rule, each distinct one once, are counted by length class (a quarter of an octave of bytes) and ratio (half a per cent), and a
class's band is the median of its ratios and its neighbours', give or take WIDTH deviations (median absolute ones) and at
least LEAST_BELOW and LEAST_ABOVE of it. So a band follows what is usual for a length, and moves only if most texts of several classes do.
Texts are read once; the measures, some 100 bytes for each document and 4 for each chunk, are stored, counted and judged.

Nulls and edge cases: a null or empty text, or one without words, has counts of 0 and ratio null and fails the base
rule. A chunk under MIN_CHUNK bytes (the end of a text) isn't judged apart. A class with under CLASS_TEXTS texts has the band WIDE, as
in a small table. Repeated rows give repeated results; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_arrow, stored

LEVEL = 3
CHUNK = 4096
MIN_CHUNK = 1024
#: Share of judged chunks that may lie outside their band.
CHUNK_SHARE = 0.25
#: Length classes of an octave, and neighbours on each side whose medians count too.
CLASSES, NEIGHBOURS = 4, 2
#: Texts that a class needs for a band of its own, and the band of the others.
CLASS_TEXTS, WIDE = 100, (0.4, 6.0)
#: Width of a band on each side of the median: in deviations (of a normal distribution), and as a share of the median at least. More room
#: below, as noise lies far under usual texts and repetition begins right above them.
WIDTH, LEAST_BELOW, LEAST_ABOVE = 6.0, 0.15, 0.08
#: Bins of the ratio's natural logarithm.
BINS = 200

MEASURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, n_bytes bigint, text_hash bigint, ratio double, chunks array<float>"
)
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs at least twice; the first occurrence counts too."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    v = len(ids)
    pair = a[:-1] * v + a[1:]
    if v < 2_000_000:
        key = pair[:-1] * v + a[2:]
    else:  # v ** 3 would not fit
        key = np.unique(pair, return_inverse=True)[1][:-1].astype(np.int64) * v + a[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[at] >= 2
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes | None, press: zstandard.ZstdCompressor) -> tuple:
    """The columns of MEASURES after doc_id."""
    text = text or b""
    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    n = len(words)
    points = len(text) - sum(text.count(b"%c" % x) for x in _SPACE) - _continuations(text)
    symbols = sum(text.count(b"%c" % x) for x in _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    hashed = xxhash.xxh64_intdigest(text) - (1 << 63)
    if not n:
        return n, points, symbols, dup, repeats, True, len(text), hashed, None, []
    chunks = [c for c in (text[at : at + CHUNK] for at in range(0, len(text), CHUNK)) if len(c) >= MIN_CHUNK]
    return n, points, symbols, dup, repeats, failed, len(text), hashed, len(text) / len(press.compress(text)), [len(c) / len(press.compress(c)) for c in chunks]


def _continuations(text: bytes) -> int:
    """Bytes that don't begin a code point."""
    if text.isascii():
        return 0
    x = np.frombuffer(text, np.uint8)
    return int(((x & 0xC0) == 0x80).sum())


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the columns of MEASURES. No shuffle."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2 + [pa.float64(), pa.list_(pa.float32())]
        for batch in batches:
            rows = [measure(t, press) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [batch.column(0).cast(pa.int64())]
            columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, MEASURES)


def length_class(n_bytes: Column) -> Column:
    return F.floor(F.log2(n_bytes.cast("double")) * CLASSES).cast("int")


def bands(measures: DataFrame) -> dict[int, tuple[float, float]]:
    """Lowest and highest ratio by length class. The driver reads a count for each class and bin, a few thousand numbers whatever the input."""
    texts = measures.where("not base_failed").select(length_class(F.col("n_bytes")).alias("c"), F.round(F.log("ratio") * BINS).cast("int").alias("b"), "text_hash")
    counts = defaultdict(list)
    for r in texts.distinct().groupBy("c", "b").agg(F.count("*").alias("n")).orderBy("c", "b").collect():
        counts[r["c"]].append((r["b"], r["n"]))
    return fitted(counts)


def fitted(counts: dict[int, list[tuple[int, int]]]) -> dict[int, tuple[float, float]]:
    """Bands from (bin, texts) by class."""

    def median(values: np.ndarray, weights: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        total = np.cumsum(weights[order])
        return float(values[order][np.searchsorted(total, (total[-1] + 1) // 2)])

    own = {}
    for c, pairs in counts.items():
        b, n = np.array(pairs).T
        if n.sum() >= CLASS_TEXTS:
            x = np.exp(b / BINS)
            middle = median(x, n)
            own[c] = middle, median(abs(x - middle), n)
    out = {}
    for c in own:
        near = np.array([own[d] for d in range(c - NEIGHBOURS, c + NEIGHBOURS + 1) if d in own])
        middle, spread = np.median(near, axis=0)
        wide = WIDTH * 1.4826 * spread
        out[c] = float(middle - max(wide, LEAST_BELOW * middle)), float(middle + max(wide, LEAST_ABOVE * middle))
    return out


def judged(measures: DataFrame, limits: dict[int, tuple[float, float]]) -> DataFrame:
    """The measures with low and high (the document's band), n_chunks, n_bad_chunks and the verdict `kept`."""
    top = max(limits, default=0)
    table = [limits.get(c, WIDE) for c in range(top + 1)]
    lows, highs = (F.array(*[F.lit(t[k]) for t in table]) for k in (0, 1))

    def band(size: Column) -> tuple[Column, Column]:
        c = F.when(size > 0, length_class(size)).otherwise(0)
        return F.coalesce(F.get(lows, c), F.lit(WIDE[0])), F.coalesce(F.get(highs, c), F.lit(WIDE[1]))

    low, high = band(F.col("n_bytes"))
    whole, last = band(F.lit(CHUNK)), band(F.col("n_bytes") % CHUNK)

    def bad(x: Column, i: Column) -> Column:
        cut = i >= F.floor(F.col("n_bytes") / CHUNK)  # the end of the text
        return ~F.when(cut, x.between(*last)).otherwise(x.between(*whole))

    rows = measures.withColumns({"low": low, "high": high, "n_chunks": F.size("chunks").cast("bigint"), "n_bad_chunks": F.size(F.filter("chunks", bad)).cast("bigint")})
    fine = ~F.col("base_failed") & F.col("ratio").between(F.col("low"), F.col("high")) & (F.col("n_bad_chunks") <= CHUNK_SHARE * F.col("n_chunks"))
    return rows.withColumn("kept", F.coalesce(fine, F.lit(False)))


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the base counts, the ratio with its band, the chunks and the verdict `kept`."""
    rows = stored(measured(docs, id_col, text_col), "compression")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "low", "high", "n_chunks", "n_bad_chunks")
    return judged(rows, bands(rows)).select(*names)
