"""Which texts hold which needles: an inverted index of byte q-grams.

A needle is in a text only if its anchor is, one of its grams of up to 8 bytes: the one that fewest needles have, so that beginnings and endings that many needles
share are no anchors. A gram of 8 bytes is a 64-bit number, so equal numbers are equal grams, and a needle of 8 bytes or fewer is its anchor. Texts are read once, whatever the
number of needles: their positions are looked up in a bitmap of the anchors, and those that pass are joined with the anchors; pairs of a longer needle with a
text are then verified where the text is, so a text moves once. The number of pairs is that of true hits and of texts that hold an anchor without its needle.

The index and the positions that pass are stored when the operator is called: the driver counts the needles and reads the bitmap, 16 MB at most. A fuller bitmap lets more positions through; it loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

Q = 8
#: Bits of the bitmap: at least, at most, and for each needle.
BITS_LEAST, BITS_MOST, BITS_EACH = 20, 27, 32
#: Positions that are looked up at once.
BLOCK = 1 << 20
#: Bits of one bitmap row of Spark's bitmap functions.
_ROW_BITS = 32768
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The number of the q bytes from each position on."""
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def bit_places(codes: np.ndarray, q: int, bits: int) -> np.ndarray:
    return ((codes ^ np.uint64(q)) * _MIX) >> np.uint64(64 - bits)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins, with the end at last."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hits(data: np.ndarray, starts: np.ndarray, q: int, bitmap: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of the positions whose bit is set, of all without a bitmap; each pair once within a block. Grams don't cross texts."""
    for s in range(0, len(data), BLOCK):
        codes = grams(data[s : s + BLOCK + q - 1], q)
        at = np.arange(len(codes))
        if bitmap is not None:
            places = bit_places(codes, q, bits)
            at = np.nonzero(bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8) & 1)[0]
        row = np.searchsorted(starts, at + s, "right") - 1
        inside = at + s + q <= starts[row + 1]
        pairs = np.unique(np.stack([row[inside].astype(np.int64), codes[at[inside]].view(np.int64)]), axis=1)
        yield pairs[0], pairs[1]


def _gram_rows(texts: DataFrame, key: str, qs: list[int] | None, bitmap: np.ndarray | None, bits: int) -> DataFrame:
    """texts (key, text) to (key, q, gram). With qs None, the grams are of Q bytes, or the whole text if that is shorter."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _flat(batch.column(1))
            lengths = np.diff(starts)
            for q in qs or range(1, Q + 1):
                for row, codes in _hits(data, starts, q, bitmap, bits):
                    if qs is None and q < Q:
                        own = lengths[row] == q
                        row, codes = row[own], codes[own]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), q, np.int32)), pa.array(codes)], [key, "q", "gram"])

    return texts.mapInArrow(run, f"{key} {kind}, q int, gram bigint")


def anchors(needles: DataFrame) -> DataFrame:
    """needles (needle, not empty) with q and gram, the anchor: of the needle's grams the one that fewest needles have."""
    rows = _gram_rows(needles.select("needle", "needle").toDF("needle", "text"), "needle", None, None, 0).distinct()
    common = rows.groupBy("q", "gram").agg(F.count("*").alias("n"))
    return rows.join(common, ["q", "gram"]).groupBy("needle").agg(F.min(F.struct("n", "q", "gram")).alias("_a")).select("needle", "_a.q", "_a.gram")


def _bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """The bits of all anchors, put together by Spark's bitmap aggregates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, codes = (np.asarray(c) for c in batch.columns)
            places = np.empty(len(q), np.int64)
            for each in np.unique(q).tolist():
                places[q == each] = bit_places(codes[q == each].view(np.uint64), each, bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places // _ROW_BITS), pa.array(places % _ROW_BITS)], ["part", "bit"])

    out = np.zeros(1 << bits - 3, np.uint8)
    for r in index.select("q", "gram").mapInArrow(run, "part bigint, bit bigint").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("m")).collect():  # 2^bits / 32768 rows
        out[r["part"] * _ROW_BITS // 8 : (r["part"] + 1) * _ROW_BITS // 8] = np.frombuffer(r["m"], np.uint8)
    return out


def first_holders(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """needle and `_seq`, the smallest _seq of the texts (_seq bigint, _text) that hold it, for needles that some text holds, and for the empty one. Needles are distinct."""
    some = needles.where("needle <> ''")
    index = stored(anchors(some), "anchors")
    count = max(1, index.count())
    bits = min(BITS_MOST, max(BITS_LEAST, (BITS_EACH * count).bit_length()))
    bitmap = _bitmap(index, bits)
    qs = sorted(r["q"] for r in index.select("q").distinct().collect())  # 8 at most
    known = texts.where("_seq is not null and _text is not null")
    met = stored(_gram_rows(known.select("_seq", "_text"), "_seq", qs, bitmap, bits), "met")  # short and long needles both start from it
    short = met.where(F.col("q") < Q).groupBy("q", "gram").agg(F.min("_seq").alias("_seq")).join(index, ["q", "gram"]).select("needle", "_seq")
    pairs = met.where(F.col("q") == Q).join(index, ["q", "gram"]).select("needle", "_seq").distinct()
    checked = pairs.join(known.select("_seq", "_text"), "_seq").where(F.contains("_text", "needle")).select("needle", "_seq")
    empty = known.select(F.lit("").alias("needle"), "_seq")
    return short.unionByName(checked).unionByName(empty).groupBy("needle").agg(F.min("_seq").alias("_seq")).where("_seq is not null")
