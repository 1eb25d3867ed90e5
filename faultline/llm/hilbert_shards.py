"""Sharding in the order of a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS cells; the cell's index on the Hilbert curve orders the documents, and the order
is cut into runs, so each shard covers a compact region and files can be pruned on any of the dimensions. The
law is `rows`: counts of shards differ by one at most. Documents with equal texts stand next to one another, at the place
of the first of them. Rows are numbered through a range sort, never in one task.

Nulls and edge cases: a null text has size 16 and crc32 0 and counts as one text; null metadata has a cell of its own (0).
Repeated rows have a slot each. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_arrow, discard, ranked, stored

BITS = 6
SHARDS = 40


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, dimensions), by the transposed form of Skilling (2004)."""
    x = [cells[:, i].astype(np.uint64).copy() for i in range(cells.shape[1])]
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            set_ = (x[i] & np.uint64(q)) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(len(cells), np.uint64)
    q = top
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    out = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | (((x[i] ^ t) >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


def quantised(docs: DataFrame, column: str, bits: int = BITS) -> Column:
    """A cell in 0 .. 2**bits - 1 for each value. Numbers: by logarithm. Strings: the 2**bits - 2 most frequent values have a cell each,
    in the order of the values, so that a run of cells is a range of values; all others share the last cell."""
    cells = (1 << bits) - 1
    if dict(docs.dtypes)[column] != "string":
        x = F.greatest(F.col(column).cast("double"), F.lit(0.0))
        return F.coalesce(F.least(F.floor(F.log2(x + 1) * 3) + 1, F.lit(cells)), F.lit(0)).cast("int")
    common = docs.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(cells - 1).collect()
    codes = {v: k + 1 for k, v in enumerate(sorted(r[0] for r in common))}
    if not codes:
        return F.lit(0)
    table = F.create_map(*[F.lit(y) for kv in codes.items() for y in kv])
    return F.when(F.col(column).isNull(), 0).otherwise(F.coalesce(table[F.col(column)], F.lit(cells))).cast("int")


def hilbert_shards(docs: DataFrame, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = SHARDS, text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    spark = docs.sparkSession
    bounded_arrow(spark)

    @F.pandas_udf("bigint")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], 1), BITS))

    data = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(data, 256)), F.lit(b"")).alias("_text"),
        *[quantised(docs, c).alias(f"_d{k}") for k, c in enumerate(dimensions)],
    )
    rows = rows.withColumn("curve", curve(*[F.col(f"_d{k}") for k in range(len(dimensions))])).drop(*[f"_d{k}" for k in range(len(dimensions))])
    rows = stored(rows, "hilbert-rows")
    first = rows.groupBy("_text").agg(F.min(F.struct("doc_id", "curve")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = stored(first.select("_text", F.col("_first.curve").alias("_place"), F.col("_first.doc_id").alias("_head")), "hilbert-groups")
    placed = rows.join(first, "_text", "left").withColumns({"_place": F.coalesce("_place", "curve"), "_head": F.coalesce("_head", "doc_id")})
    order = [F.col(c) for c in ("_place", "_head", "_text", "doc_id", "size", "curve")]
    numbered, total = ranked(placed, order, "hilbert-order")
    discard(rows)
    n = max(total, 1)
    out = numbered.withColumn("shard", F.expr(f"(rank * {shards}) div {n}"))
    out = out.withColumn("slot", F.col("rank") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}"))  # less the shard's first rank
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
