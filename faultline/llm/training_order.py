"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and shards hold runs of slots.

Documents are tokenised, each followed by the end token, and laid end to end as they stand in a partition of the input; this stream is cut into sequences
of STRIDE ids, so only a partition's last sequence is padded. Sequences are numbered gaplessly as they were stored; a Feistel network on
the smallest even number of bits that holds all numbers permutes them, walking along its cycle until it lands below their count. The slot
depends on the key, the number and the count alone, so nothing is sorted at random and no table of the order is kept.

Shard s holds slots s * SHARD_SIZE .. (s + 1) * SHARD_SIZE - 1, in order, as one file `records/shard=<s>/...` of records of the same size: STRIDE unsigned
16-bit ids, least byte first, padded with 0, and one line end. Each task writes a range of shards. So the record of a slot begins at byte
(slot % SHARD_SIZE) * RECORD_BYTES of its shard, and a reader resumes there by a seek. The table `index`, in the same ranges, names the documents of each slot.

Nulls and edge cases: a null or empty text is the end token. Null ids are kept. Repeated rows are documents of their own.
An empty table gives no sequences. Extra columns are dropped. Ids must fit 16 bits, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_arrow, discard, new_folder, numbered, stored
from .tokens import END_ID, TOKENIZER, encoder

STRIDE = 512
RECORD_BYTES = 2 * STRIDE + 1
SHARD_SIZE = 8192
#: Tasks that write, at most; each writes a range of shards.
WRITERS = 20_000
ROUNDS = 6
KEY = 20240229


def _round(half: np.ndarray, key: np.uint64) -> np.ndarray:
    x = half ^ key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half_bits: int, key: int, inverse: bool = False) -> np.ndarray:
    mask, shift = np.uint64((1 << half_bits) - 1), np.uint64(half_bits)
    keys = _round(np.arange(1, ROUNDS + 1, dtype=np.uint64), np.uint64(key))
    left, right = x >> shift, x & mask
    for k in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (_round(left, k) & mask), left
        else:
            left, right = right, left ^ (_round(right, k) & mask)
    return (left << shift) | right


def slots(numbers: np.ndarray, count: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 .. count - 1 at `numbers`, or its inverse."""
    half_bits = max(1, -(-max(1, (count - 1).bit_length()) // 2))
    x = _feistel(np.asarray(numbers).astype(np.uint64), half_bits, key, inverse)
    while (out := x >= count).any():  # under 4 walks on average, as the domain is under 4 times the count
        x[out] = _feistel(x[out], half_bits, key, inverse)
    return x.astype(np.int64)


_CUT = "doc_ids array<bigint>, starts array<int>, length int, record binary"


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, stride: int = STRIDE) -> DataFrame:
    """Rows (doc_ids, starts, length, record): the documents that a sequence holds parts of, where each part begins, the number of ids before the padding."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, held, parts, ids, starts = encoder(tokenizer), [], 0, [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.append(np.frombuffer(encode(text or ""), "<u4"), END_ID)
                if x.max() > 0xFFFF:
                    raise ValueError("ids need more than 16 bits")
                x, at = x.astype("<u2"), 0
                while at < len(x):
                    part = x[at : at + stride - held]
                    parts.append(part)
                    ids.append(doc)
                    starts.append(held)
                    held, at = held + len(part), at + len(part)
                    if held == stride:
                        out.append((ids, starts, held, np.concatenate(parts).tobytes()))
                        held, parts, ids, starts = 0, [], [], []
                        if len(out) >= 4096:
                            yield _batch(out)
                            out = []
        if held:
            out.append((ids, starts, held, np.concatenate([*parts, np.zeros(stride - held, "<u2")]).tobytes()))
        yield _batch(out)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _CUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _CUT.split(", ")])


def materialise(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, stride: int = STRIDE, shard_size: int = SHARD_SIZE, key: int = KEY) -> int:
    """Write the shards and their index below folder; the number of sequences. A shard is one file, written by one task and committed whole."""
    cut = sequences(docs, tokenizer, stride).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    cut = stored(cut, "order-sequences", compression="zstd")
    rows, total = numbered(cut)

    @F.pandas_udf("bigint")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(slots(number.to_numpy(), total, key))

    shards = max(1, -(-total // shard_size))
    writers = min(shards, WRITERS)
    rows = rows.withColumn("slot", slot("rank")).withColumn("shard", F.expr(f"slot div {shard_size}"))

    def in_order(*cols: str) -> DataFrame:
        ranges = F.expr(f"cast(shard * {writers} div {shards} as int)")
        return rows.select("shard", "slot", *cols).repartitionById(writers, ranges).sortWithinPartitions("shard", "slot")

    # a string is written as the bytes it has
    in_order("record").select("shard", F.col("record").cast("string").alias("record")).write.partitionBy("shard").option("lineSep", "\n").text(f"{folder}/records")
    in_order("length", "doc_ids", "starts", "rank").withColumnRenamed("rank", "number").write.parquet(f"{folder}/index")
    discard(cut)
    return total


def read_index(spark: SparkSession, folder: str, slot: int = 0) -> DataFrame:
    """Rows (shard, slot, length, doc_ids, starts, number) from a slot on."""
    schema = "shard bigint, slot bigint, length int, doc_ids array<bigint>, starts array<int>, number bigint"
    return spark.read.schema(schema).parquet(f"{folder}/index").where(F.col("slot") >= slot)


def read_records(spark: SparkSession, folder: str, slot: int, count: int, stride: int = STRIDE, shard_size: int = SHARD_SIZE) -> Iterator[bytes]:
    """The ids of `count` slots from a slot on, less if the order ends. Shards are opened one after the other, and the first is read from the slot's own byte on."""
    path, width = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 2 * stride + 1
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while count > 0 and fs.exists(path(f"{folder}/records/shard={slot // shard_size}")):
        place = slot % shard_size
        status = next(x for x in fs.listStatus(path(f"{folder}/records/shard={slot // shard_size}")) if x.getPath().getName().startswith("part-"))
        n = min(count, status.getLen() // width - place)
        if n <= 0:
            return
        stream = fs.open(status.getPath())
        try:
            stream.seek(place * width)
            for start in range(0, n, 1024):
                data = bytes(stream.readNBytes(width * min(1024, n - start)))
                yield from (data[a : a + width - 1] for a in range(0, len(data), width))
        finally:
            stream.close()
        slot, count = slot + n, count - n


def read_shards(spark: SparkSession, folder: str, stride: int = STRIDE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """All shards at once: slot, shard, place, record."""
    width = 2 * stride + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                n = len(data) // width
                for start in range(0, n, 4096):
                    some = range(start, min(n, start + 4096))
                    cols = [[shard * shard_size + i for i in some], [shard] * len(some), list(some), [data[i * width : (i + 1) * width - 1].to_pybytes() for i in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["slot", "shard", "place", "record"])

    bounded_arrow(spark)
    files = spark.read.format("binaryFile").load(f"{folder}/records")
    return files.select(F.col("shard").cast("bigint"), "content").mapInArrow(run, "slot bigint, shard bigint, place bigint, record binary")


def training_order(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Materialise, read the files back, and return one row for each sequence: slot, shard, place, number, length, doc_ids, starts, record_bytes, record_crc32 (of ids and padding)."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "training-order")
    if not materialise(docs, folder):
        return spark.createDataFrame([], "slot bigint, shard bigint, place bigint, number bigint, length int, doc_ids array<bigint>, starts array<int>, record_bytes int, record_crc32 bigint")
    read = read_shards(spark, folder).select("slot", "shard", "place", F.octet_length("record").alias("record_bytes"), F.crc32("record").alias("record_crc32"))
    index = read_index(spark, folder).drop("shard")
    return read.join(index, "slot").select("slot", "shard", "place", "number", "length", "doc_ids", "starts", "record_bytes", "record_crc32")
