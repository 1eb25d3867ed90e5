"""Token counts by delta-maintained rollups.

A batch is a table of signed deltas (doc_id, source, lang, version, n_tokens, sign): +1 inserts a document, -1 takes one away, and a revised count is both.
Committing a batch writes its sums by (source, lang, version) to the batch's own folder, so committing it again, after a crash or by
mistake, replaces the same rows and changes nothing. The totals are sums over all batches; compaction folds old
batches into one, which keeps their names, and all that they kept, so that a late replay of one is still known. A batch without _SUCCESS counts nowhere. Sums are combined before the shuffle, so a hot
source costs one row for each task.

Nulls and edge cases: null sources, languages and versions are groups of their own; a null or empty text has 0 tokens and counts as a
document. Repeated rows in a batch count as often as they stand there. An empty batch commits nothing but its name. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_arrow, new_folder
from .tokens import TOKENIZER, encoder

KEYS = ("source", "lang", "version")
ROWS = "source string, lang string, version string, docs bigint, tokens bigint, inserts bigint, deletes bigint, replaces string"
WORDS = "words-1"


def counted(docs: DataFrame, version: str = TOKENIZER) -> DataFrame:
    """docs (doc_id, source, lang, text) with version and n_tokens in place of the text. version: WORDS counts words, others name a tokenizer file."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), "source", "lang", "text")
    schema = "doc_id bigint, source string, lang string, version string, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None if version == WORDS else encoder(version)
        for batch in batches:
            if encode:
                n = [len(encode(t)) // 4 if t else 0 for t in batch.column(3).to_pylist()]
            else:
                n = [len(t.split()) if t else 0 for t in batch.column(3).cast(pa.binary()).to_pylist()]
            cols = [*batch.columns[:3], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "lang", "version", "n_tokens"])

    return rows.mapInArrow(run, schema)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


class Rollup:
    """Totals kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, batch: str) -> str:
        return f"{self.folder}/batch={quote(batch, safe='')}"

    def _whole(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self._at(batch)}/_SUCCESS"))

    def batches(self) -> list[str]:
        """Names of the batches whose folder is whole; what a lost writer left half-written isn't among them."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        return sorted(b for b in (unquote(n.removeprefix("batch=")) for n in names if n.startswith("batch=")) if self._whole(b))

    def committed(self, batch: str) -> bool:
        return self._whole(batch) or bool(self._rows().where(F.col("replaces") == batch).limit(1).count())

    def _rows(self, batches: list[str] | None = None) -> DataFrame:
        """The rows of whole batches with the batch's name; of all, or of those named."""
        named = [self._at(b) for b in self.batches() if batches is None or b in batches]
        if not named:
            return self.spark.createDataFrame([], ROWS + ", batch string")
        return self.spark.read.schema(ROWS + ", batch string").option("basePath", self.folder).parquet(*named)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before. A batch without _SUCCESS is written anew."""
        if self.committed(batch):
            return False
        n = F.col("sign")
        sums = deltas.groupBy(*KEYS).agg(
            F.sum(n).cast("bigint").alias("docs"), F.sum(n * F.col("n_tokens")).cast("bigint").alias("tokens"),
            F.sum(F.when(n > 0, n).otherwise(0)).cast("bigint").alias("inserts"), F.sum(F.when(n < 0, -n).otherwise(0)).cast("bigint").alias("deletes"),
        )
        sums.withColumn("replaces", F.lit(None).cast("string")).write.mode("overwrite").parquet(self._at(batch))
        return True

    def compact(self, into: str, batches: list[str]) -> None:
        """Fold whole batches into one that carries their names and all names that they carry. The new batch is written before the old ones
        go, and totals leave out batches that another replaces, so a crash between the two counts nothing twice. Batches that were never committed are passed over."""
        named = [b for b in self.batches() if b in batches and b != into]
        if not self._whole(into):
            rows = self._current(self._rows(named))
            sums = _summed(rows.where("replaces is null")).withColumn("replaces", F.lit(None).cast("string"))
            names = self._rows(named).where("replaces is not null").select("replaces").union(self.spark.createDataFrame([(b,) for b in named], "replaces string")).distinct()
            sums.unionByName(names, allowMissingColumns=True).write.mode("overwrite").parquet(self._at(into))
        gone = {r[0] for r in self._rows([into]).where(F.col("replaces").isin(named)).select("replaces").collect()} if named else set()
        for b in gone:
            self._fs.delete(self._path(self._at(b)), True)

    def _current(self, rows: DataFrame) -> DataFrame:
        """Without the rows of batches that another whole batch replaces."""
        gone = self._rows().where("replaces is not null").select(F.col("replaces").alias("batch")).distinct()
        return rows.join(gone, "batch", "left_anti")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, inserts, deletes. Groups stay when they fall to 0, as their history does."""
        return _summed(self._current(self._rows().where("replaces is null")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("docs", "tokens", "inserts", "deletes")])


def token_rollup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Load all documents counted in words, revise every count to the tokenizer's, delete the documents without a word, compact twice on the way, replay every batch, and return the totals."""
    spark = docs.sparkSession
    rollup = Rollup(spark, folder or new_folder(spark, "rollup"))
    words = counted(docs, WORDS)
    wordless = docs.where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    batches = [("load", signed(words, 1)), ("revise", signed(words, -1).unionByName(signed(counted(docs, TOKENIZER), 1))), ("withdraw", signed(counted(wordless, TOKENIZER), -1))]
    for k, (name, deltas) in enumerate(batches):
        rollup.commit(name, deltas)
        if k:
            rollup.compact(f"base-{k}", ["load", "revise"] if k == 1 else ["base-1", "withdraw"])
    for name, deltas in batches:
        rollup.commit(name, deltas)
    return rollup.totals()
