"""Streaming twins: event logs as streams, idempotent inserts and capped buckets as keyed state."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from ..schemas import TOOL_CALLS

log = logging.getLogger(__name__)


def tool_call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON files of a folder; files must appear whole."""
    return spark.readStream.schema(TOOL_CALLS).json(folder)


def windowed_calls(calls: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Calls by tool and action in windows of event time; later events than the watermark are left out, which a batch would count."""
    return calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "tool", "action").count()


def unique_inserts(rows: DataFrame, id_cols: list[str], ts: str, keep: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark. State is bounded by it, so an id that comes again later counts as new."""
    return rows.withWatermark(ts, keep).dropDuplicatesWithinWatermark(id_cols)


class Admission(StatefulProcessor):
    """Admits the first rows of each bucket, k ids at most. The state of a bucket is a list of its admitted ids, so it doesn't grow with the rows of a hot bucket."""

    def __init__(self, id_col: str, order: str, k: int, ttl_ms: int | None) -> None:
        self.id_col, self.order, self.k, self.ttl_ms = id_col, order, k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", StructType().add("id", StringType()), self.ttl_ms)

    def _held(self) -> set[str]:
        return {x[0] for x in self.ids.get()}

    def _texts(self, frame: pd.DataFrame) -> list[str]:
        ids = frame[self.id_col]
        return [str(x) for x in ids.tolist()] if ids.dtype.kind in "iuO" else ids.astype(str).tolist()

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: Any) -> None:
        held = self._held()
        fresh = [x for x in dict.fromkeys(self._texts(initialState)) if x not in held]
        if fresh:
            self.ids.appendList([(x,) for x in fresh])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """One call to read a bucket's state and one to write it, and few of pandas: most buckets have few rows, so these are the cost of a stream."""
        held = self._held()
        room = self.k - len(held)
        best: pd.DataFrame | None = None
        fresh: list[str] = []
        if room > 0:  # rows of a full bucket aren't looked at
            for frame in rows:  # k rows are kept while reading, whatever the batch holds
                both = frame if best is None else pd.concat([best, frame])
                order, texts = both[self.order], self._texts(both)
                places = order.to_numpy().argsort(kind="stable").tolist() if order.dtype.kind in "iu" else order.reset_index(drop=True).sort_values(kind="stable").index.tolist()
                taken: dict[str, int] = {}
                for n in places:
                    if texts[n] not in held and texts[n] not in taken:
                        taken[texts[n]] = n
                        if len(taken) == room:
                            break
                best, fresh = both.iloc[list(taken.values())], list(taken)
        if fresh:
            self.ids.appendList([(x,) for x in fresh])
            yield best

    def close(self) -> None:
        pass


def capped_buckets(rows: DataFrame, bucket: list[str], id_col: str, order: str, k: int = 5, ttl_ms: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """Admission to buckets of k over a stream, in order within a batch. held: what a stored corpus has already (bucket columns and id_col), from which a stream with a new checkpoint
    starts; more than k of a bucket may be held, and then it is full. With ttl_ms an id is forgotten so long after its admission, which lets its bucket fill anew;
    time then makes batches of its own, so such a stream runs until it is stopped and can't be drained."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = held.select(*bucket, F.col(id_col).cast("string").alias(id_col)).distinct().groupBy(*bucket) if held is not None else None
    return rows.groupBy(*bucket).transformWithStateInPandas(Admission(id_col, order, k, ttl_ms), rows.schema, "append", "processingTime" if ttl_ms else "none", first)


class Delivery:
    """Hands each batch of a stream to callbacks, each batch to each callback once, whatever fails or comes again. To be passed to foreachBatch.

    A callback gets a batch and its number and returns the rows to deliver. They are written to `<folder>/delivered/<name>/batch=<n>`, which a second try overwrites, and then the ledger
    gets a row (callback, batch, rows, error) at `<folder>/ledger/<name>/batch=<n>`. A batch that the ledger has as delivered is passed over. If a callback raises, its batch is kept at
    `<folder>/failed/<name>/batch=<n>`, the ledger gets the error, and the stream goes on; `retry` tries these again.
    """

    LEDGER = "callback string, batch bigint, rows bigint, error string"

    def __init__(self, callbacks: dict[str, Callable[[DataFrame, int], DataFrame]], folder: str) -> None:
        self.callbacks, self.folder = callbacks, folder

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for name in self.callbacks:
                self._deliver(name, rows, batch)
        finally:
            rows.unpersist()

    def _place(self, kind: str, name: str, batch: int) -> str:
        return f"{self.folder}/{kind}/{name}/batch={batch}"

    def _entry(self, spark: SparkSession, name: str, batch: int) -> tuple[int, str | None] | None:
        found = _read(spark, self._place("ledger", name, batch), self.LEDGER)
        row = found.first() if found is not None else None
        return row and (row["rows"], row["error"])

    def _deliver(self, name: str, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        entry = self._entry(spark, name, batch)
        if entry and entry[1] is None:
            return
        error = None
        try:
            out = self.callbacks[name](rows, batch)
            out.write.mode("overwrite").parquet(self._place("delivered", name, batch))
            count = spark.read.schema(out.schema).parquet(self._place("delivered", name, batch)).count()
        except Exception as e:  # a callback's failure is recorded, and others go on
            error, count = f"{type(e).__name__}: {e}"[:1000], 0
            log.warning("callback %s failed on batch %d: %s", name, batch, error)
            if entry is None:
                rows.write.mode("overwrite").parquet(self._place("failed", name, batch))
        # text, so that an entry stands in one file that appears whole
        spark.createDataFrame([(name, batch, count, error)], self.LEDGER).coalesce(1).write.mode("overwrite").json(self._place("ledger", name, batch))

    def ledger(self, spark: SparkSession) -> DataFrame:
        found = _read(spark, f"{self.folder}/ledger/*/*", self.LEDGER)
        return found if found is not None else spark.createDataFrame([], self.LEDGER)

    def retry(self, spark: SparkSession, schema: StructType) -> None:
        """Hands the batches that failed to their callbacks again."""
        for row in self.ledger(spark).where("error is not null").collect():  # a row for each failed batch
            if row["callback"] in self.callbacks:
                self._deliver(row["callback"], spark.read.schema(schema).parquet(self._place("failed", row["callback"], row["batch"])), row["batch"])

    def delivered(self, spark: SparkSession, name: str, schema: StructType) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/delivered/{name}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return spark.read.schema(schema).json(path) if there else None


def on_new_rows(rows: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls back with each batch of new rows, such as a Delivery; a batch may come twice after a failure, so the callback gets its number."""
    return rows.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(rows: DataFrame, checkpoint: str, folder: str, mode: str = "append") -> None:
    """Runs the stream over what there is and writes it as Parquet."""
    rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start().awaitTermination()
