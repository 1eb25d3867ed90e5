"""What the operators of this subpackage share: scratch tables, words, ranks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small in a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_made: list[tuple[SparkSession, str]] = []


def bounded_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get from this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return folder


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.options(**options).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._scratch = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that `stored` returned."""
    spark, folder = df.sparkSession, df._scratch
    _delete(spark, folder)
    _made.remove((spark, folder))


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, folder in _made:
        try:
            _delete(spark, folder)
        except Exception:  # the session may have ended
            return


def small(ids: DataFrame, limit: int = 500_000) -> DataFrame:
    """A stored table of ids, to be broadcast if it has at most `limit` rows; else a join with it shuffles."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, order: list, label: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """df with `rank`, the gapless place from 0 of each row in the given order, and the number of rows.

    Rows are range partitioned and sorted, numbered within their partition and stored; only one count
    for each partition reaches the driver. No single task sees more than its range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    )
    local = stored(local, label)
    return numbered(local)


def numbered(local: DataFrame) -> tuple[DataFrame, int]:
    """Turn (_part, _at) of a stored table into a global rank."""
    spark = local.sparkSession
    counts = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = spark.createDataFrame(starts, "_part int, _start long")  # a row for each partition
    out = local.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_at"))
    return out.drop("_part", "_at", "_start"), total
