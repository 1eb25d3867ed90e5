"""Tables that operators write for themselves, in the folder that the cluster shares, deleted when the process ends."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path where the session keeps its checkpoints; one of this machine only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="faultline-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    log.debug("scratch folder %s", path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written and read back: lineage ends there, so that a lost executor costs no second run, and what was nondeterministic stays as it is."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored_bytes(spark: SparkSession, path: str) -> int:
    store, target = _target(spark, path)
    return store.getContentSummary(target).getLength()


def dropped(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more goes before the process ends."""
    store, target = _target(spark, path)
    store.delete(target, True)


@atexit.register
def clean() -> None:
    for spark, path in _made:
        try:
            dropped(spark, path)
        except Exception:  # the session may have ended
            return
