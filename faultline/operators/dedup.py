"""Crash deduplication: clusters by stack signature, minimal representatives, summaries.

Clusters are grouped aggregates (combined before the shuffle), so one signature with nearly all crashes costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.traces import crash_signature
from ..scratch import stored


def signed(crashes: DataFrame) -> DataFrame:
    """crashes with `signature` and `cluster_key`; crashes without a trace are keyed by their token."""
    rows = crashes.withColumn("signature", crash_signature(F.coalesce("stack_trace", F.lit(""))))
    empty = F.coalesce("stack_trace", F.lit("")) == ""
    return rows.withColumn("cluster_key", F.when(empty, F.concat(F.lit("no_trace_"), "dedup_token")).otherwise(F.col("signature.signature_hash")))


def clusters(rows: DataFrame, key: str, size: str, seq: str, keep: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each key, and each of `by`: crash_count, first_seq, and `representative` (struct of keep) of the smallest size, earliest on ties."""
    best = F.min_by(F.struct(*keep), F.struct(F.col(size), F.col(seq)))
    return rows.groupBy(*(by or []), key).agg(F.count("*").alias("crash_count"), F.min(seq).alias("first_seq"), best.alias("representative"))


def crash_clusters(crashes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Clusters of all crashes, or those of each of `by`, such as a run."""
    return clusters(signed(crashes), "cluster_key", "input_size", "seq", [*crashes.columns, "signature"], by)


def unique_crashes(crashes: DataFrame) -> DataFrame:
    """The representatives, in the order in which their clusters were first seen."""
    return crash_clusters(crashes).select("first_seq", "representative.*").orderBy("first_seq").drop("first_seq", "signature")


def summary_of(groups: DataFrame, count: str = "crash_count") -> DataFrame:
    """total_crashes, unique_signatures, reduction_ratio (0 when empty) of a cluster table."""
    rows = groups.agg(F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("total_crashes"), F.count("*").alias("unique_signatures"))
    ratio = F.when(F.col("total_crashes") > 0, 1 - F.col("unique_signatures") / F.col("total_crashes")).otherwise(F.lit(0.0))
    return rows.withColumn("reduction_ratio", ratio)


def ranked_clusters(groups: DataFrame) -> DataFrame:
    """Cluster rows by count, largest first, ties in first-seen order."""
    return groups.orderBy(F.desc("crash_count"), "first_seq")


def dedup_report(crashes: DataFrame, top: int = 1000) -> DataFrame:
    """One row: the summary and, as a sorted array, the largest clusters, `top` at most. ranked_clusters has them all, and documents.dedup_documents those of each run."""
    groups = stored(crash_clusters(crashes), "clusters")  # read three times: for the summary, by the sort's sample and by the sort
    r = F.col("representative")
    one = F.struct(
        (-F.col("crash_count")).alias("rank"), F.col("first_seq"), F.col("cluster_key").alias("signature_hash"), r["signature"]["error_type"].alias("error_type"),
        r["signature"]["frames"].alias("frames"), F.col("crash_count"), r["crash_id"].alias("representative_id"),
    )
    listed = ranked_clusters(groups).limit(top).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("rank", "first_seq")).alias("clusters"))
    return summary_of(groups).crossJoin(F.broadcast(listed))  # one row each


