"""Corpus accounting: idempotent inserts, capped buckets, synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.traces import sanitized_token


def idempotent_insert(rows: DataFrame, id_col: str, seq: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """The first row of each id that isn't known yet."""
    cols = [c for c in rows.columns if c != id_col]
    first = rows.groupBy(id_col).agg(F.min_by(F.struct(*cols), seq).alias("_r")).select(id_col, "_r.*")
    return first if known is None else first.join(known.select(id_col).distinct(), id_col, "left_anti")


def first_k(rows: DataFrame, bucket: list[str], id_col: str, seq: str, k: int = 5, known: DataFrame | None = None) -> DataFrame:
    """Admission to buckets of k: duplicates of an id in a bucket don't count, earlier rows go first. known: (bucket, id) already admitted, which
    fill places. Spark keeps k rows of a bucket in each task before the shuffle (WindowGroupLimit), so a hot bucket stays small."""
    cols = [c for c in rows.columns if c not in (*bucket, id_col)]
    fresh = rows.groupBy(*bucket, id_col).agg(F.min_by(F.struct(*cols), seq).alias("_r")).select(*bucket, id_col, "_r.*")
    room = F.lit(k)
    if known is not None:
        held = known.select(*bucket, id_col).distinct()
        fresh = fresh.join(held, [*bucket, id_col], "left_anti").join(held.groupBy(*bucket).agg(F.count("*").alias("_held")), bucket, "left")
        room = F.lit(k) - F.coalesce("_held", F.lit(0))
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(seq))
    return fresh.withColumn("_n", place).where((F.col("_n") <= k) & (F.col("_n") <= room)).drop("_n", "_held")


def admitted_crashes(crashes: DataFrame, k: int = 5, known: DataFrame | None = None) -> DataFrame:
    rows = crashes.withColumn("bucket", sanitized_token(F.col("dedup_token")))
    return first_k(rows, ["bucket"], "crash_id", "seq", k, known)


def new_seeds(found: DataFrame, known: DataFrame, found_id: str = "name", known_id: str = "seed_id") -> DataFrame:
    """Files whose name isn't a known seed's id."""
    return found.join(known.select(F.col(known_id).alias(found_id)).distinct(), found_id, "left_anti")


def to_copy(seeds: DataFrame, present: DataFrame, id_col: str = "seed_id") -> DataFrame:
    """Seeds that aren't in the target yet."""
    return seeds.join(present.select(id_col).distinct(), id_col, "left_anti")


def counts(seeds: DataFrame, crashes: DataFrame) -> DataFrame:
    return seeds.agg(F.countDistinct("seed_id").alias("seed_count")).crossJoin(F.broadcast(crashes.agg(F.countDistinct("bucket", "crash_id").alias("crash_count"))))  # one row each


def known_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids as a table; a set in one row would not scale."""
    return rows.select(id_col).distinct()


def limited(rows: DataFrame, seq: str, n: int | None) -> DataFrame:
    """The first n rows; none or 0 is no limit."""
    return rows.orderBy(seq).limit(n) if n else rows
