"""Sinks: JSON, text and file outputs of a run. Every write is a Spark write, so tasks can be retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(events: DataFrame, folder: str) -> None:
    """Log lines `timestamp [LEVEL] message`, appended as new files."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    events.select(F.concat(F.lit("["), stamp, F.lit("] "), F.upper("level"), F.lit(" "), "message").alias("value")).write.mode("append").text(folder)


def append_tool_calls(calls: DataFrame, folder: str) -> None:
    calls.write.mode("append").json(folder)


def static_batch(findings: DataFrame, summary: str, folder: str) -> None:
    """Findings of a run as JSON lines with the batch's summary; the function name isn't kept, as readers of this format don't expect it."""
    kept = [c for c in findings.columns if c != "function_name"]
    findings.select(F.lit(summary).alias("summary"), F.struct(*kept).alias("finding")).write.mode("overwrite").json(folder)


def fuzzing_batches(crashes: DataFrame, folder: str, trace_chars: int = 500) -> None:
    """Crashes by harness, traces cut."""
    crashes.withColumn("stack_trace", F.substring("stack_trace", 1, trace_chars)).write.mode("overwrite").partitionBy("harness").json(folder)


def deduplicated(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").json(folder)


def crash_log(crashes: DataFrame, folder: str) -> None:
    """One paragraph for each crash."""
    text = F.format_string("Crash: %s\nInput: %s (%d bytes)\nSignal: %s\n%s\n", "crash_id", "input_path", "input_size", "signal", "stack_trace")
    crashes.select(text.alias("value")).write.mode("overwrite").text(folder)


def patch_files(patches: DataFrame, folder: str) -> None:
    """A .patch text for each patch, in a folder by its saved name."""
    patches.select(F.concat(F.col("name"), F.lit(".patch")).alias("name"), F.col("patch").alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def patching_results(tests: DataFrame, interactions: DataFrame, folder: str) -> None:
    tests.write.mode("overwrite").json(f"{folder}/results")
    interactions.write.mode("overwrite").json(f"{folder}/llm_interactions")


def text_report(rows: DataFrame, column: str, folder: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def summary(rows: DataFrame, folder: str) -> None:
    """A summary as JSON and as text."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    rows.select(F.col("summary").alias("value")).write.mode("overwrite").text(f"{folder}/text")


def seeds(files: DataFrame, present: DataFrame, folder: str) -> DataFrame:
    """Write the seeds that the target lacks, as rows of id and content; returns them."""
    fresh = files.join(present.select("id").distinct(), "id", "left_anti").select("id", "content")
    fresh.write.mode("append").parquet(folder)
    return fresh
