"""Run reports: assembly of a run's stages, event logs, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["project", "run_id"]


def assembled_runs(runs: DataFrame, static: DataFrame, fuzzing: DataFrame, patching: DataFrame) -> DataFrame:
    """One row for each run with what each stage left; a stage that is missing is null."""
    return runs.join(static, RUN, "left").join(fuzzing, RUN, "left").join(patching, RUN, "left")


def fuzzing_totals(batches: DataFrame) -> DataFrame:
    """Sums of a run over its harnesses."""
    return batches.groupBy(*RUN).agg(
        F.count("*").alias("harnesses"), F.sum(F.size("crashes")).cast("bigint").alias("crashes"), F.sum("seeds_initial").alias("seeds_initial"),
        F.sum("seeds_found").alias("seeds_found"), F.sum("duration_seconds").alias("duration_seconds"),
    )


def all_crashes(batches: DataFrame) -> DataFrame:
    """The crashes of all harnesses, in order of harness and place."""
    return batches.select(*RUN, "harness", F.posexplode("crashes").alias("pos", "c")).select(*RUN, "pos", "c.*")


def log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Run-log lines as ts, level, message; a line of another form is a message of its own."""
    form = r"^\[?(\d{4}-\d\d-\d\dT[\d:.]+(?:Z|[+-]\d\d:\d\d)?)\]?\s+\[?(\w+)\]?:?\s+(.*)$"
    c = F.col(line)
    return lines.select(
        *[x for x in lines.columns if x != line], F.regexp_extract(c, form, 1).try_cast("timestamp").alias("ts"), F.nullif(F.regexp_extract(c, form, 2), F.lit("")).alias("level"),
        F.when(c.rlike(form), F.regexp_extract(c, form, 3)).otherwise(c).alias("message"),
    )


def static_summary(summaries: Column, target: Column, n: Column, breakdown: Column) -> Column:
    return F.concat(
        F.lit("Static analysis for "), target, F.lit(" inspected "), n.cast("string"), F.lit(" snippets. Severity breakdown: "), breakdown, F.lit(". Highlights: "), F.substring(summaries, 1, 500)
    )


def unit_report(functions: DataFrame) -> DataFrame:
    """One text for each file: its functions with their lines, in order."""
    line = F.concat(F.lit("  "), "name", F.lit(" ["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]"), F.when(F.col("is_small"), " small").otherwise(""))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"])
    return functions.groupBy("file_path").agg(F.concat(F.first("file_path"), F.lit("\n"), F.array_join(listed, "\n")).alias("report"))
