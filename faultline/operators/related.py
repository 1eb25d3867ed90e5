"""Joins between findings, functions and crashes. Interval joins carry an equality on the file, so they hash; containment looks for all needles at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import point_in_interval
from .substring import first_holders

def related_crash(findings: DataFrame, crashes: DataFrame, file: str = "file", trace: str = "stack_trace", seq: str = "seq", basename: bool = False) -> DataFrame:
    """findings with `crash` (struct): the first crash whose trace holds the finding's file, else the first crash, else null. seq: an integer.

    Each distinct file is looked up once, all of them in one pass over the traces (see substring.py)."""
    c = crashes.select(F.struct(*crashes.columns).alias("_c"), F.col(trace).alias("_trace"), F.col(seq).cast("bigint").alias("_seq"))
    first = c.agg(F.min_by("_c", "_seq").alias("_first"))
    needle = F.element_at(F.split(file, "/"), -1) if basename else F.col(file)
    files = findings.select(F.col(file), needle.alias("needle")).where("needle is not null").distinct()
    traced = c.where(F.coalesce("_trace", F.lit("")) != "").select("_seq", F.col("_trace").alias("_text"))
    hits = first_holders(traced, files.select("needle").distinct())
    hit = files.join(hits, "needle").join(c.select("_c", "_seq"), "_seq").groupBy(file).agg(F.min_by("_c", "_seq").alias("_match"))
    return findings.join(hit, file, "left").crossJoin(F.broadcast(first)).withColumn("crash", F.coalesce("_match", "_first")).drop("_match", "_first")  # one row


def trace_locations(crashes: DataFrame, trace: str = "stack_trace") -> DataFrame:
    """crashes with one row for each file:line in the trace: file_name, line, pos."""
    found = F.regexp_extract_all(trace, F.lit(r"(?U)(\w+\.\w+:\d+)"), F.lit(1))
    rows = crashes.select("*", F.posexplode(found).alias("pos", "_at"))
    return rows.withColumns({"file_name": F.substring_index("_at", ":", 1), "line": F.substring_index("_at", ":", -1).try_cast("int")}).drop("_at")


def last_write_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """left with the value of the right row that comes last for its keys, or null."""
    last = right.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))
    return left.join(last, keys, "left")


def crash_at_location(findings: DataFrame, crashes: DataFrame) -> DataFrame:
    """findings with `crash`: the last crash whose trace names its file's base name and line."""
    keyed = findings.withColumns({"file_name": F.element_at(F.split("file", "/"), -1), "_line": F.col("line")})
    named = lambda rows: trace_locations(rows).withColumnRenamed("line", "_line")
    at = ["file_name", "_line"]
    # whole crashes are taken up only where they are last at a place that is asked for; until then a place has a number
    last = named(crashes.select("seq", "stack_trace")).join(keyed.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.max("seq").alias("_last"))
    held = crashes.join(last.select("_last").distinct(), F.col("seq").eqNullSafe(F.col("_last")), "left_semi")
    places = named(held).join(last.withColumnsRenamed({"file_name": "_f", "_line": "_l"}), (F.col("file_name") == F.col("_f")) & (F.col("_line") == F.col("_l")) & F.col("seq").eqNullSafe(F.col("_last")))
    return last_write_join(keyed, places, at, ["seq", "pos"], F.struct(*crashes.columns), "crash").drop("file_name", "_line")


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b whose closed intervals meet."""
    return a.join(b, keys).where((F.col(b_range[0]) <= F.col(a_range[1])) & (F.col(b_range[1]) >= F.col(a_range[0])))


def bucketed_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int) -> DataFrame:
    """interval_overlap for long lists on one key: both sides are cut at a grid, so a hot key is dealt by place; a pair counts in the first cell it shares."""
    ca = a.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(a_range[0]) / width), F.floor(F.col(a_range[1]) / width))))
    cb = b.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(b_range[0]) / width), F.floor(F.col(b_range[1]) / width))))
    first = F.floor(F.greatest(a_range[0], b_range[0]) / width)
    return interval_overlap(ca, cb, [*keys, "_cell"], a_range, b_range).where(F.col("_cell") == first).drop("_cell")


def function_at(points: DataFrame, functions: DataFrame, point_id: list[str] | None = None) -> DataFrame:
    """points (file_path, line) with `function`, the name of the first function that holds the line. point_id isn't needed any more."""
    fs = functions.select("file_path", F.col("start_line").alias("_first"), F.col("end_line").alias("_last"), F.col("seq").alias("_s"), F.col("name").alias("_name"))
    return point_in_interval(points, fs, ["file_path"], "line", "_first", "_last", "_s", F.col("_name"), "function")


def functions_in_range(functions: DataFrame, first: int, last: int) -> DataFrame:
    return functions.where((F.col("start_line") <= last) & (F.col("end_line") >= first))


def by_name(wanted: DataFrame, functions: DataFrame, key: str = "name") -> DataFrame:
    """wanted with the first function (struct) of its name in its file, or null."""
    first = functions.groupBy("file_path", key).agg(F.min_by(F.struct(*functions.columns), "seq").alias("function"))
    return wanted.join(first, ["file_path", key], "left")


def verification_grid(patches: DataFrame, crashes: DataFrame, binaries: DataFrame | None = None) -> DataFrame:
    """Every patch with every crash of its run: the runs to make, and `harness` with unknown for none. The crashes of a run are its
    deduplicated ones, a bounded list by design."""
    rows = crashes.withColumn("harness", F.coalesce(F.nullif(F.col("harness"), F.lit("")), F.lit("unknown")))
    keys = [c for c in ("project", "run_id") if c in patches.columns and c in rows.columns]
    if not keys:
        raise ValueError("patches and crashes share neither project nor run_id, so every patch would meet every crash")
    out = patches.join(rows, keys)
    return out if binaries is None else out.join(binaries, "harness", "left")
