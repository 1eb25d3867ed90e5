"""Analysis units: small neighbouring functions are put together up to a number of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

# Fixed values.
MAX_LINES, MAX_GAP = 50, 5


def capped_runs(lines: list[int], max_lines: int = MAX_LINES) -> list[list[int]]:
    """Places of the runs of at least two neighbours whose lines sum to max_lines at most; each run takes as many as it can."""
    out, held = [[]], 0
    for i, n in enumerate(lines):
        if out[-1] and held + n > max_lines:
            out.append([])
            held = 0
        out[-1].append(i)
        held += n
    return [x for x in out if len(x) > 1]


def clubbed(rows: DataFrame, keys: list[str], start: str, end: str, seq: str, small: Column, max_lines: int = MAX_LINES, max_gap: int = MAX_GAP) -> DataFrame:
    """One row for each island of at least two small rows: keys, island (from 0), members (array of seq in order).

    Windows cut a key's rows at gaps over max_gap and at rows that aren't small. What the cap on lines then cuts depends on all cuts before it, so that is
    a fold in Python over the line counts of one piece, in Arrow batches; nothing is quadratic in a key's rows."""

    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([capped_runs(list(x), max_lines) for x in lines])

    by = Window.partitionBy(*keys).orderBy(start, seq)
    near = F.lag(small).over(by) & (F.col(start) - F.lag(end).over(by) <= max_gap)
    cut = rows.withColumn("_piece", F.when(small & F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("_piece", F.sum("_piece").over(by)).where(small)
    pieces = cut.groupBy(*keys, "_piece").agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("start"), F.col(seq).alias("seq"), (F.col(end) - F.col(start) + 1).cast("int").alias("lines")))).alias("x"))
    pieces = pieces.where(F.size("x") > 1).withColumn("_runs", F.pandas_udf(run, "array<array<int>>")(F.transform("x", lambda x: x["lines"])))
    members = F.transform("_runs", lambda r: F.transform(r, lambda i: F.get("x", i)["seq"]))  # before rows are made of runs, which would each hold the whole piece
    found = pieces.select(*keys, "_piece", members.alias("_members")).select(*keys, "_piece", F.posexplode("_members").alias("_k", "members"))
    island = F.row_number().over(Window.partitionBy(*keys).orderBy("_piece", "_k")) - 1
    return found.select(*keys, island.cast("int").alias("island"), "members")


def analysis_units(functions: DataFrame, files: DataFrame | None = None, root: str = "", snippet_lines: int = 200) -> DataFrame:
    """Units of files: islands first, then functions whose *name* is in no island of the file, then files without functions whole."""
    from ..functions.text import relative_posix, snippet

    functions = stored(functions, "functions")  # read several times, so sources are parsed once
    groups = clubbed(functions, ["file_path"], "start_line", "end_line", "seq", F.col("is_small"))
    member = groups.select("file_path", "island", F.posexplode("members").alias("pos", "seq"))
    inside = member.join(functions.select("file_path", "seq", "name", "start_line", "end_line", "body"), ["file_path", "seq"])
    listed = inside.groupBy("file_path", "island").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "start_line", "end_line", "body"))).alias("f"))
    both = listed.select(
        "file_path", F.struct(F.lit(0).alias("kind"), F.col("island").cast("bigint").alias("n")).alias("_order"), F.transform("f", lambda x: x["name"]).alias("function_names"),
        F.array_join(F.transform("f", lambda x: F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string"))), ", ").alias("line_range"),
        F.array_join(F.transform("f", lambda x: x["body"]), "\n\n").alias("code"), F.lit(True).alias("is_clubbed"),
    )
    taken = inside.select("file_path", "name").distinct()
    single = functions.join(taken, ["file_path", "name"], "left_anti").select(
        "file_path", F.struct(F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("n")).alias("_order"), F.array("name").alias("function_names"),
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("line_range"), F.col("body").alias("code"), F.lit(False).alias("is_clubbed"),
    )
    units = both.unionByName(single)
    if files is not None:
        code = snippet(F.col("source"), snippet_lines)
        bare = files.withColumnRenamed("path", "file_path").join(functions.select("file_path").distinct(), "file_path", "left_anti").withColumn("code", code)
        bare = bare.where(F.regexp_replace("code", r"(?U)\s+", "") != "")
        units = units.unionByName(bare.select(
            "file_path", F.struct(F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("n")).alias("_order"), F.array(F.lit("<file-level>")).alias("function_names"),
            F.concat(F.lit("1-"), F.size(F.split("code", "\n", -1)).cast("string")).alias("line_range"), "code", F.lit(False).alias("is_clubbed"),
        ))
    return units.withColumn("relative_file", relative_posix(F.col("file_path"), F.lit(root)) if root else F.col("file_path"))


def file_stats(functions: DataFrame) -> DataFrame:
    """function_count, small_function_count, total_lines of each file."""
    return functions.groupBy("file_path").agg(
        F.count("*").alias("function_count"), F.count_if(F.col("is_small")).alias("small_function_count"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines")
    )


def functions_by_file(functions: DataFrame) -> DataFrame:
    """Function names of files keyed by base name; of files that share one, the last in path order stays."""
    base = F.element_at(F.split("file_path", "/"), -1)
    per = functions.groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("names"))
    return per.groupBy(base.alias("file_name")).agg(F.max_by("names", "file_path").alias("names"))
