"""Filters with ordered reasons, and lookups by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, is_c_cpp


def with_reason(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with `reason`, the first rule that holds, or null."""
    return rows.withColumn("reason", F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules]))


def any_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def candidate_files(files: DataFrame, build_dir: str | None = None, fuzz_targets: list[str] = (), harness_globs: list[str] = (), path: str = "path", rel: str = "rel") -> DataFrame:
    """files with `reason`: null for those to analyse."""
    built = F.lit(False) if not build_dir else (F.col(path) == build_dir) | F.col(path).startswith(build_dir.rstrip("/") + "/")
    targets = [(F.col(rel) == t) | F.col(rel).startswith(f"{t}/") for t in fuzz_targets]
    rules = [
        ("build_artifact", built | F.col(rel).startswith("objs/")), ("non-cpp", ~is_c_cpp(F.col(path))),
        ("fuzz_target", reduce(lambda a, b: a | b, targets, F.lit(False))), ("harness", any_glob(F.col(rel), list(harness_globs))),
    ]
    return with_reason(files, rules)


def selected_and_skipped(reasoned: DataFrame, limit: int | None = None, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Kept files and skipped ones as `rel:reason`. With a limit, files count in path order, and skips after the last kept file aren't told."""
    kept, skipped = reasoned.where("reason is null"), reasoned.where("reason is not null")
    if limit is not None:
        kept = kept.orderBy(path).limit(limit + 1)  # one more tells where the search stopped
        last = kept.agg(F.when(F.count("*") > limit, F.max(path)).alias("_last"))
        skipped = skipped.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(path) < F.col("_last"))).drop("_last")  # one row
        kept = kept.orderBy(path).limit(limit)
    return kept, skipped.withColumn("skipped", F.concat_ws(":", "rel", "reason"))


def skip_paths(files: DataFrame, fuzz_targets: list[str], harness_globs: list[str], path: str = "path", rel: str = "rel") -> DataFrame:
    """Paths that an analyser leaves out, distinct and sorted."""
    hit = F.col(rel).isin(list(fuzz_targets)) if fuzz_targets else F.lit(False)
    return files.where(hit | any_glob(F.col(rel), list(harness_globs))).select(path).distinct().orderBy(path)


def fuzz_sources(files: DataFrame, rel: str = "rel") -> DataFrame:
    """C sources to link with a harness: of src/, or of the root if there are none; not a main file nor a fuzzer."""
    name = F.lower(F.element_at(F.split(rel, "/"), -1))
    rows = files.where(F.col(rel).rlike(r"^(src/)?[^/]+\.c$")).withColumn("_src", F.col(rel).startswith("src/"))
    any_src = rows.agg(F.coalesce(F.bool_or("_src"), F.lit(False)).alias("_any"))
    rows = rows.crossJoin(F.broadcast(any_src)).where(F.col("_src") == F.col("_any"))  # one row
    return rows.where(~name.isin("main.c", "main.cpp") & ~name.contains("fuzzer")).drop("_src", "_any")


def copied(files: DataFrame, rel: str = "rel") -> DataFrame:
    """Files of a working copy: no artifacts, build outputs, caches or data."""
    part = r"(^|/)(__pycache__|\.git|build|data)(/|$)"
    return files.where(~F.col(rel).contains("artifacts") & ~F.col(rel).rlike(r"\.(o|a|so|pyc)$") & ~F.col(rel).rlike(part))


def harness_binary(harnesses: DataFrame, binaries: DataFrame, targets: list[str] = ()) -> DataFrame:
    """harnesses (harness) with `binary` of binaries (name, executable) by priority: exact, fuzzer_ prefix, name part with 'fuzzer', then the generic ones;
    null if there is none. binaries: a build folder's listing."""
    h, b = F.coalesce("harness", F.lit("")), F.col("name")
    stems = [t.rpartition("/")[2].rpartition(".")[0] or t.rpartition("/")[2] for t in targets]
    tests = [
        (h != "") & F.col("executable") & (b == h), (h != "") & F.col("executable") & (b == F.concat(F.lit("fuzzer_"), h)),
        (h != "") & F.col("executable") & b.contains(h) & F.lower(b).contains("fuzzer"),
        *[b == name for s in stems for name in (f"fuzzer_{s}", s)], b == "fuzzer", b == "fuzz_target", F.col("executable") & b.contains("fuzzer"), F.col("executable") & b.startswith("fuzz"),
    ]
    rank = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)])
    pairs = harnesses.select("harness").distinct().join(binaries, rank.isNotNull(), "left").withColumn("_rank", rank)
    best = pairs.groupBy("harness").agg(F.min_by("name", F.struct("_rank", "name")).alias("binary"))
    return harnesses.join(best, harnesses["harness"].eqNullSafe(best["harness"]), "left").select(harnesses["*"], "binary")


def first_existing(paths: DataFrame, candidates: list[str], path: str = "path") -> DataFrame:
    """The first candidate that is among the paths."""
    order = F.create_map(*[F.lit(x) for k, c in enumerate(candidates) for x in (c, k)])
    return paths.where(F.col(path).isin(candidates)).agg(F.min_by(path, order[F.col(path)]).alias(path))


def line_kinds(line: Column) -> Column:
    """struct of what a patch line is."""
    from .patches import HEADER

    header = line.startswith("--- ") | line.startswith("+++ ")
    return F.struct(
        header.alias("file_header"), line.rlike(HEADER).alias("hunk_header"), line.startswith(" ").alias("context"), ((line.startswith("+") | line.startswith("-")) & ~header).alias("edit")
    )
