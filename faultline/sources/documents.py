"""The documents that a run leaves: one JSON or text for each run, harness, patch or file, as rows (name, content) for `files.write_files`.

A document holds the lists of one run, which its budgets bound. Field names and their order are those that readers of the files expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import saved_patch_name
from ..operators.dedup import crash_clusters

# Names and fields of the files.
RUN = ["project", "run_id"]
_FINDING = ["tool", "check_id", "file", "line", "severity", "title", "detail", "evidence_path", "raw_payload"]
_CRASH = ["crash_id", "input_path", "input_size", "dedup_token", "harness", "timestamp", "signal", "stack_trace"]
_RESULT = ["finding_id", "vuln_type", "file_path", "line", "success", "error_message", "patch", "analysis", "fix_strategy", "attempts"]
_TEST = ["finding_id", "patch_applied", "build_success", "build_error", "patched_file_saved", "crashes_fixed", "crashes_remaining", "crash_tests"]
TRACE_CHARS = 500


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": "true"})


def _list(rows: DataFrame, keys: list[str], fields: list[str | Column], name: str, order: str = "seq") -> DataFrame:
    """keys and an array of the rows' fields in order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_r"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["_r"]).alias(name))


def _name(*parts: str | Column) -> Column:
    return F.concat(F.col("project"), F.lit("/"), F.col("run_id"), F.lit("/artifacts/"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _or_empty(name: str, like: DataFrame) -> Column:
    return F.coalesce(name, F.array().cast(like.schema[name].dataType)).alias(name)


def static_documents(batches: DataFrame, findings: DataFrame) -> DataFrame:
    """static_analysis.json of each batch (project, run_id, summary), with its findings in order of seq; the function name isn't kept."""
    listed = _list(findings, RUN, _FINDING, "findings")
    return batches.join(listed, RUN, "left").select(_name("static_analysis.json").alias("name"), _json(*RUN, "summary", _or_empty("findings", listed)).alias("content"))


def fuzzing_documents(batches: DataFrame, crashes: DataFrame) -> DataFrame:
    """<harness>_results.json of each batch (project, run_id, harness, fuzzer_binary, duration_seconds, seeds_initial, seeds_final, seeds_found, summary), traces cut, and
    fuzzing_results.json with the sums of a run and the crashes of all its harnesses, in order of harness and seq."""
    cut = F.coalesce(F.substring("stack_trace", 1, TRACE_CHARS), F.lit("")).alias("stack_trace")
    fields = ["project", "run_id", "harness", "fuzzer_binary", "duration_seconds", "seeds_initial", "seeds_final", "seeds_found", "crashes_found"]
    one = _list(crashes, [*RUN, "harness"], [*_CRASH[:-1], cut], "crashes")
    each = batches.join(one, [*RUN, "harness"], "left").withColumn("crashes", _or_empty("crashes", one)).withColumn("crashes_found", F.size("crashes"))
    sums = batches.groupBy(*RUN).agg(
        F.lit("all").alias("harness"), F.lit(None).cast("string").alias("fuzzer_binary"), F.sum("duration_seconds").alias("duration_seconds"), F.sum("seeds_initial").alias("seeds_initial"),
        F.sum("seeds_final").alias("seeds_final"), F.sum("seeds_found").alias("seeds_found"), F.array_join(F.sort_array(F.collect_list("summary")), "\n").alias("summary"),
    )
    every = _list(crashes.withColumn("_at", F.struct("harness", "seq")), RUN, [*_CRASH[:-1], cut], "crashes", "_at")
    whole = sums.join(every, RUN, "left").withColumn("crashes", _or_empty("crashes", every)).withColumn("crashes_found", F.size("crashes"))
    row = lambda df, file: df.select(_name("fuzzing/", file, "_results.json").alias("name"), _json(*fields, "crashes", "summary").alias("content"))
    return row(each, F.col("harness")).unionByName(row(whole, F.lit("fuzzing")))


def dedup_documents(crashes: DataFrame) -> DataFrame:
    """deduplicated_crashes.json of each run: representatives with whole traces in first-seen order, clusters by count, largest first."""
    keyed = crash_clusters(crashes, RUN)
    r = F.col("representative")
    unique = _list(keyed, RUN, [r[c].alias(c) for c in _CRASH], "unique_crashes", "first_seq")
    cluster = [F.col("cluster_key").alias("signature_hash"), r["signature"]["error_type"].alias("error_type"), r["signature"]["frames"].alias("frames"), F.col("crash_count").alias("count"), r["crash_id"].alias("representative_id")]
    ranked = _list(keyed.withColumn("_at", F.struct(-F.col("crash_count"), "first_seq")), RUN, cluster, "clusters", "_at")
    sums = keyed.groupBy(*RUN).agg(F.sum("crash_count").alias("total_crashes"), F.count("*").alias("unique_signatures"))
    sums = sums.withColumn("reduction_ratio", 1 - F.col("unique_signatures") / F.col("total_crashes"))
    rows = sums.join(unique, RUN).join(ranked, RUN)
    return rows.select(_name("fuzzing/deduplicated_crashes.json").alias("name"), _json("total_crashes", "unique_signatures", "reduction_ratio", "unique_crashes", "clusters").alias("content"))


def crash_logs(crashes: DataFrame, stamp: Column) -> DataFrame:
    """fuzzing/crashes.log of each run. Harnesses write it in turn, so it holds the crashes of the last one that has any, in order of harness."""
    last = crashes.groupBy(*RUN).agg(F.max("harness").alias("harness"))
    trace = F.when(F.coalesce("stack_trace", F.lit("")) != "", F.concat(F.lit("- Stack trace:\n```\n"), "stack_trace", F.lit("\n```\n"))).otherwise("")
    text = F.concat(
        F.lit("## Crash: "), "crash_id", F.lit("\n- Dedup token: "), "dedup_token", F.lit("\n- Signal: "), F.coalesce("signal", F.lit("")), F.lit("\n- Input size: "), F.col("input_size").cast("string"), F.lit(" bytes\n- Input path: "),
        "input_path", F.lit("\n"), trace, F.lit("\n"),
    )
    rows = _list(crashes.join(last, [*RUN, "harness"]).withColumn("_text", text), RUN, ["_text"], "x")
    return rows.select(_name("fuzzing/crashes.log").alias("name"), F.concat(F.lit("# Crashes found at "), stamp, F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["_text"]), "")).alias("content"))


def patching_documents(batches: DataFrame, results: DataFrame, tests: DataFrame) -> DataFrame:
    """patching/patching_results.json of each batch, with its results and tests in order of seq."""
    first, second = _list(results, RUN, _RESULT, "patcher_results"), _list(tests, RUN, _TEST, "test_results")
    fields = ["findings_processed", "patches_generated", "patches_applied", "patches_tested", "working_copy_path", "patched_files_path"]
    rows = batches.join(first, RUN, "left").join(second, RUN, "left")
    return rows.select(_name("patching/patching_results.json").alias("name"), _json(*RUN, *fields, _or_empty("patcher_results", first), _or_empty("test_results", second), "summary").alias("content"))


def patch_documents(results: DataFrame) -> DataFrame:
    """patching/patches/patch_<place>_<file>.patch of each result (project, run_id, seq from 0, file_path, patch) that has a patch."""
    return results.where("patch is not null").select(_name("patching/patches/patch_", (F.col("seq") + 1).cast("string"), "_", F.replace("file_path", F.lit("/"), F.lit("_")), ".patch").alias("name"), F.col("patch").alias("content"))


def snapshot_documents(files: DataFrame) -> DataFrame:
    """patching/patched_files/<saved name> of each patched file (project, run_id, patch_idx, file_path, finding_id, content)."""
    return files.select(_name("patching/patched_files/", saved_patch_name(F.col("patch_idx"), F.col("file_path"), F.col("finding_id"))).alias("name"), "content")
