"""Reports, file filters, sinks, registry."""

import json

import __spark_entry__
from pyspark.sql import functions as F

from faultline.config import Run, Target
from faultline.functions import text as T
from faultline.operators import findings, related, reports, selection, units
from faultline.schemas import FUNCTIONS
from faultline.sources import artifacts, sinks


def fun(file, seq, name, a, b):
    return (file, seq, name, a, b, "s", f"body {name}", (0, 1), b - a + 1 < 10)


def test_registry_is_consistent():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["signature_hash", "crash_count", "first_seq", "representative_id"]


def test_file_filters(spark):
    rel = ["src/main.c", "src/a.c", "src/b_fuzzer.c", "top.c", "src/deep/x.c", "artifacts/y.c", "x.o", "build/z.c", "data/q", ".git/h", "lib/ok.h"]
    df = spark.createDataFrame([(r,) for r in rel], "rel string")
    assert [r.rel for r in selection.fuzz_sources(df).collect()] == ["src/a.c"]
    assert [r.rel for r in selection.fuzz_sources(df.where("rel not like 'src/%'")).collect()] == ["top.c"]
    assert sorted(r.rel for r in selection.copied(df).collect()) == ["lib/ok.h", "src/a.c", "src/b_fuzzer.c", "src/deep/x.c", "src/main.c", "top.c"]
    paths = spark.createDataFrame([("build/compile_commands.json",), ("compile_commands.json",)], "path string")
    assert selection.first_existing(paths, ["out/cc.json", "compile_commands.json", "build/compile_commands.json"]).first()[0] == "compile_commands.json"


def test_globs(spark):
    cases = [("a/b_test.c", "*_test.c", True), ("b.c", "?.c", True), ("ab.c", "?.c", False), ("x1.c", "x[0-9].c", True), ("xa.c", "x[!0-9].c", True), ("x1.c", "x[!0-9].c", False), ("x[.c", "x[.c", True), ("a+b.c", "a+b.c", True)]
    for path, glob, want in cases:
        assert spark.createDataFrame([(path,)], "p string").select(selection.any_glob(F.col("p"), [glob])).first()[0] is want


def test_run_assembly(spark):
    runs = spark.createDataFrame([("p", "r1"), ("p", "r2")], "project string, run_id string")
    batches = spark.createDataFrame(
        [("p", "r1", "h1", 30.5, 1, 2, [("c1",), ("c2",)]), ("p", "r1", "h2", 31.0, 3, 4, [])],
        "project string, run_id string, harness string, duration_seconds double, seeds_initial bigint, seeds_found bigint, crashes array<struct<crash_id string>>",
    )
    totals = reports.fuzzing_totals(batches)
    none = totals.where("false").select("project", "run_id", F.lit(1).alias("patches"))
    got = {r.run_id: (r.crashes, r.duration_seconds, r.patches) for r in reports.assembled_runs(runs, runs.withColumn("static", F.lit(1)), totals, none).collect()}
    assert got == {"r1": (2, 61.5, None), "r2": (None, None, None)}
    assert [r.crash_id for r in reports.all_crashes(batches).orderBy("harness", "pos").collect()] == ["c1", "c2"]


def test_logs(spark, tmp_path):
    folder = tmp_path / "w/proj/20250101-000000/logs"
    folder.mkdir(parents=True)
    (folder / "run.log").write_text("[2025-01-01T00:00:01.500000+00:00] INFO started\nloose words\n")
    rows = reports.log_lines(artifacts.run_log(spark, str(folder / "run.log"))).orderBy("seq").collect()
    assert (rows[0].level, rows[0].message, rows[0].project, rows[0].run_id) == ("INFO", "started", "proj", "20250101-000000")
    assert rows[1].ts is None and rows[1].message == "loose words"
    events = rows[0:1]
    df = spark.createDataFrame([(events[0].ts, "info", "again")], "timestamp timestamp, level string, message string")
    sinks.append_events(df, str(tmp_path / "log"))
    assert reports.log_lines(spark.read.text(str(tmp_path / "log"))).first().message == "again"


def test_compile_commands(spark, tmp_path):
    entries = [{"directory": "/home/u/p", "file": "/home/u/p/a.c", "arguments": ["cc", "-I/home/u/p/inc"], "output": "a.o"}]
    (tmp_path / "cc.json").write_text(json.dumps(entries))
    row = artifacts.compile_commands(spark, str(tmp_path / "cc.json"), "/home/u/p").first()
    assert (row.directory, row.file, row.arguments) == ("/src", "/src/a.c", ["cc", "-I/src/inc"])
    exe = tmp_path / "b"
    exe.mkdir()
    (exe / "tool").write_text("x")
    (exe / "tool").chmod(0o755)
    (exe / "note").write_text("x")
    (exe / "note").chmod(0o644)
    assert {(r.name, r.executable) for r in artifacts.binaries(spark, str(exe)).collect()} == {("tool", True), ("note", False)}


def test_function_reports(spark):
    fs = spark.createDataFrame([fun("d/a.c", 1, "g", 9, 30), fun("d/a.c", 0, "f", 1, 3), fun("e/a.c", 0, "z", 1, 2)], FUNCTIONS)
    assert {r.file_path: r.report for r in reports.unit_report(fs).collect()}["d/a.c"] == "d/a.c\n  f [1-3] small\n  g [9-30]"
    assert {r.file_name: r.names for r in units.functions_by_file(fs).collect()} == {"a.c": ["z"]}


def test_highlights_and_summary(spark):
    df = spark.createDataFrame([("k", i, "x" * 300) for i in range(4)], "k string, seq int, t string")
    assert findings.highlights(df, ["k"], "t", "seq").first().highlights == ("x" * 300 + " | " + "x" * 300)[:500]
    text = spark.range(1).select(reports.static_summary(F.lit("a | b"), F.lit("P"), F.lit(2), F.lit("high:1"))).first()[0]
    assert text == "Static analysis for P inspected 2 snippets. Severity breakdown: high:1. Highlights: a | b"


def test_prompts(spark):
    df = spark.createDataFrame([("UAF", "high", "src/a.cpp", 3, "d", "f", None, "code")], "v string, s string, f string, l int, d string, n string, t string, c string")
    prompt = df.select(T.patch_prompt(*[F.col(c) for c in "vsfldntc"]).alias("p")).first().p
    assert "**Function:** f" in prompt and "Trace" not in prompt and prompt.endswith("```cpp\ncode\n```")
    made = spark.createDataFrame([(prompt,), ("x",)], "p string").select(T.placeholder_patch(F.col("p"))).collect()
    assert "file_path: src/a.cpp" in made[0][0] and "@@ -3,1 +3,1 @@" in made[0][0] and "unknown.c" in made[1][0]
    assert "Functions: f, g" in df.select(T.function_prompt(F.lit("p"), F.col("f"), F.array(F.lit("f"), F.lit("g")), F.lit("1-2"), F.col("c"), 3)).first()[0]


def test_grid_and_sinks(spark, tmp_path):
    patches = spark.createDataFrame([("r", 1), ("r", 2), ("q", 3)], "run_id string, patch_idx int")
    crashes = spark.createDataFrame([("r", "c1", ""), ("r", "c2", "h")], "run_id string, crash_id string, harness string")
    assert {(r.patch_idx, r.crash_id, r.harness) for r in related.verification_grid(patches, crashes).collect()} == {(p, c, h) for p in (1, 2) for c, h in (("c1", "unknown"), ("c2", "h"))}
    full = spark.createDataFrame([("c1", "/i", 3, "SIGSEGV", "t" * 900, "h1")], "crash_id string, input_path string, input_size bigint, signal string, stack_trace string, harness string")
    sinks.fuzzing_batches(full, str(tmp_path / "fb"))
    assert len(spark.read.json(str(tmp_path / "fb")).first().stack_trace) == 500
    sinks.crash_log(full, str(tmp_path / "cl"))
    assert spark.read.text(str(tmp_path / "cl"), wholetext=True).first()[0].startswith("Crash: c1\nInput: /i (3 bytes)")
    sinks.patch_files(spark.createDataFrame([("patch_000_a", "diff")], "name string, patch string"), str(tmp_path / "pf"))
    assert (next((tmp_path / "pf").glob("name=patch_000_a.patch/part*"))).read_text() == "diff\n"
    assert Run(Target("t", "/s", fuzz_targets=("f.c",))).target.fuzz_target == "f.c"


def test_highlights_skip_null_texts(spark):
    rows = [("k", i, None) for i in range(600)] + [("k", 600, "a"), ("k", 601, None), ("k", 602, "b"), ("none", 1, None), ("empty", 1, ""), (None, 1, "c")]
    got = findings.highlights(spark.createDataFrame(rows, "k string, seq int, t string"), ["k"], "t", "seq").collect()
    assert {r.k: r.highlights for r in got} == {"k": "a | b", "none": None, "empty": "", None: "c"}
