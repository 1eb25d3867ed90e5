"""Reading of model responses and analyser reports."""

import json

from pyspark.sql import functions as F

from faultline.functions import responses as P
from faultline.functions import text as T
from faultline.operators import findings, selection
from faultline.sources import artifacts, sinks


def parse(spark, *texts):
    df = spark.createDataFrame([(i, "def.c", t) for i, t in enumerate(texts)], "unit_id bigint, default_file string, response string")
    return P.response_findings(df).orderBy("unit_id", "pos").collect(), df


ITEM = {"check_id": "X", "severity": "HIGH", "file": "a.c", "line": 7, "title": "t", "detail": "d", "function_name": "f"}


def test_findings_in_all_wrappings(spark):
    body = json.dumps({"summary": "s", "findings": [ITEM]})
    rows, df = parse(spark, body, f"```json\n{body}\n```", f"Sure: {body} done", "no json", "{broken", "")
    assert [(r.unit_id, r.severity, r.line, r.file, r.function_name) for r in rows] == [(i, "high", 7, "a.c", "f") for i in range(3)]
    said = [r[0] for r in df.select(P.response_summary(F.col("response"))).collect()]
    assert said[:3] == ["s"] * 3 and said[3].startswith("JSON parse error")


def test_defaults_and_odd_items(spark):
    items = [{}, "text", 5, {"line": "12", "severity": "odd"}, {"line": "x"}, {"line": 3.9}, {"line": "3.9"}]
    rows, _ = parse(spark, json.dumps({"findings": items}), json.dumps({"findings": None}), json.dumps({"a": 1}))
    assert [r.line for r in rows] == [0, 12, 0, 3, 0]
    assert {r.severity for r in rows} == {"medium"} and {r.file for r in rows} == {"def.c"} and rows[0].check_id == "LLM_HEURISTIC" and rows[0].title == "Potential vulnerability"


YAML = "analysis: why\nfix_strategy: how\nfile_path: src/a.c\npatch: |\n  @@ -1,1 +1,1 @@\n  -a\n  +b\n"


def test_patches(spark):
    cases = [f"```yaml\n{YAML}```", f"text\n```YML\n{YAML}```", f"```\n{YAML}```", YAML, "nothing", "```yaml\nanalysis: x\n```", "```yaml\n: [bad\n```"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r string").select("i", P.parsed_patch(F.col("r")).alias("p")).orderBy("i").collect()
    assert [r.p.file_path for r in rows] == ["src/a.c"] * 4 + [None] * 3
    assert rows[0].p.patch == "@@ -1,1 +1,1 @@\n-a\n+b"  # a block's last line end goes with its fence


def test_unified_diff(spark):
    texts = ["x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n```", "@@ bad\n a\n+b\nprose\n```", "none", "@@ -1 +1 @@\n-a\n@@ -9 +9 @@\n+z"]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.unified_diff(F.col("t"))).collect()]
    assert rows == ["@@ -1,2 +1,2 @@\n a\n-b\n+c", "@@ bad\n a\n+b", None, "@@ -1 +1 @@\n-a\n@@ -9 +9 @@\n+z"]


def test_infer_report(spark, tmp_path):
    issues = [{"bug_type": "NULL_DEREF", "severity": "ERROR", "line": 3, "file": "a.c", "qualifier": "q", "bug_trace": [{"level": 0, "filename": "a.c", "line_number": 3, "column_number": 1, "description": "d"}]},
              {"severity": "MAJOR", "bug_type_hum": "Hum"}, {"severity": "BLOCKER"}, {"severity": "moderate"}, {}]
    (tmp_path / "report.json").write_text(json.dumps(issues))
    rows = findings.infer_findings(artifacts.infer_report(spark, str(tmp_path / "report.json")).drop("path")).orderBy("seq").collect()
    assert [r.severity for r in rows] == ["low", "high", "critical", "medium", "low"]
    assert (rows[0].check_id, rows[0].line, rows[1].title, rows[2].title, rows[4].file, rows[4].check_id) == ("NULL_DEREF", 3, "Hum", "Infer issue", "unknown", "UNKNOWN")
    assert json.loads(rows[0].detail)[0]["description"] == "d"


def test_union_keeps_order_and_duplicates(spark):
    a = spark.createDataFrame([("langchain-llm", 0), ("langchain-llm", 1)], "tool string, seq bigint")
    b = spark.createDataFrame([("infer", 0)], "tool string, seq bigint")
    u = findings.union_all(a, b)
    assert [r.tool for r in u.orderBy("seq").collect()] == ["langchain-llm", "langchain-llm", "infer"]
    assert tuple(findings.by_source(u).first()) == (2, 1, 3)


def test_breakdown(spark):
    df = spark.createDataFrame([("high", 0), ("low", 1), ("high", 2)], "s string, seq bigint")
    assert findings.breakdown(df, "s", "seq").first()[0] == "high:2, low:1"
    assert findings.breakdown(df.where("false"), "s", "seq").first()[0] == "no issues"


def test_heuristics_take_three_in_order(spark):
    df = spark.createDataFrame([("f.c", "malloc(1); printf(x); strcpy(a,b); free(p)"), ("g.c", "int x;")], "file_path string, code string")
    rows = findings.heuristic_findings(df).orderBy("pos").collect()
    assert [(r.check_id, r.severity) for r in rows] == [("BUFFER_OVERRUN", "high"), ("USE_AFTER_FREE", "medium"), ("FORMAT_STRING", "medium")]
    assert rows[1].title == "Potential Use After Free" and rows[1].detail.startswith("[OFFLINE] ")


def test_candidate_reasons(spark):
    rows = [("/p/build/x.c", "build/x.c"), ("/p/objs/y.c", "objs/y.c"), ("/p/README", "README"), ("/p/fuzz/t.c", "fuzz/t.c"), ("/p/h/a_harness.c", "h/a_harness.c"), ("/p/src/Z.CPP", "src/Z.CPP"), ("/p/src/a.c", "src/a.c")]
    df = selection.candidate_files(spark.createDataFrame(rows, "path string, rel string"), "/p/build", ["fuzz/t.c"], ["*_harness.c"])
    kept, skipped = selection.selected_and_skipped(df)
    assert [r.rel for r in kept.orderBy("rel").collect()] == ["src/Z.CPP", "src/a.c"]
    assert {r.skipped for r in skipped.collect()} == {"build/x.c:build_artifact", "objs/y.c:build_artifact", "README:non-cpp", "fuzz/t.c:fuzz_target", "h/a_harness.c:harness"}
    kept, _ = selection.selected_and_skipped(df, 1)
    assert kept.count() == 1


def test_binaries_by_priority(spark):
    b = spark.createDataFrame([("vuln", True), ("vuln_fuzzer", True), ("fuzzer_packet", True), ("old_tcp_fuzzer", True), ("fuzzer", False)], "name string, executable boolean")
    h = spark.createDataFrame([("vuln_fuzzer",), ("packet",), ("tcp",), ("none",), (None,)], "harness string")
    got = {r.harness: r.binary for r in selection.harness_binary(h, b).collect()}
    assert got == {"vuln_fuzzer": "vuln_fuzzer", "packet": "fuzzer_packet", "tcp": "old_tcp_fuzzer", "none": "fuzzer", None: "fuzzer"}


def test_scalar_text(spark):
    r = spark.createDataFrame([("a  b\u00a0c", "/r/x/y.HPP", "x.c:f()", "one two")], "l string, p string, f string, w string").select(
        T.normal_space(F.col("l")), T.language(F.col("p")), T.relative_posix(F.col("p"), F.lit("/r")), T.saved_patch_name(F.lit(3), F.col("p"), F.col("f")), T.token_estimate(F.col("w")),
        T.token_quarter(F.col("w"), F.col("f")), T.is_c_cpp(F.col("p")), T.harness_seconds(F.lit(100), F.lit(2)), T.harness_seconds(F.lit(10), F.lit(2)), T.finding_id(F.lit("t"), F.lit("c"), F.col("p"), F.lit(3)),
    ).first()
    assert tuple(r) == ("a b c", "cpp", "x/y.HPP", "patch_003__r_x_y.HPP_x_c_f__", 2.6, 3, True, 50, 30, "t:c:/r/x/y.HPP:3")


def test_lines_like_splitlines(spark):
    texts = ["a\nb\n", "a\r\nb\x0bc\x1cd\x85e", "", "\n", "x\u2028y\x0cz\rw", "a\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_lines(F.col("t")).alias("l")).collect()
    assert all(r.l == r.t.splitlines() for r in rows)


def test_context_and_offsets(spark):
    src = "\n".join(f"l{i}" for i in range(1, 8))
    df = spark.createDataFrame([(src,)], "s string")
    assert df.select(T.context_window(F.col("s"), F.lit(2), 1)).first()[0] == "   1    l1\n   2>>> l2\n   3    l3"
    assert df.select(T.context_window(F.col("s"), F.lit(7), 1)).first()[0] == "   6    l6\n   7>>> l7"
    assert df.select(T.context_window(F.col("s"), F.lit(50), 1)).first()[0] == ""
    assert df.select(T.line_of(F.col("s"), F.lit(3))).first()[0] == 2


def test_sinks_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("p", "r", "t", "a", "{}")], "project string, run_id string, tool string, action string, detail string").withColumn("timestamp", F.lit("2025-01-01").cast("timestamp"))
    for _ in range(2):
        sinks.append_tool_calls(calls, str(tmp_path / "calls"))
    assert artifacts.tool_calls(spark, str(tmp_path / "calls")).count() == 2
    (tmp_path / "c/h1/crashes/b1").mkdir(parents=True)
    (tmp_path / "c/h1/seeds").mkdir()
    (tmp_path / "c/h1/crashes/b1/id1").write_bytes(b"\xff\x00x")
    (tmp_path / "c/h1/seeds/s1").write_bytes(b"s")
    files = artifacts.corpus(spark, str(tmp_path / "c"))
    assert {(r.harness, r.kind, r.bucket, r.id, r.length) for r in files.collect()} == {("h1", "crashes", "b1", "id1", 3), ("h1", "seeds", None, "s1", 1)}
    assert artifacts.listed_crashes(files).first().dedup_token == "b1"
    tree = artifacts.source_text(spark, str(tmp_path / "c"))
    assert {r.rel for r in tree.collect()} == {"h1/crashes/b1/id1", "h1/seeds/s1"}
