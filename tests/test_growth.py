"""Steps whose cost must not grow faster than their input: long batches, long lists."""

import random
import time

import pandas as pd
import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from faultline.functions import code, responses, traces
from faultline.operators import align, budget, dedup, patch_flow, related
from faultline.streaming import streams


# --- functions of many and long sources ---


def test_functions_leave_in_small_batches(spark, monkeypatch):
    """Batches are bounded by characters and rows, also within one source."""
    seen = []
    whole = pa.RecordBatch.from_arrays

    def noted(arrays, names):
        seen.append(len(arrays[0]))
        return whole(arrays, names)

    class Sources:
        schema = spark.createDataFrame([], "path string, source string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run, schema

    one = "".join(f"int f{i}(int a)\n{{\n  a += {i};\n}}\n" for i in range(10_000))
    monkeypatch.setattr(code.pa, "RecordBatch", type("B", (), {"from_arrays": staticmethod(noted)}))
    for mode in ("pattern", "syntax"):
        seen.clear()
        run, _ = code.functions(Sources(), mode=mode)
        rows = list(run([whole([pa.array(["a", "b", "c"]), pa.array([one, None, "int g(void) {\n}\n"])], ["path", "source"])]))
        assert sum(seen) == 10_001 and max(seen) <= code.ROWS and len(rows) == len(seen)


def test_functions_equal_those_of_parsed_files(spark):
    texts = ["int f(int a) {\n  if (a) {\n  }\n}\nint g(int b) {\n int x; {", "", None, "\n\nstatic int h(void)\n{ return 1; }\nint é(int x) { return 'é'; }\n", "x" * 10]
    rows = spark.createDataFrame(list(enumerate(texts)), "path int, source string")
    for mode in ("pattern", "syntax"):
        arrays = code.parsed_files(rows, mode=mode)
        want = arrays.select(F.col("path").alias("file_path"), F.explode("functions").alias("f")).select("file_path", "f.*").collect()
        got = code.functions(rows, mode=mode)
        assert got.schema["file_path"].dataType.simpleString() == "int" and sorted(got.collect()) == sorted(want) and len(want) == 3
        assert sorted(code.parse_errors(rows, mode=mode).select("path", "parse_errors").collect()) == sorted(arrays.select("path", "parse_errors").collect())


# --- the last crash at a place ---


def test_whole_crashes_are_taken_up_only_where_they_are_last(spark):
    """Of 60 crashes that name the place only the last ones reach the aggregate that holds whole crashes."""
    crashes = spark.range(60).select((F.col("id") % 30).alias("seq"), F.concat(F.lit("c"), "id").alias("crash_id"), F.when(F.col("id") == 29, "x /z.c:1 a.c:7").otherwise("#0 /a.c:7").alias("stack_trace"))
    odd = spark.createDataFrame([(None, "n", "only.c:3")], "seq bigint, crash_id string, stack_trace string")
    findings = spark.createDataFrame([(1, "src/a.c", 7), (2, "b.c", 7), (3, "only.c", 3), (4, None, 7), (5, "a.c", 7)], "id int, file string, line int")
    got = {r.id: r.crash and r.crash.crash_id for r in related.crash_at_location(findings, crashes.unionByName(odd)).collect()}
    assert got == {1: "c29", 2: None, 3: "n", 4: None, 5: "c29"}  # of two with the last number, the one that names it later in its trace
    plan = related.crash_at_location(findings, crashes)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(seq" in plan and plan.index("max_by") < plan.index("LeftSemi")


# --- the first place of a long key ---


def test_a_long_run_is_joined_with_its_stop_by_ranges(spark):
    """Without a broadcast join, no task gets the run: rows meet the place where it stops range by range."""
    rows = spark.range(20_000).select(F.lit("r").alias("run"), F.col("id").alias("seq"), F.lit(1).alias("words"), (F.col("id") != 15_000).alias("ok"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    kept = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        cut = budget.review_cutoff(rows, ["run"], "seq", "words", max_calls=12_000, max_tokens=10**9)
        streaks = budget.failure_streaks(rows.withColumn("ok", ~F.col("ok")), ["run"], "seq", "ok", 9_000)
        per = [max(r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()) for x in (cut, streaks)]
        got = {r.status: r.n for r in cut.groupBy("status").agg(F.count("*").alias("n")).collect()}
        stopped = streaks.where("stopped").agg(F.count("*"), F.min("seq")).first()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(per) < 15_000 and got == {"run": 12_000, "stopped": 1, "skipped": 7_999} and tuple(stopped) == (11_001, 8_999)


# --- many patches of a long file ---


def test_a_long_file_is_patched_as_a_short_one(monkeypatch):
    """The indexed form of a file gives the edits, spans and errors of the plain one, also where builds fail and lines are common."""
    rng = random.Random(5)
    words = ["", "}", "  else {", "a", align.GAP, align.NEW]
    line = lambda: rng.choice(words) if rng.random() < 0.3 else f"stmt_{rng.randint(0, 12)}(x);" if rng.random() < 0.5 else f"  y = {rng.randint(0, 300)}; // long"
    cases = []
    for _ in range(200):
        lines = [line() for _ in range(rng.choice([0, 1, 5, 40, 100]))]
        steps = []
        for k in range(6):
            at = rng.randint(0, max(0, len(lines) - 1))
            body = [rng.choice(" -+") + (lines[at + i] if at + i < len(lines) and rng.random() < 0.8 else line()) for i in range(rng.randint(1, 5))]
            steps.append((f"@@ -{at + 1} +1 @@\n" + "\n".join(body) + (f"\n@@ -{at + 1} +1 @@\n" + "\n".join(body[::-1]) if k % 3 == 0 else ""), rng.random() < 0.7))
        cases.append(("\n".join(lines) + rng.choice(["", "\n", "\n\n"]), steps))
    plain = [patch_flow.folded(*x) for x in cases]
    for owner, name, value in ((patch_flow.LongFile, "LINES", 0), (patch_flow.LongFile, "PATCHES", 0), (patch_flow.LongFile, "MANY", 2), (patch_flow.Blocks, "LEAST", 3)):
        monkeypatch.setattr(owner, name, value)
    assert [patch_flow.folded(*x) for x in cases] == plain
    assert sum(a for x in plain for a, *_ in x) > 200


def test_patches_of_a_long_file_cost_no_pass_over_it():
    """4000 patches of 200,000 lines: 800 million lines, were each to read the file."""
    lines = [f"row {i * 7} of customer {i % 977};" for i in range(200_000)]
    steps = [(f"@@ -{40 * k + 1} +1 @@\n {lines[40 * k]}\n-{lines[40 * k + 1]}\n+new {k}\n {lines[40 * k + 2]}", k % 4 != 1) for k in range(4000)]
    start = time.monotonic()
    done = patch_flow.folded("\n".join(lines), steps)
    assert time.monotonic() - start < 60
    assert all(edits[0][3:] == (40 * k, 40 * k + 3) for k, (_, _, _, edits) in enumerate(done))


# --- expressions and readers of many rows ---


def test_a_report_reads_its_crashes_once(spark):
    """The clusters are stored: the plan of the report holds no crash any more."""
    rows = spark.range(50).select(F.col("id").alias("seq"), F.concat(F.lit("c"), "id").alias("crash_id"), F.lit(1).alias("input_size"), F.lit("t").alias("dedup_token"), F.lit("==1==ERROR: AddressSanitizer: SEGV\n #0 0x1 in f /a.c:1").alias("stack_trace"))
    report = dedup.dedup_report(rows)
    assert "Range" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.first()["total_crashes"] == 50 and report.first()["clusters"][0]["frames"] == ["f@a.c:1"]


def test_a_frame_is_matched_once_for_all_its_tests(spark):
    """The two parts of a frame are each mentioned once in the fold over lines, not once for each internal pattern."""
    plan = spark.range(1).select(traces.frames(F.col("id").cast("string"))).alias("x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0x[0-9a-f]+") <= 4


@pytest.mark.parametrize("text", ["analysis: a\nfix_strategy: 012\nfile_path: yes\npatch: |\n  @@ -1 +1 @@\n  -a: [?\n  +!b\n", "analysis: |#x\n  y", "a:\tb", "a: !", "{a: b ? c}", "analysis: é\npatch: >-\n  x\n\n  y", "a: 2001-01-01", "p: |\n\tx", "a: ''", "", "x"])
def test_libyaml_reads_as_the_other(text):
    def got(read):
        try:
            return repr(read(text))
        except yaml.YAMLError:
            return "error"

    assert got(responses.loaded) == got(yaml.safe_load)


def test_usual_responses_are_read_by_libyaml(monkeypatch):
    if not yaml.__with_libyaml__:
        pytest.skip("no libyaml")
    monkeypatch.setattr(yaml, "safe_load", None)
    assert responses.loaded("analysis: it's bad, so (maybe) fix\npatch: |\n  @@ -1 +1 @@\n  -a\n  +b") == {"analysis": "it's bad, so (maybe) fix", "patch": "@@ -1 +1 @@\n-a\n+b"}


# --- admission to many buckets ---


class State:
    """A list state that counts its calls."""

    def __init__(self, ids=()):
        self.ids, self.calls = [(x,) for x in ids], 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return iter(self.ids)
            if name == "exists":
                return bool(self.ids)
            self.ids += args[0] if name == "appendList" else [args[0]]

        return call


@pytest.mark.parametrize("orders", [[3, 1, 2, 0, 1, 9], ["c", "a", "b", None, "a", "z"], [3.0, 1.0, 2.0, None, 1.0, 9.0]])
def test_admission_asks_for_its_state_twice(orders):
    admission = streams.Admission("id", "order", 4, None)
    frame = pd.DataFrame({"id": [30, 10, 20, 0, 10, 90], "order": orders, "n": range(6)})
    admission.ids = State(["20"])
    got = pd.concat(admission.handleInputRows((), iter([frame.iloc[:3], frame.iloc[3:]]), None))
    want = frame[frame["id"] != 20].sort_values("order", kind="stable").drop_duplicates("id").head(3)
    assert got.n.tolist() == want.n.tolist() and admission.ids.calls == 2
    assert admission.ids.ids == [("20",), *((str(x),) for x in want["id"])]
    assert list(admission.handleInputRows((), iter([frame]), None)) == [] and admission.ids.calls == 3
    admission.ids = State(["10"])
    admission.handleInitialState((), pd.DataFrame({"id": ["10", "11", "11", "12"]}), None)
    assert admission.ids.ids == [("10",), ("11",), ("12",)] and admission.ids.calls == 2


# --- folds of many short files ---


def test_alignments_follow_from_scores_and_are_made_once(monkeypatch):
    """Files of one form cost one table for each form of a patch, not one each; what is remembered equals what is computed."""
    made = []
    fill = align.Grid._fill
    monkeypatch.setattr(align.Grid, "_fill", lambda self, *a: made.append(1) or fill(self, *a))
    align._remembered.cache_clear()
    for k in range(1000, 1060):
        steps = [(f"@@ -1,2 +1,2 @@\n a{k}\n-original line\n+first\n omega_line", True), ("@@ -1,2 +1,2 @@\n-nothing like it is left here\n+third", True)]
        (one, two) = patch_flow.folded(f"a{k}\noriginal line\nomega_line\nthe end of it", steps)
        assert one == (True, True, None, [(0, 3, [f"a{k}", "first", "omega_line"], 0, 3)]) and two[:2] == (False, False) and "No good matches" in two[2]
    assert len(made) <= 4
    rng = random.Random(8)
    for _ in range(2000):
        text = lambda n: [rng.choice(["aaaa", "aaab", "bbbbbbbb", "", align.NEW, "aaaa1"]) for _ in range(rng.randint(1, n))]
        source, patch, stated = text(8), text(5), rng.choice([None, 1, 4])
        outcomes = []
        for f in (lambda: align.aligned(source, patch, stated), lambda: align._placed(len(source), *align.scored(source, patch), stated)):
            try:
                outcomes.append(f())
            except align.Unmatched as why:
                outcomes.append(str(why))
        assert outcomes[0] == outcomes[1]
        whole = [*patch, align.GAP]
        begun = align.beginnings(whole)
        assert align.told(source, patch) == {k: row for k, x in enumerate(source) if (row := align.scores(x, whole, begun))}


def test_patches_and_sources_meet_in_one_shuffle(spark):
    patches = spark.createDataFrame([("r", "f", 1, "p1", True), ("r", "f", 0, "p0", None), ("r", "g", 0, "x", True), (None, "f", 0, "x", True)], "run_id string, file_path string, seq bigint, patch string, build_success boolean")
    sources = spark.createDataFrame([("r", "f", "text"), ("r", "h", "alone"), (None, "f", "none"), ("s", "f", None)], "run_id string, file_path string, source string")
    lists = patch_flow._lists(patches.unionByName(patches.where("file_path = 'f'").withColumn("run_id", F.lit("s"))), sources)
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    steps = lambda r: [(x.seq, x.patch, x.build_success) for x in r.p]
    got = {(r.run_id, r.file_path, r.source): steps(r) for r in lists.collect()}
    assert got[("r", "f", "text")] == [(0, "p0", False), (1, "p1", True)] and set(got) == {("r", "f", "text"), ("s", "f", None)} and len(got[("s", "f", None)]) == 3


def test_long_files_fold_from_blocks(spark, monkeypatch):
    """Files that come in blocks, never as one value, fold as whole ones do; the last content is known by its hash. Odd ends of line too, and files with an index."""
    rng = random.Random(4)
    monkeypatch.setattr(patch_flow.Kept, "LINES", 7)
    texts = ["", "\n", "a\n", "a", "\n\n", "x\r\ny\r\nz\r\n", "one two\n three  four \nfive", "p\n\nq\n\n"]
    texts += ["\n".join(rng.choice(["alpha line", "beta line ", "", "gamma  line", f"row {k}"]) for k in range(rng.randint(1, 40))) + rng.choice(["", "\n", "\n\n"]) for _ in range(40)]
    sources, blocks, patches = [], [], []
    for f, text in enumerate(texts):
        lines = text.split("\n")
        sources.append(("r", str(f), text))
        n = rng.randint(1, 6)
        blocks += [("r", str(f), k // n, "\n".join(lines[k : k + n])) for k in range(0, len(lines), n)]
        for seq in range(rng.randint(1, 7)):
            k = rng.randrange(len(lines))
            near = [" " + x.rstrip("\r") for x in lines[k : k + 3]]
            patch = "\n".join([f"@@ -{k + 1},3 +1,3 @@", *near[:1], *[rng.choice(["", "-"]) + x[1:] if rng.random() < 0.4 else x for x in near[1:]], f"+new {seq}", *rng.choice([[], ["+"], ["+", "+"]])])
            patches.append(("r", str(f), seq, rng.choice([patch, patch, patch, "@@ -1 +1 @@\n-no such line at all here", "none"]), rng.choice([True, True, False, None])))
    given = spark.createDataFrame(patches, "run_id string, file_path string, seq bigint, patch string, build_success boolean")
    whole = spark.createDataFrame(sources, "run_id string, file_path string, source string")
    parts = spark.createDataFrame(blocks, "run_id string, file_path string, block bigint, text string").repartition(5)
    want = patch_flow.fold_edits(given, whole)
    last = {(r.file_path, r.seq): r.x for r in patch_flow.contents(want, whole, last=True).selectExpr("file_path", "seq", "sha2(content, 256) as x").collect()}
    got = patch_flow.fold_blocks(given, parts).collect()
    rows = lambda found: sorted((r.file_path, r.seq, r.patch_applied, r.retained, r.error or "", str(r.edits)) for r in found)
    assert rows(got) == rows(want.collect()) and any(r.retained for r in got)
    assert {(r.file_path, r.seq): r.last for r in got if r.last} == last and len(last) == len(texts)
    assert patch_flow.fold_blocks(given, parts.where("false")).count() == 0
    # the same in this process, with an index of each file
    monkeypatch.setattr(patch_flow.LongFile, "LINES", 1)
    monkeypatch.setattr(patch_flow.LongFile, "PATCHES", 1)
    monkeypatch.setattr(patch_flow.Blocks, "LEAST", 3)
    for _, f, text in sources:
        kept = patch_flow.Kept()
        for b in [b for b in blocks if b[1] == f]:
            kept.add(b[3])
        ended = kept.end()
        assert list(kept) == text.splitlines() == [kept[k] for k in range(len(kept))] and ended == text.endswith("\n")
        steps = [(p[3], bool(p[4])) for p in patches if p[1] == f]
        fold = patch_flow.Fold(kept, ended, len(steps))
        made = [x[:4] for x in fold.steps(steps)]
        assert [(r.patch_applied, r.retained, r.error, [tuple(e) for e in r.edits]) for r in sorted((r for r in got if r.file_path == f), key=lambda r: r.seq)] == made
        assert (fold.last() or kept.digest.hexdigest()) == last[(f, len(steps) - 1)]
