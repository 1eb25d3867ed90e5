"""Corpus, joins, units, budgets, hunks, alignment, folds, streams."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions.code import functions, parse_functions
from faultline.operators import align, budget, corpus, patch_flow, patches, related, units
from faultline.schemas import FUNCTIONS
from faultline.streaming import streams


def test_first_k_and_duplicates(spark):
    df = spark.createDataFrame([("b", f"i{n % 7}", n) for n in range(20)] + [("c", "x", 99)], "bucket string, crash_id string, seq bigint")
    got = sorted((r.bucket, r.crash_id) for r in corpus.first_k(df, ["bucket"], "crash_id", "seq", 5).collect())
    assert got == [("b", f"i{n}") for n in range(5)] + [("c", "x")]
    known = spark.createDataFrame([("b", "i0"), ("b", "old1"), ("b", "old2")], "bucket string, crash_id string")
    got = sorted(r.crash_id for r in corpus.first_k(df, ["bucket"], "crash_id", "seq", 5, known).where("bucket = 'b'").collect())
    assert got == ["i1", "i2"]


def test_insert_sync_limit(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 3)], "id string, seq bigint")
    known = spark.createDataFrame([("c",)], "id string")
    assert sorted((r.id, r.seq) for r in corpus.idempotent_insert(df, "id", "seq", known).collect()) == [("a", 0), ("b", 1)]
    found = spark.createDataFrame([("s1",), ("s2",)], "name string")
    assert [r.name for r in corpus.new_seeds(found, spark.createDataFrame([("s1",)], "seed_id string")).collect()] == ["s2"]
    assert corpus.limited(df, "seq", 2).count() == 2 and corpus.limited(df, "seq", 0).count() == 4


def test_related_crash(spark):
    f = spark.createDataFrame([("a.c",), ("zzz.c",), ("b.c",)], "file string")
    c = spark.createDataFrame([("c0", "", 0), ("c1", "at b.c:1 a.c", 1), ("c2", "a.c", 2)], "crash_id string, stack_trace string, seq bigint")
    got = {r.file: r.crash.crash_id for r in related.related_crash(f, c).collect()}
    assert got == {"a.c": "c1", "zzz.c": "c0", "b.c": "c1"}
    assert related.related_crash(f, c.where("false")).first().crash is None


def test_crash_at_location_last_write_wins(spark):
    f = spark.createDataFrame([("src/a.c", 3), ("src/a.c", 4)], "file string, line int")
    c = spark.createDataFrame([("c0", "in f a.c:3 b.c:9", 0), ("c1", "a.c:3", 1)], "crash_id string, stack_trace string, seq bigint")
    got = {r.line: r.crash and r.crash.crash_id for r in related.crash_at_location(f, c).collect()}
    assert got == {3: "c1", 4: None}


def fun(file, seq, name, a, b):
    return (file, seq, name, a, b, "s", f"body {name}", (0, 1), b - a + 1 < 10)


def test_lookups(spark):
    fs = spark.createDataFrame([fun("f", 0, "outer", 1, 50), fun("f", 1, "inner", 10, 20), fun("g", 0, "g", 1, 5)], FUNCTIONS)
    pts = spark.createDataFrame([(1, "f", 12), (2, "f", 51), (3, "g", 5)], "id int, file_path string, line int")
    assert {r.id: r.function for r in related.function_at(pts, fs, ["id"]).collect()} == {1: "outer", 2: None, 3: "g"}
    assert sorted(r.name for r in related.functions_in_range(fs.where("file_path = 'f'"), 20, 30).collect()) == ["inner", "outer"]
    named = related.by_name(spark.createDataFrame([("f", "inner"), ("f", "no")], "file_path string, name string"), fs)
    assert {r.name: r.function and r.function.start_line for r in named.collect()} == {"inner": 10, "no": None}


def test_overlap_in_blocks_equals_plain(spark):
    rng = random.Random(2)
    mk = lambda n, s: [(rng.randint(0, 1), i, a := rng.randint(0, 300), a + rng.randint(0, 90)) for i in range(n)]
    a = spark.createDataFrame(mk(60, 0), "k int, a_id int, a0 int, a1 int")
    b = spark.createDataFrame(mk(60, 1), "k int, b_id int, b0 int, b1 int")
    pick = lambda d: sorted((r.a_id, r.b_id) for r in d.collect())
    assert pick(related.interval_overlap(a, b, ["k"], ("a0", "a1"), ("b0", "b1"))) == pick(related.bucketed_overlap(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 37))


def islands_by_hand(items, cap=50, gap=5):
    groups, cur, lines, last = [], [], 0, -1
    for seq, a, b in items:
        n = b - a + 1
        if n >= 10:
            groups, cur, lines, last = groups + [cur], [], 0, b
            continue
        if (last < 0 or a - last <= gap) and lines + n <= cap:
            cur, lines = cur + [seq], lines + n
        else:
            groups, cur, lines = groups + [cur], [seq], n
        last = b
    return [g for g in groups + [cur] if len(g) >= 2]


def test_islands_against_a_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for f in range(40):
        at, items = 1, []
        for s in range(rng.randint(0, 25)):
            a = at + rng.randint(0, 8)
            b = a + rng.randint(0, 12)
            items.append((s, a, b))
            at = b + 1
        rows += [fun(f"f{f}", s, f"n{s}", a, b) for s, a, b in items]
        want[f"f{f}"] = islands_by_hand(items)
    got = {}
    for r in units.clubbed(spark.createDataFrame(rows, FUNCTIONS), ["file_path"], "start_line", "end_line", "seq", F.col("is_small")).orderBy("file_path", "island").collect():
        got.setdefault(r.file_path, []).append(list(r.members))
    assert got == {k: v for k, v in want.items() if v}


def test_units(spark):
    fs = spark.createDataFrame([fun("f", 0, "s1", 1, 3), fun("f", 1, "s2", 5, 7), fun("f", 2, "big", 9, 40), fun("f", 3, "s3", 42, 44)], FUNCTIONS)
    files = spark.createDataFrame([("f", "x"), ("empty", "  \n"), ("plain", "int x;\nint y;")], "path string, source string")
    got = {tuple(r.function_names): (r.line_range, r.is_clubbed) for r in units.analysis_units(fs, files).collect()}
    assert got == {("s1", "s2"): ("1-3, 5-7", True), ("big",): ("9-40", False), ("s3",): ("42-44", False), ("<file-level>",): ("1-2", False)}
    assert tuple(units.file_stats(fs).first())[1:] == (4, 3, 41)


SOURCE = """#include <x.h>
static int add(int a, int b) {
    return a + b;
}

void nested(void)
{
    if (1) { while (0) { } }
}
inline int caf\u00e9_x(int q) { return q; }
int broken(int x) {
"""


def test_code_functions(spark):
    rows, errors = parse_functions(SOURCE)  # a blank line before a function counts to it
    assert [(r[1], r[2], r[3]) for r in rows] == [("add", 2, 4), ("nested", 5, 9), ("caf\u00e9_x", 10, 10)] and errors == ["Unmatched braces for function broken"]
    df = spark.createDataFrame([("a.c", SOURCE), ("e.c", ""), ("n.c", None)], "path string, source string")
    got = functions(df).orderBy("seq").collect()
    assert [g.name for g in got] == ["add", "nested", "caf\u00e9_x"] and got[0].signature == "static int add(int a, int b)" and got[0].is_small
    assert SOURCE[got[1].byte_range.start_byte : got[1].byte_range.end_byte] == got[1].body


def test_review_cutoff(spark):
    df = spark.createDataFrame([("r", i, 100, 1) for i in range(6)], "run string, seq int, words int, found int")
    tokens = [r.status for r in budget.review_cutoff(df, ["run"], "seq", "words", "found", max_tokens=600).orderBy("seq").collect()]
    assert tokens == ["run", "run", "offline", "skipped", "skipped", "skipped"]
    calls = [r.status for r in budget.review_cutoff(df, ["run"], "seq", "words", "found", max_calls=3).orderBy("seq").collect()]
    assert calls == ["run"] * 3 + ["stopped"] + ["skipped"] * 2
    found = [r.status for r in budget.review_cutoff(df, ["run"], "seq", "words", "found", max_findings=2).orderBy("seq").collect()]
    assert found == ["run"] * 2 + ["stopped"] + ["skipped"] * 3


def test_retries_streaks_last_good(spark):
    a = spark.createDataFrame([("f", 1, False), ("f", 2, True), ("f", 3, True), ("g", 1, False), ("h", 4, True)], "id string, n int, ok boolean")
    got = {r.id: (r.first_ok, r.success, r.attempts_made) for r in budget.first_success(a, ["id"], "n", "ok").collect()}
    assert got == {"f": (2, True, 2), "g": (None, False, 1)}
    s = spark.createDataFrame([("r", i, ok) for i, ok in enumerate([False, False, True, False, False, False, True])], "run string, seq int, ok boolean")
    rows = budget.failure_streaks(s, ["run"], "seq", "ok").orderBy("seq").collect()
    assert [r.streak for r in rows] == [1, 2, 0, 1, 2, 3, 0] and [r.stopped for r in rows] == [False] * 5 + [True] * 2
    t = spark.createDataFrame([("r", 0, True, 1, 2), ("r", 1, False, 0, 0)], "run string, patch_idx int, build_success boolean, crashes_fixed int, crashes_remaining int")
    c = spark.createDataFrame([("r",), ("r",), ("q",)], "run string")
    assert {r.run: (r.crashes_fixed, r.crashes_remaining) for r in patch_flow.final_state(t, c, ["run"]).collect()} == {"r": (1, 2), "q": (0, 1)}


PATCH = "--- a/x\n+++ b/x\n@@ -22,5 +22,5 @@\n ctx\n-old\n+new\n\n other\n@@ -30 +30 @@\n+tail\n"


def test_hunks(spark):
    df = spark.createDataFrame([(PATCH,), ("@@ -5 +5 @@\n x",), ("nothing",)], "p string")
    fuzzy, manual = df.select(patches.fuzzy_hunks(F.col("p"))).collect(), df.select(patches.manual_hunks(F.col("p"))).collect()
    assert [[(h.line_number, [tuple(e) for e in h.elines]) for h in r[0]] for r in fuzzy] == [align.hunks_of(PATCH), align.hunks_of("@@ -5 +5 @@\n x"), []]
    assert [h.line_number for h in manual[0][0]] == [22, 30] and [tuple(e) for e in manual[0][0][0].elines][3] == (" ", "")


def test_manual_application_and_validation(spark):
    src = "\n".join(f"l{i}" for i in range(1, 7))
    patch = "@@ -2,2 +2,2 @@\n l2\n-l3\n+L3\n@@ -5,1 +5,2 @@\n l5\n+l5b"
    df = spark.createDataFrame([(src, patch, True), (src, "bad", True), (src, "@@ -1 +1 @@\n // [OFFLINE] x", True), (src, "x", False)], "s string, p string, e boolean")
    rows = df.select(patches.apply_manually(F.col("s"), F.col("p")).alias("r"), patches.validation_errors(F.col("p"), F.lit("f.c"), F.col("e")).alias("v")).collect()
    assert rows[0].r.new_content == "l1\nl2\nL3\nl4\nl5\nl5b\nl6" and rows[0].v == []
    assert not rows[1].r.success and len(rows[1].v) == 2 and rows[2].v == ["Patch appears to be an offline placeholder"] and rows[3].v == ["Target file not found: f.c"]


def dp_score(a, b):
    """The line score by the full table, written apart from the closed form."""
    if a == b:
        return len(a).bit_length() ** 0.5 if a else 1.0
    cut = min(len(a), len(b), 5)
    if abs(len(a) - len(b)) > cut:
        return -0.5
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    t = np.add.outer(np.arange(len(a) + 1.0), np.arange(len(b) + 1.0))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = max(t[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 1.5), t[i - 1, j] + 1, t[i, j - 1] + 1)
        if all(t[i, j] >= cut for j in range(1, len(b) + 1)):
            return -0.5
    return min(len(a), len(b)).bit_length() ** 0.5 * (1 - t[-1, -1] / 5) ** 2


@settings(max_examples=400, deadline=None)
@given(st.text("ab1 ", max_size=9), st.text("ab1 ", max_size=9))
def test_closed_form(a, b):
    assert abs(align.line_score(a, b) - dp_score(a, b)) < 1e-12


def test_score_values_and_column(spark):
    pairs = [("free(ptr);", "free(ptr);"), ("", ""), ("abcde", "abcdX"), ("aaaa", "aaaab"), ("aaaab", "aaaa"), ("x", "yyyyyyyyy"), ("", "a")]
    want = [2.0, 1.0, 0.36, 0.0, -0.5]
    assert [round(align.line_score(a, b), 9) for a, b in pairs[:5]] == want
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", align.score_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.s - align.line_score(r.a, r.b)) < 1e-12 for r in rows)


C = "int f(void) {\n    int *p = malloc(4);\n    free(p);\n    *p = 3;\n    return 0;\n}\n"


def test_fuzzy_patch(spark):
    good = "@@ -1,6 +1,6 @@\n     int *p = malloc(4);\n     free(p);\n-    *p = 3;\n+    p = NULL;\n     return 0;"
    ok, text, *_ = align.fuzzy_patch(C, good)
    assert ok and text == C.replace("    *p = 3;", "    p = NULL;")
    assert align.fuzzy_patch(C, good.replace("-1,6 +1,6", "-90,6 +90,6"))[1] == text
    assert align.fuzzy_patch(C, good.replace("     int", " int"))[1] == text
    assert align.fuzzy_patch(C, "none")[2] == "No hunks found in patch"
    assert align.fuzzy_patch("x\ny", "@@ -1 +1 @@\n zzzzzzzz\n-qqqqqqqqq")[2].startswith("Failed to apply hunk 1: No good matches")
    thrice = "alpha beta\nomega gamma\n" * 3
    assert "matched 3 locations" in align.fuzzy_patch(thrice, "@@ -3,2 +3,2 @@\n alpha beta\n-omega gamma\n+new")[2]
    assert align.fuzzy_patch("", "@@ -0,0 +1 @@\n+a\n+b")[:2] == (True, "a\nb")
    df = spark.createDataFrame([(C, good), (C, "none"), (None, good)], "s string, p string")
    rows = df.select(align.applied(F.col("s"), F.col("p")).alias("r")).collect()
    assert rows[0].r.method == "fuzzy" and rows[0].r.new_content == text and not rows[1].r.success
    pairs = spark.createDataFrame([(C, "int *p = malloc(4);\nfree(p);", 2)], "s string, p string, e int").select(align.alignment_column(F.col("s"), F.col("p"), F.col("e"))).first()[0]
    assert [tuple(x) for x in pairs] == [(1, 0), (2, 1)]


def test_fold_rolls_back_failed_builds(spark):
    p1 = "@@ -3 +3 @@\n     free(p);\n-    *p = 3;\n+    p = NULL;"
    p2 = "@@ -4 +4 @@\n-    p = NULL;\n+    p = 0;\n     return 0;"
    rows = [("r", "f", 0, p1, False), ("r", "f", 1, p1, True), ("r", "f", 2, p2, True)]
    got = patch_flow.patch_fold(
        spark.createDataFrame(rows, "run_id string, file_path string, seq bigint, patch string, build_success boolean"), spark.createDataFrame([("r", "f", C)], "run_id string, file_path string, source string")
    ).orderBy("seq").collect()
    assert [(g.patch_applied, g.retained) for g in got] == [(True, False), (True, True), (True, True)] and "p = 0;" in got[2].content and "*p = 3" in got[0].content


def test_stream_equals_batch(spark, tmp_path):
    rows = [("b" if i % 4 else "c", f"i{i % 9}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "bucket string, id string, seq bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.drained(streams.capped_buckets(stream, ["bucket"], "id", "seq", 5), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = sorted((r.bucket, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.bucket, r.id) for r in corpus.first_k(df, ["bucket"], "id", "seq", 5).collect())


def test_stream_windows(spark, tmp_path):
    calls = spark.createDataFrame([(f"2025-01-01 00:0{i}:00", "t", "a") for i in range(3)] + [("2025-01-02 00:00:00", "t", "a")], "ts string, tool string, action string")
    calls = calls.select(F.col("ts").cast("timestamp").alias("timestamp"), F.lit("p").alias("project"), F.lit("r").alias("run_id"), "tool", "action", F.lit("{}").alias("detail"))
    calls.write.json(str(tmp_path / "in"))
    streams.drained(streams.windowed_calls(streams.tool_call_stream(spark, str(tmp_path / "in")), width="1 hour"), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]
