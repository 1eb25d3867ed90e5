"""The bounded forms of operators: against plain versions, and at sizes that the plain ones would not bear."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import code
from faultline.functions.definitions import parse_definitions
from faultline.operators import align, budget, patch_flow, related
from faultline.operators.intervals import point_in_interval
from faultline.operators.scan import scanned
from faultline.operators.substring import BLOCK, anchors, first_holders


# --- intervals ---


@pytest.mark.parametrize("width", [4096, 8, 5])
def test_first_interval_of_a_point(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice(["f", "g", None]), a := rng.randint(-300, 300), a + rng.choice([-1, 0, 0, 1, 7, 40, 500]), rng.choice([k // 3, k, None])) for k in range(400)]
    points = [(i, rng.choice(["f", "g", "h", None]), rng.choice([None, rng.randint(-320, 700)])) for i in range(500)]
    got = point_in_interval(spark.createDataFrame(points, "id int, file string, line int"), spark.createDataFrame(spans, "file string, a bigint, b bigint, n int"), ["file"], "line", "a", "b", "n", F.concat_ws("-", "a", "b"), "hit", width)
    rows = got.collect()
    assert len(rows) == 500
    for r in rows:
        held = [(n, a, b) for f, a, b, n in spans if f is not None and f == r.file and r.line is not None and n is not None and a <= r.line <= b]
        assert r.hit == ("-".join(map(str, min(held)[1:])) if held else None), r


def test_intervals_of_times_and_other_types(spark):
    stamps = spark.createDataFrame([(1, "2025-01-01 00:00:05"), (2, "2025-01-03 00:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("t"))
    spans = spark.createDataFrame([("2025-01-01", "2025-01-02", 1), ("2024-12-01", "2025-02-01", 2)], "a string, b string, n int").select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"), "n")
    got = point_in_interval(stamps.withColumn("k", F.lit(1)), spans.withColumn("k", F.lit(1)), ["k"], "t", "a", "b", "n", F.col("n"), "hit")
    assert {r.id: r.hit for r in got.collect()} == {1: 1, 2: 2}
    with pytest.raises(TypeError):
        point_in_interval(stamps.select(F.lit(0.5).alias("t"), F.lit(1).alias("k")), spans.withColumn("k", F.lit(1)), ["k"], "t", "a", "b", "n", F.col("n"), "hit")
    none = point_in_interval(stamps.withColumn("k", F.lit(1)), spans.withColumn("k", F.lit(1)).where("false"), ["k"], "t", "a", "b", "n", F.col("n"), "hit")
    assert [r.hit for r in none.collect()] == [None, None]


def test_one_file_with_100_000_intervals(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + F.when(F.col("id") % 100 == 0, 60_000).otherwise(F.col("id") % 5)).alias("b"), ((F.col("id") * 7919) % n).alias("n"))
    points = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 3 + 1).alias("line"))
    start = time.monotonic()
    got = point_in_interval(points, spans, ["file"], "line", "a", "b", "n", F.col("n"), "hit").agg(F.count("hit"), F.sum("hit")).first()
    assert time.monotonic() - start < 90
    best = {}
    long = [(3 * i, 3 * i + 60_000, i * 7919 % n) for i in range(0, n, 100)]
    total = count = 0
    a, b, order = (np.array(x) for x in zip(*long))
    for i in range(n):
        at = 3 * i + 1
        held = [j * 7919 % n for j in (i - 1, i) if j >= 0 and j % 100 and 3 * j <= at <= 3 * j + j % 5]
        inside = order[(a <= at) & (at <= b)]
        held += [int(inside.min())] if len(inside) else []
        count += bool(held)
        total += min(held) if held else 0
    assert tuple(got) == (count, total) and not best


# --- alignment ---


def plain_table(source, patch):
    """The whole table, cell by cell."""
    drop, table = [align.line_score(p, align.GAP) for p in patch], [[0.0] * (len(patch) + 1)]
    for line in source:
        row, skip = [0.0], align.line_score(line, align.GAP)
        for j, p in enumerate(patch):
            row.append(max(0.0, table[-1][j] + align.line_score(line, p), table[-1][j + 1] + skip, row[-1] + drop[j]))
        table.append(row)
    return table


@pytest.mark.parametrize("step", [2, 5, 512])
def test_grid_against_the_whole_table(monkeypatch, step):
    monkeypatch.setattr(align.Grid, "STEP", step)
    monkeypatch.setattr(align.Grid, "REMEMBERED", 7)
    rng = random.Random(step)
    words = ["a", "}", "", "x = 1;", "x = 2;", "call(one);", "call(two);", align.GAP, align.NEW, "else {", "a longer line"]
    for _ in range(300):
        source, patch = [rng.choice(words) for _ in range(rng.randint(1, 30))], [rng.choice(words) for _ in range(rng.randint(1, 6))]
        table = plain_table(source, patch)
        grid = align.Grid(source, patch, 10.0)
        top = max(map(max, table))
        cells = [(i, j) for i, row in enumerate(table) for j, x in enumerate(row) if x == top and top > 0]
        assert grid.top == top and grid.count == len(cells) and grid.first == (cells[0] if cells else None)
        assert grid.near == [c for c in cells if abs(10 - c[0]) < align.NEAR] and grid.far == sorted({i for i, _ in cells if abs(10 - i) >= align.NEAR})
        if not cells:
            continue
        total, last = 0.0, None
        for i, j in grid.path(cells[0], set()):  # the path's own scores add up to the highest value
            total += align.line_score(source[i], patch[j]) if i is not None and j is not None else align.line_score(source[i] if j is None else patch[j], align.GAP)
            last = (i, j)
        assert abs(total - top) < 1e-9 and last


def test_alignment_of_a_long_source_in_bounded_memory():
    source = "\n".join(f"stmt_{i}(order_{i % 97});" for i in range(100_000))
    patch = "@@ -9,3 +9,3 @@\n" + "\n".join([" stmt_70009(order_72);", "-stmt_70010(order_73);", "+changed", " stmt_70011(order_74);"])
    tracemalloc.start()
    ok, text, *_ = align.fuzzy_patch(source, patch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ok and text == source.replace("stmt_70010(order_73);", "changed") and peak < 40 << 20  # texts and lines; the table would have 5 rows of 100,000 numbers a hunk line more


# --- folds ---


def test_fold_as_edits_equals_patches_in_turn(spark):
    rng = random.Random(4)
    steps, sources, expected = [], [], []
    for f in range(60):
        n = rng.randint(0, 14)
        lines = [rng.choice(["", "}", f"stmt_{rng.randint(0, 9)}(x);", f"  y = {rng.randint(0, 5)};"]) for _ in range(n)]
        text = "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
        sources.append(("r", str(f), text))
        for k in range(rng.randint(1, 5)):
            at = rng.randint(0, max(0, n - 1))
            body = [rng.choice([" ", "-", "+"]) + (lines[at + i] if at + i < n and rng.random() < 0.8 else f"new {rng.randint(0, 9)}") for i in range(rng.randint(1, 4))]
            built = rng.random() < 0.7
            patch = f"@@ -{at + 1},3 +1,3 @@\n" + "\n".join(body)
            ok, new, error, *_ = align.fuzzy_patch(text, patch)
            text = new if ok and built else text
            steps.append(("r", str(f), k, patch, built))
            expected.append((str(f), k, ok, bool(ok and built), error, text))
    p = spark.createDataFrame(steps, "run_id string, file_path string, seq bigint, patch string, build_success boolean")
    s = spark.createDataFrame(sources, "run_id string, file_path string, source string")
    folded = patch_flow.fold_edits(p, s)
    got = patch_flow.contents(folded, s).collect()
    assert sorted((r.file_path, r.seq, r.patch_applied, r.retained, r.error, r.content) for r in got) == sorted(expected)
    last = {(f, k): t for f, k, *_, t in expected}
    final = {r.file_path: r.content for r in patch_flow.contents(folded, s, last=True).collect()}
    assert final == {f: last[f, max(k for g, k in last if g == f)] for f, _ in last}
    for r in folded.collect():
        n = len(dict((f, t) for _, f, t in sources)[r.file_path].splitlines())
        assert all(0 <= e.source_first <= e.source_last <= n for e in r.edits)


def test_spans_in_the_first_source():
    pieces = patch_flow.Pieces(10)
    assert pieces.replace(align.Edit(2, 4, ["a", "b", "c"]), 0) == (2, 4)
    assert pieces.replace(align.Edit(3, 4, ["x"]), 1) == (4, 4)  # within lines that a step has brought
    assert pieces.replace(align.Edit(4, 7, []), 2) == (4, 6)
    assert pieces.replace(align.Edit(0, 0, ["head"]), 3) == (0, 0)
    assert pieces.replace(align.Edit(len(range(9)), 9, ["end"]), 4)[1] <= 10


def test_1000_patches_of_a_long_file():
    n = 22_000
    lines = [f"stmt_{i}(order_{i % 97}, more_{i * 7});" for i in range(n)]
    steps = [(f"@@ -{20 * k + 1},3 +1,3 @@\n {lines[20 * k]}\n-{lines[20 * k + 1]}\n+changed {k}\n+second {k}\n {lines[20 * k + 2]}", k % 10 != 3) for k in range(1000)]
    start = time.monotonic()
    done = patch_flow.folded("\n".join(lines), steps)
    assert time.monotonic() - start < 300
    assert all(a for a, *_ in done) and max(len(str(x)) for x in done) < 400
    new = list(lines)
    for k in reversed(range(1000)):
        if k % 10 != 3:
            new[20 * k + 1 : 20 * k + 2] = [f"changed {k}", f"second {k}"]
    built = list(lines)
    for _, retained, _, edits in done:
        for at, gone, put, *_ in edits if retained else ():
            built[at : at + gone] = put
    assert built == new


# --- definitions ---

FORMS = [
    ("int plain(int a) {", "plain"), ("static inline unsigned long\ntwo(int (*call)(int), char c)\n{", "two"), ("void (*sig(int n, void (*f)(int)))(int) {", "sig"), ("handler_t (*get(int x))(int) {", "get"),
    ("int (wrapped)(int a) {", "wrapped"), ("T (wrapped2)(int a) {", "wrapped2"), ("__attribute__((noreturn)) void die(int x) __attribute__((cold)) {", "die"), ("int locked(int a) LOCKED(mu) NOTHROW {", "locked"),
    ("EXPORT(int) exported(int a) {", "exported"), ("static EXPORT(char *) exported2(int a) {", "exported2"), ("int kr(a, b) int a; char *b; {", "kr"), ("char *(*p2(void))[4] {", "p2"), ("[[nodiscard]] int attr(int a[static 3]) {", "attr"),
    ("struct point origin = {", None), ("int table[] = {", None), ("enum kind {", None), ("typedef struct {", None), ("struct s {", None), ("MODULE(x)\nint y;\nint after(void) {", "after"), ("int (*pointer)(int) = {", None), ("if (x) {", None),
]


@pytest.mark.parametrize("head, name", FORMS)
def test_forms_of_heads(head, name):
    source = f"int before;\n{head} a; }}\n;\nint next(void) {{ }}\n"
    rows, errors = parse_definitions(source)
    assert [r[1] for r in rows] == ([name] if name else []) + ["next"] and errors == []
    if name:
        assert source[rows[0][6][0] : rows[0][6][1]] == rows[0][5] and rows[0][5].endswith("a; }") and rows[0][4] == head.split("int y;\n")[-1].rstrip("{ \n")


def test_conditionals_with_unequal_braces():
    source = "#ifdef A\nint f(int a) {\n  if (a) {\n#elif B\nint f(long a) {\n  while (a) {\n    for (;;) {}\n#else\nint f(char a) {{\n#endif\n  }\n}\n#if X\nint x(void) { }\n#else\nint y(void) { }\n#endif\n#if 1\n#if 2\nint z(void) {\n#endif\n#endif\n}\n"
    rows, errors = parse_definitions(source)
    assert [(r[1], r[2], r[3]) for r in rows] == [("f", 2, 12), ("x", 14, 14), ("y", 16, 16), ("z", 20, 23)] and errors == []
    assert [r[1] for r in parse_definitions('extern "C" {\nint a(void) {}\n}\nnamespace n { int b() {} }\n')[0]] == ["a", "b"]
    assert parse_definitions("") == ([], []) and parse_definitions("int f(void) {")[1] == ["Unmatched braces for function f"] and parse_definitions("}}} int f(void) {}")[0][0][1] == "f"


def test_long_heads_and_many_blocks_in_linear_time():
    start = time.monotonic()
    assert parse_definitions("int f(" + "int a, " * 50_000 + "int b) { }")[0][0][1] == "f"
    assert parse_definitions("int f(" + ", ".join(f"a{i}" for i in range(2000)) + ") " + "".join(f"int a{i}; " for i in range(2000)) + "{ }")[0][0][1] == "f"
    assert len(parse_definitions("struct a { int x; } " * 20_000 + ";\nint g(void) {}")[0]) == 1
    assert len(parse_definitions("int f(int a) { if (a) { a++; } }\n" * 20_000)[0]) == 20_000
    assert time.monotonic() - start < 60


def test_table_function_equals_the_column(spark):
    sources = spark.createDataFrame([("a.c", "int f(void) { }\nint g(int a) {\n}\n"), ("b.c", ""), ("c.c", None), ("d.c", "int h(void) {")], "path string, source string")
    code.register(spark)
    got = spark.sql("select path, f.* from {s}, lateral c_functions(source) f", s=sources).drop("start_byte", "end_byte")
    want = code.functions(sources, mode="syntax").withColumnRenamed("file_path", "path").drop("byte_range")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() == 2


# --- needles ---


def test_needles_of_all_lengths(spark):
    rng = random.Random(9)
    alphabet = ["a", "b", "é", "/", ".", "世", "\x00"]
    word = lambda lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    texts = [(i, word(0, 60)) for i in range(80)] + [(80, None), (None, "aaaaaaaaaa"), (81, "x" * (BLOCK - 4) + "needle-over-the-edge")]
    needles = {word(1, 12) for _ in range(300)} | {t[5:30] for _, t in texts[:20] if len(t) > 12} | {"needle-over-the-edge", "eedle-ov", "", "no such needle in any text"}
    t = spark.createDataFrame(texts, "_seq bigint, _text string").repartition(3)
    got = {r.needle: r._seq for r in first_holders(t, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    want = {n: min((i for i, x in texts if i is not None and x is not None and n in x), default=None) for n in needles}
    assert got == {n: i for n, i in want.items() if i is not None}


def test_anchors_avoid_what_needles_share(spark):
    needles = [f"/src/lib/module/file{i:05d}.c" for i in range(50)]
    rows = anchors(spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert len(rows) == 50 and all(r.q == 8 for r in rows) and len({r.gram for r in rows}) == 50
    grid = spark.createDataFrame([(1, "x")], "patch_idx int, a string")
    with pytest.raises(ValueError):
        related.verification_grid(grid, spark.createDataFrame([("c", "h")], "crash_id string, harness string"))


# --- scans ---


def test_scans_against_loops(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "a", "b", "long", "long", "long"]), rng.choice([None, 1, 5, -2]), rng.random() < 0.3) for k in range(3000)]
    df = spark.createDataFrame(rows, "seq bigint, run string, n bigint, ok boolean").repartition(8)
    with_parts = df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scanned(df, ["run"], ["seq"], {"before": F.col("n"), "half": F.col("n") * F.lit(0.5)}, {"last_ok": F.col("ok")}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    got = {r.seq: (r.place, r.before, r.half, r.last_ok) for r in out}
    held = {}
    for k, run, n, ok in rows:
        place, total, last = held.get(run, (0, 0, 0))
        last = place + 1 if ok else last
        assert got[k] == (place + 1, total, total / 2, last), (k, run)
        held[run] = place + 1, total + (n or 0), last
    assert len(got) == 3000 and scanned(df.where("false"), ["run"], ["seq"], {"x": F.col("n")}).count() == 0
    assert scanned(df.limit(5), [], ["seq"], {"x": F.lit(1)}).agg(F.max("place")).first()[0] == 5


def test_one_run_is_spread_over_tasks(spark):
    calls = spark.range(200_000).select(F.lit("r").alias("run"), F.col("id").alias("seq"), (F.col("id") % 7).alias("words"), (F.col("id") % 50 != 0).alias("ok"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = budget.review_cutoff(calls, ["run"], "seq", "words", max_calls=150_000, max_tokens=10**9)
        per = [r[0] for r in cut.groupBy(F.spark_partition_id()).count().select("count").collect()]
        streaks = budget.failure_streaks(calls.withColumn("ok", ~F.col("ok")), ["run"], "seq", "ok", 49).agg(F.max("streak"), F.count_if("stopped")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.status: r.n for r in cut.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"run": 150_000, "stopped": 1, "skipped": 49_999}
    assert max(per) < 100_000 and tuple(streaks) == (49, 200_000 - 49)
