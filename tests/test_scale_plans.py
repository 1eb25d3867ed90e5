"""Operators whose plans must stay linear: against plain versions, and at sizes that a quadratic plan would not bear."""

import random
import time

from pyspark.sql import functions as F

from faultline.functions.code import parse_definitions, parse_functions
from faultline.operators import align, related, units


def test_line_scores_against_the_plain_form(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 14)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 6)))
        pairs.append((a, b))
    long = "x" * 100_000
    pairs += [(long, long), (long + "abcd", long + "abce"), (long, long + "a"), (long + "a", long), ("y" + long, "z" + long), (long + "1234567", long)]
    df = spark.createDataFrame(pairs, "a string, b string")
    start = time.monotonic()
    rows = df.select("a", "b", align.score_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert time.monotonic() - start < 30
    assert all(abs(r.s - align.line_score(r.a, r.b)) < 1e-9 for r in rows) and len(rows) == len(pairs)


def test_islands_of_a_long_file(spark):
    rows = [("f", i, 10 * i, 10 * i + 5 + (4 if i % 1000 == 7 else 0), i % 5000 != 9) for i in range(60_000)] + [("g", 0, 1, 2, True), ("g", 1, 3, 4, True), ("h", 0, 1, 2, True), (None, 0, 1, 3, True), (None, 1, 4, 6, True)]
    df = spark.createDataFrame(rows, "k string, seq int, a int, b int, small boolean").repartition(3)
    got = {(r.k, r.island): r.members for r in units.clubbed(df, ["k"], "a", "b", "seq", F.col("small")).collect()}
    want, runs, held, last = {}, [[]], 0, None
    for k, seq, a, b, small in rows[:60_000]:
        n = b - a + 1
        if not small or last is None or a - last > 5 or held + n > 50:
            runs.append([])
            held = 0
        if small:
            runs[-1].append(seq)
            held += n
        last = b if small else None
    want = dict(enumerate(x for x in runs if len(x) > 1))
    assert {i: m for (k, i), m in got.items() if k == "f"} == want
    assert got[("g", 0)] == [0, 1] and got[(None, 0)] == [0, 1] and not any(k == "h" for k, _ in got)


def test_first_crash_that_holds_a_needle(spark):
    rng = random.Random(1)
    names = ["a.c", "ba.c", "src/a.c", "x", "", None, "zz", "é.c", "a.c "]
    crashes = [(i, None if i == 4 else "" if i == 5 else " ".join(rng.choice(["a.c", "cba.c:9", "src/a.c", "q", "é.c"]) for _ in range(rng.randint(0, 3)))) for i in range(30)]
    found = spark.createDataFrame([(i, n) for i, n in enumerate(names * 2)], "id int, file string")
    traces = spark.createDataFrame(crashes, "seq int, stack_trace string")
    for row in related.related_crash(found, traces).collect():
        hit = [i for i, t in crashes if t and row.file is not None and row.file in t]
        assert row.crash.seq == (min(hit) if hit else 0), row
    assert [r.crash for r in related.related_crash(found, traces.where("false")).collect()] == [None] * 18


def test_definitions_by_syntax():
    source = """
#include <x.h>
#define BEGIN int fake(void) { \\
    {
/* int old(int a) { */
static const char *text = "int not(int a) {";
struct point { int x; };
typedef struct { int y; } other;
int table[] = { 1, 2 };
enum kind { A, B };

static inline unsigned long
two_lines(int (*call)(int), char c)
{
    if (c == '{') { return call("}"); } // }
    return 0;
}
int kr(a, b)
    int a;
    char *b;
{
    while (a) { a--; }
}
struct point *make(void) { return 0; }
int open_(void) {
"""
    rows, errors = parse_definitions(source)
    lines = source.split("\n")
    assert [r[1] for r in rows] == ["two_lines", "kr", "make"] and errors == ["Unmatched braces for function open_"]
    assert all(lines[r[2] - 1] and r[5] == source[r[6][0] : r[6][1]] and r[5].endswith("}") for r in rows)
    assert rows[0][2:5] == (12, 17, "static inline unsigned long\ntwo_lines(int (*call)(int), char c)") and rows[1][4].startswith("int kr(a, b)")
    assert "kr" not in [r[1] for r in parse_functions(source)[0]] and parse_definitions("") == ([], [])
    start = time.monotonic()
    parse_definitions("int f(int a) { a++; }\n" * 20_000)
    assert time.monotonic() - start < 20
