"""Signatures, frames and clusters on made-up sanitizer output."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.functions import traces as R
from faultline.operators import dedup
from faultline.schemas import CRASHES


def uaf(pid: int, base: str = "0x60200") -> str:
    return "\n".join([
        f"=={pid}==ERROR: AddressSanitizer: heap-use-after-free on address {base}0010 at pc {base}",
        f"READ of size 1 at {base}0010 thread T0",
        f"    #0 {base}00a1 in use_after_free_example /work/src/vuln.c:24:5",
        f"    #1 {base}00b2 in LLVMFuzzerTestOneInput /work/fuzz/vuln_fuzzer.c:11:3",
        f"    #2 {base}00c3 in fuzzer::Fuzzer::ExecuteCallback(unsigned char const*) FuzzerLoop.cpp:611:15",
        f"    #3 {base}00d4 in main FuzzerMain.cpp:20:10",
        f"{base}0010 is located 0 bytes inside of 16-byte region",
        "freed by thread T0 here:",
        f"    #0 {base}00e5 in helper_free /work/src/vuln.c:20:3",
        "SUMMARY: AddressSanitizer: heap-use-after-free",
    ])


def null_deref(pid: int) -> str:
    return f"=={pid}==ERROR: AddressSanitizer: SEGV on unknown address 0x0\n    #0 0x51 in null_deref /work/src/vuln.c:40:3\n    #1 0x52 in dispatch /work/src/main_loop.cpp:9\nSUMMARY: x"


def crash(seq, trace, size, token="t", harness="h"):
    return (f"crash{seq}", f"/c/{seq}", size, token, harness, datetime(2025, 1, 1), trace, "", seq)


def test_golden_signature(spark):
    row = spark.createDataFrame([(uaf(1),)], "t string").select(R.crash_signature(F.col("t")).alias("s")).first().s
    assert (row.error_type, row.frames, row.signature_hash) == ("heap-use-after-free", ["use_after_free_example@vuln.c:24"], "a88cb1d7581550df")


def test_signature_ignores_addresses_and_ids(spark):
    rows = spark.createDataFrame([(uaf(1),), (uaf(77, "0x70300"),), (null_deref(3),)], "t string").select(R.crash_signature(F.col("t"))["signature_hash"].alias("h")).collect()
    assert rows[0].h == rows[1].h != rows[2].h


@pytest.mark.parametrize("trace,want", [
    ("==1==ERROR: AddressSanitizer: attempting double-free on 0x1", "attempting"), ("x SEGV y", "SEGV"), ("SIGABRT", "SIGABRT"), ("nothing", "unknown"), ("", "unknown"),
])
def test_error_type(spark, trace, want):
    assert spark.createDataFrame([(trace,)], "t string").select(R.error_type(F.col("t"))).first()[0] == want


def test_internal_frames_and_locations(spark):
    cases = [("malloc", "x", True), ("operator new(unsigned long)", "x", True), ("__asan_memcpy", "x", True), ("f", "libclang_rt.asan.so", True), ("fuzzer::RunOneTest", "x", True), ("main", "a.c", True),
             ("process", "a.c:1", False), ("main_loop", "a.c", False), ("mymalloc", "a.c", False), ("parse", "src/p.cpp:3", False)]
    rows = spark.createDataFrame(cases, "f string, l string, want boolean").select(R.is_internal_frame(F.col("f"), F.col("l")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    places = [("/a/b/file.c:12:3", "file.c:12"), ("/a/file.cpp", "file.cpp"), ("x.hxx:7", "x.hxx:7"), ("(lib.so+0x12)", None), ("C:/A.C:9", "A.C:9")]
    rows = spark.createDataFrame(places, "l string, want string").select(R.file_line(F.col("l")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_three_frames_at_most_and_stop(spark):
    lines = ["==1==ERROR: AddressSanitizer: x", *[f"  #{i} 0xa{i} in f{i} /s/a.c:{i}" for i in range(6)]]
    frames = spark.createDataFrame([("\n".join(lines),)], "t string").select(R.frames(F.col("t"))).first()[0]
    assert frames == ["f0@a.c:0", "f1@a.c:1", "f2@a.c:2"]
    late = spark.createDataFrame([("  #0 0x1 in f /a.c:1\n",)], "t string").select(R.frames(F.col("t"))).first()[0]
    assert late == []


def test_isolated_trace_restarts_and_ends(spark):
    out = "noise\n==1==ERROR: AddressSanitizer: a\n  #0 0x1 in f a.c:1\n==1==ERROR: AddressSanitizer: b\n  #0 0x2 in g a.c:2\nplain\nSUMMARY: s\n  #1 0x3 in h a.c:3"
    got = spark.createDataFrame([(out,)], "t string").select(R.isolated_trace(F.col("t"))).first()[0]
    assert got == "==1==ERROR: AddressSanitizer: b\n  #0 0x2 in g a.c:2\nSUMMARY: s"


def test_tokens_and_signals(spark):
    rows = spark.createDataFrame([("crash-0123456789abcdefff", ""), ("plain", "ERROR: AddressSanitizer: heap-x"), ("averyveryverylongname", ""), ("", "")], "n string, e string")
    got = [r[0] for r in rows.select(R.dedup_token(F.col("n"), F.col("e"))).collect()]
    assert got == ["0123456789abcdef", "heap", "averyveryverylon", "unknown"]
    names = spark.createDataFrame([("Crash-1",), ("oom-1",), ("timeout-1",), ("leak-1",), ("x",)], "n string")
    assert [r[0] for r in names.select(R.name_signal(F.col("n"))).collect()] == ["SIGSEGV", "OOM", "TIMEOUT", "LEAK", ""]
    tokens = spark.createDataFrame([("",), ("ok",), ("a/b",), ("x" * 65,), (None,)], "t string")
    assert [r[0] for r in tokens.select(R.sanitized_token(F.col("t"))).collect()] == ["UNKNOWN", "ok", hashlib.sha1(b"a/b").hexdigest(), hashlib.sha1(b"x" * 65).hexdigest(), "UNKNOWN"]
    err = spark.createDataFrame([("double-free SIGSEGV",), ("heap-buffer-overflow",), ("none",)], "e string")
    assert [r[0] for r in err.select(R.stderr_signal(F.col("e"))).collect()] == ["SIGSEGV", "HEAP_BOF", None]


def test_clusters(spark):
    rows = [crash(0, uaf(1), 10), crash(1, uaf(2, "0x99900"), 5), crash(2, null_deref(3), 15)]
    groups = dedup.crash_clusters(spark.createDataFrame(rows, CRASHES)).orderBy("first_seq").collect()
    assert [(g.crash_count, g.representative.crash_id) for g in groups] == [(2, "crash1"), (1, "crash2")]


def test_representative_is_smallest_then_earliest(spark):
    df = spark.createDataFrame([crash(0, uaf(1), 100), crash(1, uaf(2), 5), crash(2, uaf(3), 50), crash(3, uaf(4), 5)], CRASHES)
    assert [r.crash_id for r in dedup.unique_crashes(df).collect()] == ["crash1"]


def test_no_trace_falls_back_to_token(spark):
    df = spark.createDataFrame([crash(0, "", 1, "token1"), crash(1, None, 2, "token1")], CRASHES)
    assert [(r.cluster_key, r.crash_count) for r in dedup.crash_clusters(df).collect()] == [("no_trace_token1", 2)]


def test_summary(spark):
    df = spark.createDataFrame([crash(i, uaf(i) if i % 3 != 2 else null_deref(i), i + 1) for i in range(100)], CRASHES)
    r = dedup.dedup_report(df).first()
    assert (r.total_crashes, r.unique_signatures, round(r.reduction_ratio, 9)) == (100, 2, 0.98)
    assert [c.crash_count for c in r.clusters] == [67, 33] and r.clusters[0].representative_id == "crash0"
    same = spark.createDataFrame([crash(i, uaf(i), 1) for i in range(97)], CRASHES)
    assert dedup.dedup_report(same).first().reduction_ratio == 0.9896907216494846
    none = dedup.dedup_report(spark.createDataFrame([], CRASHES)).first()
    assert (none.total_crashes, none.unique_signatures, none.reduction_ratio, none.clusters) == (0, 0, 0.0, [])
