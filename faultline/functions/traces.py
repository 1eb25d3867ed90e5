"""Expressions over sanitizer output: error types, frames, signatures, dedup tokens, signals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that results depend on.
INTERNAL_FUNCTIONS = ["printf", "sprintf", "fprintf", "snprintf", "vprintf", "malloc", "calloc", "realloc", "free", "operator new", "operator delete", "__libc_start_main", "_start", "start", "main"]
INTERNAL_PATTERNS = ["fuzzer::", "fuzzer::fuzzer", "sanitizer", "asan_", "__asan", "__ubsan", "__libc", "dyld", "fuzzermain", "fuzzerloop", "fuzzerdriver", "libclang_rt", "printf_common", "llvmfuzzertestoneinput"]
STOP_MARKERS = ["freed by thread", "previously allocated", "is located", "summary:"]
FRAME = r"(?idU)#\d+\s+0x[0-9a-f]+\s+in\s+(\S+)\s+(.+)"
FILE = r"(?iU)([^/\s]+\.[ch](?:pp|xx)?)"
FILE_LINE = FILE + r":(\d+)"
STDERR_SIGNALS = [("SIGSEGV", "SIGSEGV"), ("heap-use-after-free", "HEAP_UAF"), ("heap-buffer-overflow", "HEAP_BOF"), ("stack-buffer-overflow", "STACK_BOF"), ("double-free", "DOUBLE_FREE")]
NAME_SIGNALS = [("crash", "SIGSEGV"), ("oom", "OOM"), ("timeout", "TIMEOUT"), ("leak", "LEAK")]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def first_of(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The value of the first test that holds."""
    return F.coalesce(*[F.when(test, F.lit(value)) for test, value in pairs], otherwise)


def error_type(trace: Column) -> Column:
    named = F.nullif(F.regexp_extract(trace, r"(?U)ERROR:\s*\w*Sanitizer:\s*([^\s]+)", 1), F.lit(""))
    return F.coalesce(named, first_of([(trace.contains("SEGV"), "SEGV"), (trace.contains("SIGABRT"), "SIGABRT")], F.lit("unknown")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: within lambdas Spark computes each mention anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_internal_frame(func: Column, location: Column) -> Column:
    """Runtime and harness frames: by exact name before a bracket, or by a part of name and place."""
    base = F.trim(F.split_part(F.lower(func), F.lit("("), F.lit(1)))
    both = F.concat(F.lower(func), F.lit(" "), F.lower(location))
    return base.isin(INTERNAL_FUNCTIONS) | bound(both, lambda x: _any([x.contains(p) for p in INTERNAL_PATTERNS]))


def file_line(location: Column) -> Column:
    """file:line, or the file alone, or null."""
    both = F.concat(F.regexp_extract(location, FILE_LINE, 1), F.lit(":"), F.regexp_extract(location, FILE_LINE, 2))
    return F.coalesce(F.nullif(both, F.lit(":")), F.nullif(F.regexp_extract(location, FILE, 1), F.lit("")))


def frames(trace: Column, n: int = 3) -> Column:
    """The first n frames of the main trace that aren't internal, as function@file:line."""
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, line: Column) -> Column:
        frame = F.struct(F.regexp_extract(line, FRAME, 1).alias("func"), F.trim(F.regexp_extract(line, FRAME, 2)).alias("place"))
        opens = line.contains("ERROR:") & line.contains("Sanitizer")
        closes = bound(F.lower(line), lambda low: _any([low.contains(m) for m in STOP_MARKERS]))

        def state(on: Column, over: Column, got: Column) -> Column:
            return F.struct(on.alias("on"), over.alias("over"), got.alias("got"))

        def taken(x: Column) -> Column:
            label = F.concat_ws("@", x["func"], file_line(x["place"]))
            takes = (x["func"] != "") & ~is_internal_frame(x["func"], x["place"])
            return F.when(takes, state(F.lit(True), F.lit(False), F.concat(acc["got"], F.array(label)))).otherwise(acc)

        return (
            F.when(acc["over"], acc)
            .when(opens, state(F.lit(True), F.lit(False), acc["got"]))
            .when(~acc["on"], acc)
            .when(closes | (F.size(acc["got"]) >= n), state(F.lit(True), F.lit(True), acc["got"]))
            .when(~line.contains("#"), acc)
            .otherwise(bound(frame, taken))
        )

    return F.aggregate(F.split(trace, "\n", -1), start, step, lambda acc: acc["got"])


def signature(kind: Column, top: Column) -> Column:
    return F.substring(F.sha1(F.concat(kind, F.lit("|"), F.array_join(top, "|"))), 1, 16)


def crash_signature(trace: Column, n: int = 3) -> Column:
    both = F.struct(error_type(trace).alias("error_type"), frames(trace, n).alias("frames"))
    return bound(both, lambda x: F.struct(x["error_type"].alias("error_type"), x["frames"].alias("frames"), signature(x["error_type"], x["frames"]).alias("signature_hash")))


def isolated_trace(output: Column, limit: int = 60) -> Column:
    """The lines of the last sanitizer report in raw output up to its summary, `limit` at most. A later ERROR line starts anew."""
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, line: Column) -> Column:
        bare, low = F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), F.lower(line)
        tagged = bare.startswith("==") & F.substring(bare, 3, 1 << 30).contains("==")
        keeps = bare.startswith("#") | tagged | low.contains("freed by thread") | low.contains("previously allocated") | line.contains("is located")
        empty = (bare == "") & (F.size(acc["got"]) > 3)
        ends = line.contains("SUMMARY:") & ~empty

        def state(over: Column, got: Column) -> Column:
            return F.struct(F.lit(True).alias("on"), over.alias("over"), got.alias("got"))

        return (
            F.when(acc["over"], acc)
            .when(line.contains("ERROR:") & line.contains("Sanitizer"), state(F.lit(False), F.array(line)))
            .when(acc["on"] & keeps, state(F.lit(False), F.concat(acc["got"], F.array(line))))
            .when(acc["on"] & ends, state(F.lit(True), F.concat(acc["got"], F.array(line))))
            .otherwise(acc)
        )

    return F.array_join(F.slice(F.aggregate(F.split(output, "\n", -1), start, step, lambda acc: acc["got"]), 1, limit), "\n")


def name_signal(name: Column) -> Column:
    """The kind of a crash by the beginning of its file's name; empty if unknown."""
    return first_of([(F.lower(name).startswith(p), s) for p, s in NAME_SIGNALS], F.lit(""))


def stderr_signal(stderr: Column) -> Column:
    return first_of([(stderr.contains(p), s) for p, s in STDERR_SIGNALS], F.lit(None).cast("string"))


def dedup_token(name: Column, stderr: Column) -> Column:
    """What follows the first dash of the name, else the sanitizer's word, else the name; 16 characters at most of a name."""
    tail = F.substring(F.regexp_extract(name, r"(?s)^[^-]*-(.*)$", 1), 1, 16)
    word = F.nullif(F.regexp_extract(stderr, r"(?U)ERROR: \w+Sanitizer: (\w+)", 1), F.lit(""))
    return F.when(name.contains("-"), tail).otherwise(F.coalesce(word, F.nullif(F.substring(name, 1, 16), F.lit("")), F.lit("unknown")))


def sanitized_token(token: Column) -> Column:
    safe = F.when((F.char_length(token) > 64) | token.rlike(r'[<>:"/\\|?*]'), F.sha1(token)).otherwise(token)
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(safe)


def still_crashes(returncode: Column, stderr: Column, ran: Column) -> Column:
    """A run that didn't happen counts as a crash."""
    return F.coalesce(~ran | (returncode != 0) | stderr.contains("ERROR:") | stderr.contains("SUMMARY:"), F.lit(True))
