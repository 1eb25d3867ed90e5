"""Queries of the engine's own domain: traces, C sources, patches and responses composed from rows of the driver's tables.

What goes in is composed by expressions; the SQL states what must come out from the same parameters, without reading the composed texts, so a row differs if an
operator reads them wrongly. All run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import responses as P
from ..functions import text as T
from ..functions import traces as R
from ..operators import align, corpus, dedup, findings, patch_flow, patches, related, reports, selection, units
from ..scratch import folder
from ..sources import artifacts, sinks
from ..streaming import streams
from .catalogue import query, table

# --- traces of events ---

_KIND = "case event_type when 'signup' then 'heap-use-after-free' when 'purchase' then 'heap-buffer-overflow' when 'click' then 'double-free' when 'error' then 'SEGV' else 'unknown' end"
_TRACE = f"""case event_type when 'view' then '' when 'error' then 'SEGV on unknown address ' || event_id else
    'INFO: seed' || chr(10) || '    #0 0xaa in early /e.c:1' || chr(10) || '==7==ERROR: AddressSanitizer: ' || ({_KIND}) || ' on address 0x60' || event_id || chr(10)
    || '    #0 0x4f' || event_id || ' in __asan_memcpy /rt/asan_interceptors.cpp:12' || chr(10) || '    #1 0x50 in parse_' || (user_id % 5) || ' /src/lib/mod' || (event_id % 3) || '.c:' || (event_id % 40 + 1) || ':7'
    || chr(10) || '    #2 0x51 in main /src/main.c:3' || chr(10) || '    #3 0x52 in step_' || (event_id % 2) || '(int) (/bin/app+0x1f)' || chr(10) || '    #4 0x53 in walk /src/walk.hpp:9:1' || chr(10)
    || '    #5 0x54 in last /src/last.h:2' || chr(10) || 'freed by thread T0 here:' || chr(10) || '    #0 0x1 in hidden /src/hidden.c:1' || chr(10) || 'SUMMARY: AddressSanitizer' end"""
_SHORT = _TRACE.replace("'    #3", "'freed by thread T1 here:' || chr(10) || '    #3")
_TOP = "'parse_' || (user_id % 5) || '@mod' || (event_id % 3) || '.c:' || (event_id % 40 + 1) || '|step_' || (event_id % 2) || '(int)|walk@walk.hpp:9'"
_SIGNED = f"""select *, substr(sha1(kind || '|' || frames), 1, 16) as signature_hash, case when event_type = 'view' then 'no_trace_tok' || (user_id % 4) else substr(sha1(kind || '|' || frames), 1, 16) end as k,
    event_id * 7919 % 100 as size from (select *, {_KIND} as kind, case when event_type in ('view', 'error') then '' else {_TOP} end as frames from events)"""


def crashes(spark, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("crash_id"), (F.col("event_id") * 7919 % 100).alias("input_size"),
        F.expr("'tok' || (user_id % 4)").alias("dedup_token"), F.expr("'h' || (user_id % 3)").alias("harness"), F.expr(_TRACE).alias("stack_trace"),
    )


@query(f"select event_id, kind as error_type, frames, signature_hash from ({_SIGNED})")
def crash_signatures(spark, sf_dir):
    s = R.crash_signature(F.col("stack_trace"))
    return crashes(spark, sf_dir).select(F.col("seq").alias("event_id"), s["error_type"].alias("error_type"), F.array_join(s["frames"], "|").alias("frames"), s["signature_hash"].alias("signature_hash"))


@query(f"select event_id, case when event_type in ('view', 'error') then '' else split_part({_TOP}, '|', 1) end as frames from events")
def frames_before_a_stop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.frames(F.expr(_SHORT)), "|").alias("frames"))


@query(f"select k as cluster_key, count(*) as crash_count, min(event_id) as first_seq, 'c' || arg_min(event_id, size * 1000000000 + event_id) as representative_id from ({_SIGNED}) group by 1")
def crash_clusters(spark, sf_dir):
    return dedup.crash_clusters(crashes(spark, sf_dir)).select("cluster_key", "crash_count", "first_seq", F.col("representative.crash_id").alias("representative_id"))


@query(
    f"""select 'c' || arg_min(event_id, size * 1000000000 + event_id) as crash_id, min(size) as input_size, 'h' || (arg_min(user_id, size * 1000000000 + event_id) % 3) as harness from ({_SIGNED}) group by k"""
)
def unique_crashes(spark, sf_dir):
    return dedup.unique_crashes(crashes(spark, sf_dir)).select("crash_id", "input_size", "harness")


@query(
    f"""with g as (select k, count(*) as n, min(event_id) as f, any_value(kind) as kind from ({_SIGNED}) group by 1)
    select sum(n)::bigint as total_crashes, count(*) as unique_signatures, arg_max(k, n * 1000000000 - f) as top_key, max(n) as top_count, arg_max(kind, n * 1000000000 - f) as top_kind from g"""
)
def dedup_report(spark, sf_dir):
    top = F.col("clusters")[0]
    rows = dedup.dedup_report(crashes(spark, sf_dir))
    return rows.select("total_crashes", "unique_signatures", top["signature_hash"].alias("top_key"), top["crash_count"].alias("top_count"), top["error_type"].alias("top_kind"))


@query(
    """select event_id, array_to_string(list_slice(list_concat(['==1==ERROR: AddressSanitizer: x'], list_concat(list_transform(range(1, event_id % 80 + 2), lambda i: '    #' || i || ' 0x1 in f' || event_id || ' /a.c:' || i),
    ['freed by thread T0 here:', 'SUMMARY: AddressSanitizer: x'])), 1, 60), chr(10)) as trace from events"""
)
def isolated_traces(spark, sf_dir):
    shown = F.expr("array_join(transform(sequence(1, cast(event_id % 80 + 1 as int)), i -> '    #' || i || ' 0x1 in f' || event_id || ' /a.c:' || i), chr(10))")
    first, last = "run\n    #9 0x9 in no /n.c:1\n==1==ERROR: AddressSanitizer: old\n==1==ERROR: AddressSanitizer: x\n", "\nREAD of size 4\nfreed by thread T0 here:\nSUMMARY: AddressSanitizer: x\n    #0 0x1 in after /b.c:1"
    return table(spark, sf_dir, "events").select("event_id", R.isolated_trace(F.concat(F.lit(first), shown, F.lit(last))).alias("trace"))


_NAME = "(case event_id % 5 when 0 then 'crash-' when 1 then 'OOM-' when 2 then 'timeout-' when 3 then 'Leak-' else 'seed_' end) || sha1(event_type)"
_STDERR = "case event_id % 7 when 0 then 'got SIGSEGV' when 1 then 'ERROR: AddressSanitizer: heap-use-after-free' when 2 then 'x heap-buffer-overflow' when 3 then 'stack-buffer-overflow' when 4 then 'double-free' when 5 then '' else 'SUMMARY: done' end"
_CODE = "case event_id % 4 when 2 then -11 when 3 then 1 else 0 end"


@query(
    f"""select event_id, case event_id % 5 when 0 then 'SIGSEGV' when 1 then 'OOM' when 2 then 'TIMEOUT' when 3 then 'LEAK' else '' end as by_name,
    case event_id % 7 when 0 then 'SIGSEGV' when 1 then 'HEAP_UAF' when 2 then 'HEAP_BOF' when 3 then 'STACK_BOF' when 4 then 'DOUBLE_FREE' end as by_output,
    case when event_id % 5 < 4 then substr(sha1(event_type), 1, 16) when event_id % 7 = 1 then 'heap' else 'seed_' || substr(sha1(event_type), 1, 11) end as token,
    event_id % 11 = 0 or event_id % 4 in (2, 3) or event_id % 7 in (1, 6) as still_crashes from events"""
)
def crash_kinds(spark, sf_dir):
    name, err = F.expr(_NAME), F.expr(_STDERR)
    return table(spark, sf_dir, "events").select(
        "event_id", R.name_signal(name).alias("by_name"), R.stderr_signal(err).alias("by_output"), R.dedup_token(name, err).alias("token"),
        R.still_crashes(F.expr(_CODE), err, F.col("event_id") % 11 != 0).alias("still_crashes"),
    )


@query(
    f"""with c as (select event_id, 'mod' || (event_id % 3) as f, event_id % 40 + 1 as l from events where event_type not in ('view', 'error')),
    p as (select n_nationkey, 'mod' || (n_nationkey % 4) as f, n_nationkey % 30 + 1 as l from nation)
    select n_nationkey, 'c' || (select max(event_id) from c where c.f = p.f and c.l = p.l) as crash_id from p"""
)
def crash_locations(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("'/src/lib/mod' || (n_nationkey % 4) || '.c'").alias("file"), F.expr("n_nationkey % 30 + 1").cast("int").alias("line"))
    return related.crash_at_location(places, crashes(spark, sf_dir)).select("n_nationkey", F.col("crash.crash_id").alias("crash_id"))


# --- C sources: a file for each user, a function for each event of the user ---

_BODY = "event_id % 13"
_FUNCTIONS = f"""select user_id, event_id, n - 1 as seq, 1 + coalesce(sum({_BODY} + 5) over (partition by user_id order by n rows between unbounded preceding and 1 preceding), 0)::int as a, ({_BODY} + 4)::int as lines
    from (select *, row_number() over (partition by user_id order by event_id) as n from events)"""
_PLACED = f"select 'dir/u' || user_id || '.c' as file_path, seq, 'f' || event_id as name, a as start_line, a + lines - 1 as end_line, lines < 10 as is_small, user_id, event_id from ({_FUNCTIONS})"


def sources(spark, sf_dir: str) -> DataFrame:
    one = F.expr(f"'int f' || event_id || '(int a, char *b) {{' || chr(10) || repeat('    a += 1;' || chr(10), cast({_BODY} as int)) || '    if (a) {{' || chr(10) || '    }}' || chr(10) || '}}'")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", one.alias("f")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["f"]), "\n/* next */\n")
    broken = F.when(F.col("user_id") % 10 == 0, "\n/* next */\nint open_(int a) {\n").otherwise("\n")
    return rows.select(F.concat(F.lit("dir/u"), F.col("user_id").cast("string"), F.lit(".c")).alias("path"), F.concat(body, broken).alias("source"))


def source_rows(spark, sf_dir: str) -> DataFrame:
    return C.functions(sources(spark, sf_dir))


@query(f"select file_path, seq::bigint as seq, name, start_line, end_line, is_small, 'int ' || name || '(int a, char *b)' as signature from ({_PLACED})")
def source_functions(spark, sf_dir):
    return source_rows(spark, sf_dir).select("file_path", "seq", "name", "start_line", "end_line", "is_small", "signature")


@query(f"select file_path, seq::bigint as seq, name, start_line, end_line, is_small, 'int ' || name || '(int a, char *b)' as signature from ({_PLACED})")
def source_functions_by_syntax(spark, sf_dir):
    """The same with braces and heads in comments, strings and macros, which the syntax mode doesn't take for code."""
    hard = sources(spark, sf_dir).withColumn("source", F.replace("source", F.lit("    a += 1;"), F.lit("    s = \"} int g(int x) {\"; /* } */")))
    hard = hard.withColumn("source", F.replace("source", F.lit("/* next */"), F.lit("#define OPEN(x) int x(void) {")))
    return C.functions(hard, mode="syntax").select("file_path", "seq", "name", "start_line", "end_line", "is_small", "signature")


@query("select 'dir/u' || user_id || '.c' as path, case when user_id % 10 = 0 then 'Unmatched braces for function open_' end as error from (select distinct user_id from events)")
def source_errors(spark, sf_dir):
    return C.parse_errors(sources(spark, sf_dir)).select("path", F.try_element_at("parse_errors", F.lit(1)).alias("error"))


@query(
    f"""select file_path, count(*) as function_count, count(*) filter (where is_small) as small_function_count, sum(end_line - start_line + 1)::bigint as total_lines,
    'u' || any_value(user_id) || '.c:' || string_agg(name, ',' order by seq) as listed from ({_PLACED}) group by 1"""
)
def source_statistics(spark, sf_dir):
    rows = source_rows(spark, sf_dir)
    names = units.functions_by_file(rows).select(F.concat_ws(":", "file_name", F.array_join("names", ",")).alias("listed"), F.concat(F.lit("dir/"), "file_name").alias("file_path"))
    return units.file_stats(rows).join(names, "file_path").select("file_path", "function_count", "small_function_count", "total_lines", "listed")


@query(
    f"""with f as ({_PLACED}), e as (select event_id, 'dir/u' || user_id || '.c' as file_path, event_id % 300 + 1 as line, 'f' || (event_id - event_id % 2) as wanted from events)
    select e.event_id, any_value(f.name) filter (where e.line between f.start_line and f.end_line) as function, coalesce(any_value(f.start_line) filter (where f.name = e.wanted), -1) as wanted_line from e left join f using (file_path) group by 1"""
)
def function_lookups(spark, sf_dir):
    rows = source_rows(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select("event_id", F.expr("'dir/u' || user_id || '.c'").alias("file_path"), F.expr("cast(event_id % 300 + 1 as int)").alias("line"), F.expr("'f' || (event_id - event_id % 2)").alias("name"))
    at = related.function_at(ev.select("event_id", "file_path", "line"), rows, ["event_id"]).select("event_id", "function")
    named = related.by_name(ev.select("event_id", "file_path", "name"), rows).select("event_id", F.coalesce("function.start_line", F.lit(-1)).alias("wanted_line"))
    return at.join(named, "event_id")


@query(f"select file_path, name from ({_PLACED}) where start_line <= 40 and end_line >= 20")
def functions_in_lines(spark, sf_dir):
    return related.functions_in_range(source_rows(spark, sf_dir), 20, 40).select("file_path", "name")


@query(
    f"""with recursive e as (select file_path, seq + 1 as n, name, start_line as a, end_line as b, end_line - start_line + 1 as lines, is_small from ({_PLACED})),
    r as (select file_path, n, name, a, b, is_small, case when is_small then lines else 0 end as held, case when is_small then 0 else 1 end as run from e where n = 1
        union all select e.file_path, e.n, e.name, e.a, e.b, e.is_small, case when not e.is_small then 0 when e.a - r.b <= 5 and r.held + e.lines <= 50 then r.held + e.lines else e.lines end,
        case when not e.is_small then r.run + 1 when e.a - r.b <= 5 and r.held + e.lines <= 50 then r.run else r.run + 1 end from r join e on e.file_path = r.file_path and e.n = r.n + 1),
    g as (select file_path, run, count(*) as c, string_agg(name, ',' order by n) as function_names, string_agg(a || '-' || b, ', ' order by n) as line_range from r where is_small group by 1, 2 having count(*) > 1)
    select file_path, function_names, line_range, true as is_clubbed from g union all
    select r.file_path, name, a || '-' || b, false from r left join g on g.file_path = r.file_path and g.run = r.run and r.is_small where g.run is null"""
)
def analysis_units(spark, sf_dir):
    return units.analysis_units(source_rows(spark, sf_dir)).select("file_path", F.array_join("function_names", ",").alias("function_names"), "line_range", "is_clubbed")


# --- patches: a source of 40 lines for each order ---

_CASES = 8


def _stmt(i: str, extra: str = "") -> str:
    return f"'{extra}' || 'stmt_' || ({i}) || '(order_' || o_orderkey || ');'"


_LINE = "case when o_orderkey % 8 in (6, 7) and i in (33, 34, 35) then i - 30 else i end"
_NL = " || chr(10) || "
_PATCH = f"""case o_orderkey % 8
    when 0 then '--- a/f.c' || chr(10) || '+++ b/f.c' || chr(10) || '@@ -9,3 +9,3 @@' || chr(10) || ' ' || {_stmt("9")} || chr(10) || '-' || {_stmt("10")} || chr(10) || '+changed' || chr(10) || ' ' || {_stmt("11")}
    when 1 then '@@ -27,3 +27,3 @@' || chr(10) || ' ' || {_stmt("9")} || chr(10) || '-' || {_stmt("10")} || chr(10) || '+changed' || chr(10) || ' ' || {_stmt("11")}
    when 2 then '@@ -9,3 +9,3 @@' || chr(10) || '      ' || {_stmt("9")} || chr(10) || '-  ' || {_stmt("10")} || chr(10) || '+changed' || chr(10) || ' ' || {_stmt("11", "	")}
    when 3 then '@@ -9,3 +9,3 @@' || chr(10) || ' nothing like it stands here' || chr(10) || '-nor does this one, by far' || chr(10) || '+changed'
    when 4 then '@@ -9,3 +9,3 @@' || chr(10) || ' ' || {_stmt("9")} || chr(10) || '-' || {_stmt("10")} || chr(10) || '+changed' || chr(10) || ' ' || {_stmt("11")} || chr(10)
        || '@@ -20,2 +20,3 @@' || chr(10) || ' ' || {_stmt("20")} || chr(10) || '+added' || chr(10) || ' ' || {_stmt("21")}
    when 5 then 'no hunk at all'
    when 6 then '@@ -34,2 +34,2 @@' || chr(10) || ' ' || {_stmt("3")} || chr(10) || '-' || {_stmt("4")} || chr(10) || '+changed' || chr(10) || ' ' || {_stmt("5")}
    else '@@ -19,2 +19,2 @@' || chr(10) || ' ' || {_stmt("3")} || chr(10) || '-' || {_stmt("4")} || chr(10) || '+changed' || chr(10) || ' ' || {_stmt("5")} end"""


def _listed(change: str, add: str = "false") -> str:
    line = "case when o_orderkey % 8 in (6, 7) and i in (33, 34, 35) then i - 30 else i end"
    return f"array_to_string(list_transform(range(1, 41), lambda i: case when {change} then 'changed' else 'stmt_' || ({line}) || '(order_' || o_orderkey || ');' end || case when {add} then chr(10) || 'added' else '' end), chr(10))"


def _patched_sources(spark, sf_dir: str) -> DataFrame:
    source = F.expr(f"array_join(transform(sequence(1, 40), i -> 'stmt_' || ({_LINE}) || '(order_' || o_orderkey || ');'), chr(10))")
    return table(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"), F.expr(_PATCH).alias("patch"))


@query(
    f"""select o_orderkey, o_orderkey % 8 not in (3, 5, 7) as success, case o_orderkey % 8 when 3 then 'Failed to apply hunk 1: No good matches found - context lines don''t match source' when 5 then 'No hunks found in patch'
    when 7 then 'Failed to apply hunk 1: Context matched 2 locations. Please provide more context or verify context correctness.' end as error,
    case when o_orderkey % 8 in (3, 5, 7) then '' when o_orderkey % 8 = 4 then {_listed("i = 10", "i = 20")} when o_orderkey % 8 = 6 then {_listed("i = 34")} else {_listed("i = 10")} end as new_content from orders"""
)
def patch_alignment(spark, sf_dir):
    """Right and wrong line numbers, drifted white space, no match, two hunks, none, and two places of which the stated line is near one or neither."""
    return _patched_sources(spark, sf_dir).select("o_orderkey", align.fuzzy_patch_column(F.col("source"), F.col("patch")).alias("r")).select("o_orderkey", "r.success", "r.error", "r.new_content")


@query("select o_orderkey, case when o_orderkey % 8 in (3, 5, 7) then 'manual' else 'fuzzy' end as method, o_orderkey % 8 <> 5 as success, o_orderkey % 8 in (3, 7) as unverified from orders")
def patch_cascade(spark, sf_dir):
    rows = _patched_sources(spark, sf_dir).select("o_orderkey", align.applied(F.col("source"), F.col("patch")).alias("r"))
    return rows.select("o_orderkey", "r.method", "r.success", "r.unverified")


@query(
    """select o_orderkey, place, case place when 0 then 8 when 1 then 9 else -1 end as src from orders, (values (0), (1), (2)) v(place) where o_orderkey % 8 in (0, 1, 2, 4)
    union all select o_orderkey, 3, 10 from orders where o_orderkey % 8 in (0, 1, 2, 4)"""
)
def alignment_pairs(spark, sf_dir):
    """Places of the aligned lines of the first block: two lines, an inserted one, a line."""
    block = F.expr(f"{_stmt('9')} || chr(10) || {_stmt('10', '  ')} || chr(10) || '{align.NEW}' || chr(10) || {_stmt('11')}")
    rows = _patched_sources(spark, sf_dir).where("o_orderkey % 8 in (0, 1, 2, 4)").select("o_orderkey", F.posexplode(align.alignment_column(F.col("source"), block, F.lit(10))).alias("place", "x"))
    return rows.select("o_orderkey", "place", F.coalesce("x.src", F.lit(-1)).alias("src"))


@query(
    """select o_orderkey, seq, seq <> 3 as patch_applied, seq in (0, 2) as retained, 'a' || o_orderkey || chr(10) || case when seq < 2 then 'first' else 'second' end || chr(10) || 'omega_line' || chr(10) || 'the end of it' as content
    from orders, (values (0), (1), (2), (3)) v(seq)"""
)
def patch_folds(spark, sf_dir):
    """Four patches a file: one kept; one whose build fails; one on what the first left; one that can't apply any more."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit("f.c").alias("file_path"))
    head = F.concat(F.lit("@@ -1,2 +1,2 @@\n a"), "run_id", F.lit("\n"))
    steps = [("-original line\n+first\n omega_line", True), ("-first\n+rejected\n omega_line", False), ("-first\n+second\n omega_line", True), ("-nothing like it is left here\n+third\n neither is this line, at all", True)]
    rows = None
    for k, (text, built) in enumerate(steps):
        lead = head if k < 3 else F.lit("@@ -1,2 +1,2 @@\n")
        part = o.select("run_id", "file_path", F.lit(k).cast("bigint").alias("seq"), F.concat(lead, F.lit(text)).alias("patch"), F.lit(built).alias("build_success"))
        rows = part if rows is None else rows.unionByName(part)
    given = o.select("run_id", "file_path", F.concat(F.lit("a"), "run_id", F.lit("\noriginal line\nomega_line\nthe end of it")).alias("source"))
    got = patch_flow.patch_fold(rows, given)
    return got.select(F.col("run_id").cast("bigint").alias("o_orderkey"), F.col("seq").cast("int").alias("seq"), "patch_applied", "retained", "content")


@query(
    """select o_orderkey, v.hunk, case when o_orderkey % 3 = 0 and v.hunk = 1 then 1 else 5 + 20 * v.hunk end as line_number, case when v.hunk = 0 then ',+,,-,' else '+,-' end as fuzzy_signs,
    case when v.hunk = 0 then 'ctx|new ' || o_orderkey || '|bare|old|' else 'x|y' end as fuzzy_texts, case when v.hunk = 0 then ' ,+,-, ' else '+,-' end as manual_signs from orders, (values (0), (1)) v(hunk)"""
)
def hunk_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    second = F.when(F.col("o_orderkey") % 3 == 0, F.lit("@@ -1 +1 @@")).otherwise(F.lit("@@ -25,1 +25,1 @@"))
    patch = F.concat(F.lit("--- a/x\n+++ b/x\nlead\n@@ -5,3 +5,3 @@ where\n ctx\n+new "), F.col("o_orderkey").cast("string"), F.lit("\nbare\n-old\n\n"), second, F.lit("\n+x\n-y"))
    rows = o.select("o_orderkey", F.arrays_zip(patches.fuzzy_hunks(patch).alias("f"), patches.manual_hunks(patch).alias("m")).alias("h")).select("o_orderkey", F.posexplode("h").alias("hunk", "h"))
    joined = lambda side, field, sep: F.array_join(F.transform(f"h.{side}.elines", lambda e: e[field]), sep)
    return rows.select("o_orderkey", "hunk", F.col("h.f.line_number").alias("line_number"), joined("f", "op", ",").alias("fuzzy_signs"), joined("f", "text", "|").alias("fuzzy_texts"), joined("m", "op", ",").alias("manual_signs"))


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then '' when 1 then 'Patch does not contain valid hunk headers (@@ -...)|No valid hunk headers found in patch' when 2 then 'Patch appears to be an offline placeholder'
    else 'Target file not found: src/f.c' end as errors, case o_orderkey % 4 when 0 then '@@ -1 +1 @@' when 1 then ' int x;' when 2 then '+x' else ' ' end as cleaned from orders"""
)
def patch_checks(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    patch = F.when(k == 0, "@@ -1,2 +1,2 @@\n a\n-b\n+c").when(k == 1, "int x;").when(k == 2, "@@ -1,1 +1,1 @@\n// [OFFLINE] no changes").otherwise("x")
    line = F.when(k == 0, "@@ -1 +1 @@").when(k == 1, "int x;").when(k == 2, "+x").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(patches.validation_errors(patch, F.lit("src/f.c"), k != 3), "|").alias("errors"), patches.cleaned_line(line).alias("cleaned"))


# --- responses and prompts ---


@query(
    """select o_orderkey, case when o_orderkey % 5 < 3 then 'src/f' || o_orderkey || '.c' end as file_path, case when o_orderkey % 5 < 3 then 'step ' || o_orderkey end as analysis,
    case when o_orderkey % 5 < 3 then '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' || case o_orderkey % 5 when 2 then chr(10) else '' end end as patch, case when o_orderkey % 5 < 3 then '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' || case o_orderkey % 5 when 2 then chr(10) else '' end end as diff from orders"""
)
def patch_responses(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    yaml = F.concat(F.lit("analysis: step "), key, F.lit("\nfix_strategy: none\nfile_path: src/f"), key, F.lit(".c\npatch: |\n  @@ -1 +1 @@\n  -a\n  +b\n"))
    k = F.col("o_orderkey") % 5
    response = F.when(k == 0, F.concat(F.lit("So:\n```yaml\n"), yaml, F.lit("```\nbye"))).when(k == 1, F.concat(F.lit("```YML\n"), yaml, F.lit("```"))).when(k == 2, yaml).when(k == 3, "no patch at all").otherwise("```yaml\nanalysis: x\npatch: y\n```")
    got = table(spark, sf_dir, "orders").select("o_orderkey", P.parsed_patch(response).alias("p"))
    return got.select("o_orderkey", "p.file_path", "p.analysis", "p.patch", P.unified_diff(F.concat(F.lit("```diff\n"), F.col("p.patch"), F.lit("\n```"))).alias("diff"))


@query(
    """select n_nationkey, 'src/n' || n_nationkey || '.cpp' as file_path, '@@ -' || (n_nationkey + 1) || ',1 +' || (n_nationkey + 1) || ',1 @@' as header, 'cpp' as fence, n_nationkey % 2 = 0 as has_trace, '1,30,' || (40 + n_nationkey) as seconds,
    'infer:UAF:n' || n_nationkey || '.c:7' as finding_id, 'n.c:' || n_name as function_id, 12 as lines, false as small from nation"""
)
def prompts_and_ids(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    key = k.cast("string")
    prompt = T.patch_prompt(F.lit("UAF"), F.lit("high"), F.concat(F.lit("src/n"), key, F.lit(".cpp")), k + 1, F.lit("d"), F.lit(None).cast("string"), F.when(k % 2 == 0, F.lit("")), F.lit("code"))
    offline = P.parsed_patch(T.placeholder_patch(prompt))
    seconds = F.concat_ws(",", F.lit("1"), T.harness_seconds(F.lit(100), F.lit(9)).cast("string"), T.harness_seconds(2 * (40 + k), F.lit(2)).cast("string"))
    rows = n.select(
        "n_nationkey", offline.alias("p"), F.regexp_extract(prompt, r"```(\w+)\ncode", 1).alias("fence"), prompt.contains("**Trace:**\nN/A").alias("has_trace"), seconds.alias("seconds"),
        T.finding_id(F.lit("infer"), F.lit("UAF"), F.concat(F.lit("n"), key, F.lit(".c")), F.lit(7)).alias("finding_id"), T.function_prefix(F.lit("n.c"), F.col("n_name")).alias("function_id"),
        T.line_count(F.lit(3), F.lit(14)).alias("lines"), T.is_small(F.lit(3), F.lit(14)).alias("small"),
    )
    return rows.select("n_nationkey", "p.file_path", F.split("p.patch", "\n")[0].alias("header"), "fence", "has_trace", "seconds", "finding_id", "function_id", "lines", "small")


@query(
    """select doc_id, pos, check_id, title, detail from (select doc_id, row_number() over (partition by doc_id order by p) - 1 as pos, check_id, title, '[OFFLINE] ' || d as detail
    from documents, (values (1, 'BUFFER_OVERRUN', 'Potential Buffer Overrun', 'Unbounded string copy via strcpy'), (4, 'BUFFER_OVERRUN', 'Potential Buffer Overrun', 'Use of unsafe gets() function'),
    (6, 'USE_AFTER_FREE', 'Potential Use After Free', 'Memory deallocation - check for UAF'), (8, 'NULLPTR_DEREFERENCE', 'Potential Nullptr Dereference', 'Malloc call - check NULL return')) v(p, check_id, title, d)
    where (p = 1 and doc_id % 2 = 0) or (p = 4 and doc_id % 3 = 0) or (p = 6 and doc_id % 5 < 4) or (p = 8 and doc_id % 7 < 5)) where pos < 3"""
)
def offline_findings(spark, sf_dir):
    i = F.col("doc_id")
    code = F.concat(F.lit("x"), F.when(i % 7 < 5, " p = malloc(4);").otherwise(""), F.when(i % 5 < 4, " free(p);").otherwise(""), F.when(i % 3 == 0, " gets(b);").otherwise(""), F.when(i % 2 == 0, " strcpy(a, b);").otherwise(""))
    rows = findings.heuristic_findings(table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.lit("f.c").alias("file_path")).withColumnRenamed("doc_id", "file"), file="file")
    return rows.select(F.col("file").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), "check_id", "title", "detail")


# --- files and reports ---

_REL = "(case page_id % 6 when 0 then 'src/' when 1 then '' when 2 then 'lib/' when 3 then 'artifacts/' when 4 then 'src/' else 'build/' end) || (case page_id % 7 when 0 then 'main' when 1 then 'my_Fuzzer' else 'p' || page_id end) || (case page_id % 4 when 3 then '.o' else '.c' end)"


@query("select page_id, true as linked from pages where page_id % 6 in (0, 4) and page_id % 4 <> 3 and page_id % 7 not in (0, 1)")
def fuzz_sources(spark, sf_dir):
    return selection.fuzz_sources(table(spark, sf_dir, "pages").select("page_id", F.expr(_REL).alias("rel"))).select("page_id", F.lit(True).alias("linked"))


@query("select page_id, true as copied from pages where page_id % 6 in (0, 1, 2, 4) and page_id % 4 <> 3")
def working_copy(spark, sf_dir):
    return selection.copied(table(spark, sf_dir, "pages").select("page_id", F.expr(_REL).alias("rel"))).select("page_id", F.lit(True).alias("copied"))


@query(
    """select user_id, count(distinct event_type) as harnesses, count(*) as crashes, sum(seeds)::bigint as seeds_found, sum(distinct dur)::double as duration_seconds from
    (select *, case when row_number() over (partition by user_id, event_type order by event_id) = 1 then length(event_type) end as seeds, 30.0 as dur from events) group by 1""".replace("sum(distinct dur)", "30.0 * count(distinct event_type)")
)
def fuzzing_totals(spark, sf_dir):
    return reports.fuzzing_totals(_batches(spark, sf_dir)).select(F.col("run_id").cast("bigint").alias("user_id"), "harnesses", "crashes", "seeds_found", "duration_seconds")


def _batches(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("crashes"))
    return rows.select(F.lit("p").alias("project"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("harness"), "crashes", F.lit(0).cast("bigint").alias("seeds_initial"), F.length("event_type").cast("bigint").alias("seeds_found"), F.lit(30.0).alias("duration_seconds"))


@query("select user_id, (row_number() over (partition by user_id, event_type order by event_id) - 1)::int as pos, event_id from events")
def crashes_of_all_harnesses(spark, sf_dir):
    return reports.all_crashes(_batches(spark, sf_dir)).select(F.col("run_id").cast("bigint").alias("user_id"), "pos", "event_id")


@query("select (select count(distinct sha1(text)) from documents) as seed_count, (select count(distinct (user_id, event_type)) from events) as crash_count")
def corpus_sizes(spark, sf_dir):
    seeds = table(spark, sf_dir, "documents").select(F.sha1("text").alias("seed_id"))
    return corpus.counts(seeds, table(spark, sf_dir, "events").select(F.col("user_id").alias("bucket"), F.col("event_type").alias("crash_id")))


@query("select distinct sha1(text) as seed_id from documents where sha1(text) not in (select sha1(text) from documents where doc_id in (select doc_id from labels))")
def seeds_to_copy(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    present = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(F.sha1("text").alias("seed_id"))
    return corpus.known_ids(corpus.to_copy(docs.select(F.sha1("text").alias("seed_id")), present), "seed_id")


@query("select doc_id from documents order by doc_id limit 37")
def seeds_limited(spark, sf_dir):
    return corpus.limited(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 37)  # a limit is the operator


@query(
    """with f as (select url, row_number() over (order by url) as n from (select distinct url from pages where page_id % 3 <> 0))
    select 'kept' as what, url as text from f where n <= 20 union all select 'skipped', url || ':odd' from (select distinct url from pages where page_id % 3 = 0) where url < (select url from f where n = 21)"""
)
def files_limited(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("k")).select(F.col("url").alias("path"), F.col("url").alias("rel"), F.when(F.col("k") % 3 == 0, "odd").alias("reason"))
    kept, skipped = selection.selected_and_skipped(rows, 20)
    return kept.select(F.lit("kept").alias("what"), F.col("path").alias("text")).unionByName(skipped.select(F.lit("skipped").alias("what"), F.col("skipped").alias("text")))


@query("select count(*) filter (where event_type <> 'error') as llm_findings, count(*) filter (where event_type = 'error') as infer_findings, count(*) as total from events")
def findings_by_source(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "infer").otherwise("langchain-llm").alias("tool"), F.col("event_id").alias("seq"))
    return findings.by_source(findings.union_all(rows.where("tool = 'langchain-llm'"), rows.where("tool = 'infer'")))


# --- artifacts and streams: written to the shared folder, and read back by the scans ---


@query(
    """select n_nationkey, 'infer' as tool, case n_nationkey % 3 when 0 then 'UNKNOWN' else 'B' || n_nationkey end as check_id, case n_nationkey % 4 when 0 then 'unknown' else 'src/' || n_name end as file, case n_nationkey % 5 when 0 then 0 else n_nationkey end as line,
    case n_nationkey % 3 when 1 then 'high' else 'low' end as severity, case n_nationkey % 2 when 0 then 'Infer issue' else 'q' end as title from nation"""
)
def infer_reports(spark, sf_dir):
    k = F.col("n_nationkey")
    issue = F.to_json(F.struct(F.when(k % 3 != 0, F.concat(F.lit("B"), k.cast("string"))).alias("bug_type"), F.when(k % 2 == 1, "q").alias("qualifier"), F.when(k % 3 == 1, "MAJOR").when(k % 3 == 2, "ERROR").alias("severity"),
        F.when(k % 4 != 0, F.concat(F.lit("src/"), "n_name")).alias("file"), F.when(k % 5 != 0, k).alias("line"), F.col("n_name").alias("key")))
    path = folder(spark, "reports")
    text = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(issue)), ",\n"), F.lit("]"))
    table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.alias("value")).select("value").write.option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)  # a file for each region
    issues = artifacts.infer_report(spark, path)
    named = findings.infer_findings(issues).withColumn("n_name", F.get_json_object("raw_payload", "$.key"))
    return named.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name").select("n_nationkey", "tool", "check_id", "file", "line", "severity", "title")


@query("select user_id, event_type as tool, 'call' as action, event_id::varchar as detail from events where event_id % 2 = 0 union all select user_id, event_type, 'call', event_id::varchar from events where event_id % 2 = 1")
def tool_call_log(spark, sf_dir):
    """Appended twice, read by the scan."""
    path = folder(spark, "calls")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.lit("p").alias("project"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("tool"), F.lit("call").alias("action"), F.col("event_id").cast("string").alias("detail"))
    for k in range(2):
        sinks.append_tool_calls(rows.where(F.col("detail").cast("bigint") % 2 == k), path)
    return artifacts.tool_calls(spark, path).select(F.col("run_id").cast("bigint").alias("user_id"), "tool", "action", "detail")


@query("select o_orderkey, o_orderdate as ts, 'INFO' as level, 'order ' || o_orderkey as message from orders")
def event_log(spark, sf_dir):
    path = folder(spark, "log")
    sinks.append_events(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.lit("info").alias("level"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message")), path)
    rows = reports.log_lines(artifacts.run_log(spark, path))
    return rows.select(F.split("message", " ")[1].cast("bigint").alias("o_orderkey"), F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "message")


@query("select event_id, 'h' || (user_id % 3) as harness, event_id % 600 as kept from events where event_id % 600 <= 500 union all select event_id, 'h' || (user_id % 3), 500 from events where event_id % 600 > 500")
def fuzzing_files(spark, sf_dir):
    """Batches by harness with traces cut at 500 characters."""
    path = folder(spark, "fuzzing")
    rows = crashes(spark, sf_dir).withColumn("stack_trace", F.expr("repeat('x', cast(seq % 600 as int))"))
    sinks.fuzzing_batches(rows, path)
    read = spark.read.schema("seq bigint, stack_trace string, harness string").json(path)
    return read.select(F.col("seq").alias("event_id"), "harness", F.char_length("stack_trace").cast("bigint").alias("kept"))


@query("select sha1(text) as id, sha1(text) as content_hash from documents where doc_id not in (select doc_id from labels) and sha1(text) not in (select sha1(text) from documents where doc_id in (select doc_id from labels)) group by 1")
def seed_copies(spark, sf_dir):
    """Seeds that a target lacks are written; a second run writes nothing."""
    path, docs = folder(spark, "seeds"), table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("id"), F.encode("text", "UTF-8").alias("content"))
    held = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("id")
    files = docs.groupBy("id").agg(F.min("content").alias("content"))
    sinks.seeds(files, held, path)
    sinks.seeds(files, held.unionByName(spark.read.parquet(path).select("id")), path)
    return spark.read.parquet(path).select("id", T.content_id(F.col("content")).alias("content_hash"))


@query("select date_trunc('day', ts) as day, event_type as tool, count(*) as n from events group by 1, 2")
def windowed_calls_stream(spark, sf_dir):
    """The stream of tool calls, drained; the watermark is wider than the table, so nothing is late."""
    path = folder(spark, "stream")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("tool"), F.lit("x").alias("action"))
    rows.write.json(f"{path}/in")
    last = rows.limit(1).select((F.lit("2999-01-01").cast("timestamp")).alias("timestamp"), F.lit("end").alias("tool"), F.lit("x").alias("action"))
    calls = streams.windowed_calls(streams.tool_call_stream(spark, f"{path}/in").select("timestamp", "tool", "action"), "36500 days", "1 day")
    streams.drained(calls, f"{path}/state", f"{path}/out")
    last.write.mode("append").json(f"{path}/in")  # moves the watermark past all windows
    streams.drained(calls, f"{path}/state", f"{path}/out")
    streams.drained(calls, f"{path}/state", f"{path}/out")
    got = spark.read.parquet(f"{path}/out").where("tool <> 'end'")
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "tool", F.col("count").alias("n"))


@query("select user_id, event_type, count(*) as seen, least(count(*), 5) as admitted from events group by 1, 2")
def capped_buckets_stream(spark, sf_dir):
    path = folder(spark, "buckets")
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    ev.repartition(4).write.parquet(f"{path}/in")
    rows = spark.readStream.schema("user_id bigint, event_type string, event_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.drained(streams.capped_buckets(rows, ["user_id", "event_type"], "event_id", "event_id", 5), f"{path}/state", f"{path}/out")
    admitted = spark.read.parquet(f"{path}/out").groupBy("user_id", "event_type").agg(F.countDistinct("event_id").alias("admitted"))
    return ev.groupBy("user_id", "event_type").agg(F.count("*").alias("seen")).join(admitted, ["user_id", "event_type"]).select("user_id", "event_type", "seen", "admitted")
