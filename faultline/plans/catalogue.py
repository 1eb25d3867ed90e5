"""Queries that run the operators over the driver's tables, with the same in SQL.

The tables hold no crashes or findings, so each query is an analogue: the operator with its own parameters on a table of like shape. All run over
whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import functions as code_functions_of
from ..functions import responses as P
from ..functions import text as T
from ..functions import traces as R
from ..operators import align, budget, corpus, dedup, findings, patch_flow, patches, related, reports, selection, units
from ..streaming.streams import windowed_calls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYED = "select *, substr(sha1(lang || '|' || array_to_string(list_slice(string_split(text, chr(10)), 1, 3), '|')), 1, 16) as k from documents"


def _document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "n_chars", R.signature(F.col("lang"), F.slice(F.split("text", "\n", -1), 1, 3)).alias("signature_hash"))
    return dedup.clusters(rows, "signature_hash", "n_chars", "doc_id", ["doc_id", "n_chars"])


@query(f"select k as signature_hash, count(*) as crash_count, min(doc_id) as first_seq, arg_min(doc_id, n_chars * 1000000000 + doc_id) as representative_id from ({_KEYED}) group by k")
def sig_dedup_representative(spark, sf_dir):
    return _document_clusters(spark, sf_dir).select("signature_hash", "crash_count", "first_seq", F.col("representative.doc_id").alias("representative_id"))


@query(f"select count(*) as total_crashes, count(distinct k) as unique_signatures, round(1 - count(distinct k) / count(*), 9) as reduction_ratio from ({_KEYED})")
def sig_dedup_summary(spark, sf_dir):
    return dedup.summary_of(_document_clusters(spark, sf_dir)).withColumn("reduction_ratio", F.round("reduction_ratio", 9))


@query(
    f"""select row_number() over (order by n desc, first_seq) as place, k as signature_hash, n as crash_count
    from (select k, count(*) as n, min(doc_id) as first_seq from ({_KEYED}) group by k) order by n desc, first_seq limit 20"""
)
def sig_dedup_top(spark, sf_dir):
    top = dedup.ranked_clusters(_document_clusters(spark, sf_dir)).limit(20)  # a top-k report
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(F.desc("crash_count"), "first_seq")).cast("bigint").alias("place"), "signature_hash", "crash_count")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) <= 5")
def bucket_first_k(spark, sf_dir):
    return corpus.first_k(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts", 5).select("user_id", "event_type", "event_id")


@query("select sha1(text) as content_id, min(doc_id) as doc_id from documents group by 1")
def content_idempotent_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(T.content_id(F.encode("text", "UTF-8")).alias("content_id"), "doc_id")
    return corpus.idempotent_insert(rows.withColumn("seq", F.col("doc_id")), "content_id").select("content_id", "doc_id")


@query("select sha1(text) as seed_id, arg_min(source, doc_id) as source, arg_min(n_chars, doc_id) as size from documents where sha1(text) not in (select sha1(text) from benchmark) group by 1")
def seed_insert_known(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha1("text").alias("seed_id"), "source", F.col("n_chars").alias("size"), F.col("doc_id").alias("seq"))
    known = table(spark, sf_dir, "benchmark").select(F.sha1("text").alias("seed_id"))
    return corpus.idempotent_insert(rows, "seed_id", "seq", known).select("seed_id", "source", "size")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def seed_sync_anti(spark, sf_dir):
    return corpus.new_seeds(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


_SEVERITY = "case lower(split_part(o_orderpriority, '-', 2)) when 'medium' then 'medium' when 'high' then 'high' when 'urgent' then 'low' else 'low' end"


@query(f"select o_orderkey, {_SEVERITY} as severity from orders")
def severity_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.infer_severity(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("severity"))


@query(f"select {_SEVERITY} as severity, count(*) as n, min(o_orderkey) as first_seq from orders group by 1")
def severity_hist(spark, sf_dir):
    return findings.histogram(severity_map(spark, sf_dir), "severity", "o_orderkey")


@query(
    f"""select string_agg(severity || ':' || n, ', ' order by f) as breakdown
    from (select {_SEVERITY} as severity, count(*) as n, min(o_orderkey) as f from orders group by 1)"""
)
def severity_breakdown(spark, sf_dir):
    return findings.breakdown(severity_map(spark, sf_dir), "severity", "o_orderkey")


_REASON = """case when contains(url, '/objs/') or contains(url, '?page=1') then 'build_artifact' when not regexp_matches(url, '/(en|fr|de)/') then 'non-cpp'
    when starts_with(url, 'http://th') then 'fuzz_target' when regexp_matches(url, '^http.*ref=[xy]$') then 'harness' end"""


@query(f"select page_id, {_REASON} as reason from pages")
def reasoned_filter(spark, sf_dir):
    u = F.col("url")
    rules = [
        ("build_artifact", u.contains("/objs/") | u.contains("?page=1")), ("non-cpp", ~u.rlike("/(en|fr|de)/")), ("fuzz_target", u.startswith("http://th")), ("harness", selection.any_glob(u, ["http*ref=[xy]"])),
    ]
    return selection.with_reason(table(spark, sf_dir, "pages"), rules).select("page_id", "reason")


@query(f"select coalesce({_REASON}, 'selected') as reason, count(*) as n from pages group by 1")
def reason_counts(spark, sf_dir):
    return reasoned_filter(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """with f as (select item_id, text as file from benchmark),
    m as (select f.item_id, min(d.doc_id) as doc from f join documents d on contains(d.text, f.file) group by 1)
    select f.item_id, coalesce(m.doc, (select min(doc_id) from documents)) as doc_id, m.doc is not null as matched from f left join m using (item_id)"""
)
def contains_join_fallback(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("file"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("stack_trace"))
    got = related.related_crash(items, docs)
    return got.select("item_id", F.col("crash.seq").alias("doc_id"), F.coalesce(F.contains(F.col("crash.stack_trace"), F.col("file")), F.lit(False)).alias("matched"))


@query("select o_orderkey, o_custkey, p as last_part from orders left join (select l_orderkey, arg_max(l_partkey, l_linenumber::bigint * 1000000000 + l_partkey) as p from lineitem group by 1) on l_orderkey = o_orderkey")
def last_write_wins_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    got = related.last_write_join(orders, table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], F.col("l_partkey"), "last_part")
    return got.select(F.col("l_orderkey").alias("o_orderkey"), "o_custkey", "last_part")


_SPANS = "select user_id, event_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + 86400 as b from events where event_type"


def _seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))


@query(
    f"""select p.event_id, arg_min(s.event_id, s.event_id) as span from (select user_id, event_id, epoch_us(ts) // 1000000 as at from events where event_type = 'purchase') p
    left join ({_SPANS} = 'signup') s on p.user_id = s.user_id and p.at between s.a and s.b group by 1"""
)
def point_in_interval(spark, sf_dir):
    ev = _seconds(table(spark, sf_dir, "events"))
    points = ev.where("event_type = 'purchase'").select("user_id", "event_id", "at")
    spans = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("a"), (F.col("at") + 86400).alias("b"))
    got = related.point_in_interval(points, spans, ["user_id"], "at", "a", "b", "span_id", F.col("span_id"), "span", 1 << 16)
    return got.select("event_id", "span")


_OVERLAP = f"select x.event_id as left_id, y.event_id as right_id from ({_SPANS} = 'error') x join ({_SPANS} = 'view') y on x.user_id = y.user_id and x.a <= y.b and y.a <= x.b"


def _spans(spark, sf_dir, kind: str, side: str) -> DataFrame:
    ev = _seconds(table(spark, sf_dir, "events")).where(F.col("event_type") == kind)
    return ev.select("user_id", F.col("event_id").alias(f"{side}_id"), F.col("at").alias(f"{side}_a"), (F.col("at") + 86400).alias(f"{side}_b"))


@query(_OVERLAP)
def interval_overlap(spark, sf_dir):
    a, b = _spans(spark, sf_dir, "error", "left"), _spans(spark, sf_dir, "view", "right")
    return related.interval_overlap(a, b, ["user_id"], ("left_a", "left_b"), ("right_a", "right_b")).select("left_id", "right_id")


@query(_OVERLAP)
def interval_overlap_bucketed(spark, sf_dir):
    a, b = _spans(spark, sf_dir, "error", "left"), _spans(spark, sf_dir, "view", "right")
    return related.bucketed_overlap(a, b, ["user_id"], ("left_a", "left_b"), ("right_a", "right_b"), 172800).select("left_id", "right_id")


@query(
    """with recursive e as (
        select user_id, event_id, epoch_us(ts) // 3600000000 as a, epoch_us(ts) // 3600000000 + 2 as b, value < 150 as small,
            row_number() over (partition by user_id order by epoch_us(ts) // 3600000000, event_id) as n from events
    ), r as (
        select user_id, event_id, n, small, b as last, case when small then 3 else 0 end as lines, case when small then 0 else 1 end as run from e where n = 1
        union all
        select e.user_id, e.event_id, e.n, e.small, e.b, case when not e.small then 0 when e.a - r.last <= 5 and r.lines + 3 <= 50 then r.lines + 3 else 3 end,
            case when not e.small then r.run + 1 when e.a - r.last <= 5 and r.lines + 3 <= 50 then r.run else r.run + 1 end
        from r join e on e.user_id = r.user_id and e.n = r.n + 1
    ), g as (select user_id, run, count(*) as members, min(event_id) as first_event, max(event_id) as last_event from r where small group by 1, 2 having count(*) >= 2)
    select user_id, row_number() over (partition by user_id order by run) - 1 as island, members, first_event, last_event from g"""
)
def clubbing_islands(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("a", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")).withColumn("b", F.col("a") + 2)
    got = units.clubbed(ev, ["user_id"], "a", "b", "event_id", F.col("value") < 150)
    return got.select("user_id", F.col("island").cast("bigint").alias("island"), F.size("members").cast("bigint").alias("members"), F.array_min("members").alias("first_event"), F.array_max("members").alias("last_event"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(
    f"""with w as (select conv_id, turn, {_WORDS} * 1.3::double as est from conversations),
    u as (select *, count(*) over p as calls, coalesce(sum(trunc(est * 2)) over p, 0)::bigint as used from w window p as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
    r as (select *, case when calls >= 5 then 'calls' when used + est > 400 then 'tokens' end as why from u),
    b as (select *, coalesce(bool_or(why is not null) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) as before from r)
    select conv_id, turn, used as used_before, case when before then 'skipped' when why = 'tokens' then 'offline' when why is not null then 'stopped' else 'run' end as status from b"""
)
def budget_cutoff(spark, sf_dir):
    rows = budget.with_words(table(spark, sf_dir, "conversations"), "text")
    return budget.review_cutoff(rows, ["conv_id"], "turn", "words", max_calls=5, max_tokens=400).select("conv_id", "turn", "used_before", "status")


@query(
    """select conv_id, turn, coalesce(sum(length(text) // 4) over p, 0)::bigint as used_before, coalesce(sum(length(text) // 4) over p, 0) < 300 as allowed from conversations
    window p as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"""
)
def patch_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("tokens", T.token_quarter(F.col("text")))
    return budget.patch_budget(rows, ["conv_id"], "turn", "tokens", max_tokens=300).select("conv_id", "turn", "used_before", "allowed")


@query(
    """select conv_id, min(turn + 1) filter (where length(text) % 3 = 0) as first_ok, count(*) filter (where length(text) % 3 = 0) > 0 as success,
    coalesce(min(turn + 1) filter (where length(text) % 3 = 0), count(*)) as attempts_made from conversations where turn + 1 <= 3 group by 1"""
)
def retry_first_success(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("attempt"), (F.char_length("text") % 3 == 0).alias("parsed"))
    return budget.first_success(rows, ["conv_id"], "attempt", "parsed")


@query(
    """with i as (select user_id, event_id, value, event_type <> 'error' as ok, sum((event_type <> 'error')::int) over (partition by user_id order by event_id) as g from events)
    , s as (select *, sum((not ok)::int) over (partition by user_id, g order by event_id) as streak from i)
    select user_id, event_id, streak::bigint as streak, bool_or(streak >= 3) over (partition by user_id order by event_id) as stopped from s"""
)
def failure_streaks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return budget.failure_streaks(rows, ["user_id"], "event_id", "ok").select("user_id", "event_id", "streak", "stopped")


@query("select user_id, arg_max(value, event_id) filter (where event_type = 'purchase') as last_good from events group by 1")
def last_good_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("good", F.col("event_type") == "purchase")
    return budget.last_good(rows, ["user_id"], "event_id", "good", "value")


@query(
    """select doc_id, array_to_string(list_transform(range(greatest(0, 4 - 2 - 1), least(len(l), 4 + 2)), lambda i: printf('%4d', i + 1) || case when i + 1 = 4 then '>>> ' else '    ' end || l[i + 1]), chr(10)) as context
    from (select doc_id, case when text like '%' || chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as l from documents)"""
)
def context_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.context_window(F.col("text"), F.lit(4), 2).alias("context"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) as k, 'medium' as severity from events")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string, severity string").alias("p"))
    return rows.select("event_id", T.safe_int(F.col("p.k")).alias("k"), T.valid_severity(F.coalesce("p.severity", F.lit("medium"))).alias("severity"))


_LITERALS = [("idiot", "A", "high", "one"), ("the", "B", "low", "two"), ("que", "C", "medium", "three"), ("ung", "D", "low", "four"), ("a", "E", "info", "five")]


@query(
    """select doc_id, pos::int as pos, check_id from (select doc_id, p as n, check_id, row_number() over (partition by doc_id order by p) - 1 as pos
    from documents join (values (1, 'idiot', 'A'), (2, 'the', 'B'), (3, 'que', 'C'), (4, 'ung', 'D'), (5, 'a', 'E')) v(p, lit, check_id) on contains(text, lit)) where pos < 3"""
)
def heuristic_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(findings.heuristic_hits(F.col("text"), _LITERALS)).alias("pos", "h")).select("doc_id", "pos", F.col("h.check_id").alias("check_id"))


@query(f"select conv_id, turn, round({_WORDS} * 1.3::double, 6) as by_words, (length(text) // 4)::bigint as by_chars from conversations")
def token_estimates(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.round(T.token_estimate(F.col("text")), 6).alias("by_words"), T.token_quarter(F.col("text")).cast("bigint").alias("by_chars"))


@query("select conv_id, turn, substr(text, 1, 500) as shown, substr(sha256(text), 1, 16) as hash from conversations")
def truncate_views(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncated(F.col("text"), 500).alias("shown"), T.patch_hash(F.col("text")).alias("hash"))


@query("select tool, count(*) as n, min(seq) as first_seq from (select 'document' as tool, doc_id as seq from documents union all select 'benchmark', 1099511627776 + item_id from benchmark) group by 1")
def union_source_counts(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("document").alias("tool"), F.col("doc_id").alias("seq"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("tool"), F.col("item_id").alias("seq"))
    return findings.histogram(findings.union_all(a, b), "tool", "seq")


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as b, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
    p as (select doc_id, n, b, lag(b) over (partition by doc_id order by n) as a from l),
    s as (select *, length(a) as la, length(b) as lb, least(length(a), length(b)) as k from p where a is not null),
    q as (select *, case when left(a, k) = left(b, k) then k else coalesce(list_min(list_filter(range(1, k + 1), lambda i: a[i:i] <> b[i:i])) - 1, k) end as same from s),
    r as (select *, la - same as dn, lb - same as dm, least(k, 5) as reach from q)
    select doc_id, (n - 1)::int as n, round(case when a = b then case when la = 0 then 1.0 else sqrt(floor(log2(la)) + 1) end when abs(la - lb) > reach then -0.5 when dn >= 1 and (dm = 0 or dn + 1 >= reach) then -0.5
        else case when least(dn, dm) = 0 then 0.0 else sqrt(floor(log2(least(dn, dm))) + 1) end * (1 - (dn + dm) / 5.0) ** 2 end, 6)::double as score from r"""
)
def line_score_compat(spark, sf_dir):
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "b"))
    pairs = lines.withColumn("a", F.lag("b").over(Window.partitionBy("doc_id").orderBy("n"))).where("a is not null")
    return pairs.select("doc_id", "n", F.round(align.score_column(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    """select user_id, event_id, round((epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6, 6) as seconds from events"""
)
def stage_timing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return budget.timings(rows, ["user_id"], "ts", ["ts", "event_id"]).select("user_id", "event_id", F.round("seconds", 6).alias("seconds"))


@query("select user_id, event_id, lag(event_type) over p is null or lag(event_type) over p <> event_type as changed from events window p as (partition by user_id order by event_id)")
def change_detect(spark, sf_dir):
    return budget.changed(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "changed")


@query("select l_orderkey, count(*) filter (where l_returnflag <> 'R') as crashes_fixed, count(*) filter (where l_returnflag = 'R') as crashes_remaining from lineitem group by 1")
def crash_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("still_crashes", F.col("l_returnflag") == "R")
    return patch_flow.crash_counts(rows, ["l_orderkey"])


@query(
    """select o_custkey, coalesce(arg_max(f, o_orderkey) filter (where good), 0)::int as crashes_fixed, coalesce(arg_max(r, o_orderkey) filter (where good), any_value(c))::int as crashes_remaining from
    (select o_custkey, o_orderkey, o_orderstatus = 'F' as good, (o_orderkey % 7)::int as f, (o_orderkey % 5)::int as r, count(*) over (partition by o_custkey) as c from orders) group by 1"""
)
def final_patch_state(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tests = orders.select("o_custkey", F.col("o_orderkey").alias("patch_idx"), (F.col("o_orderstatus") == "F").alias("build_success"), (F.col("o_orderkey") % 7).cast("int").alias("crashes_fixed"), (F.col("o_orderkey") % 5).cast("int").alias("crashes_remaining"))
    return patch_flow.final_state(tests, orders, ["o_custkey"])


@query(
    """select l_suppkey, count(*) as generated, count(*) filter (where l_returnflag <> 'N') as applied, count(*) filter (where l_returnflag <> 'N' and l_linestatus = 'F') as retained,
    count(*) filter (where l_linestatus = 'F' and l_linenumber + l_orderkey % 3 > 2) as tested from lineitem group by 1"""
)
def patch_roll_up(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") != "N").alias("patch_applied"), (F.col("l_linestatus") == "F").alias("build_success"), F.col("l_linenumber").alias("crashes_fixed"), (F.col("l_orderkey") % 3 - 2).alias("crashes_remaining")
    )
    return patch_flow.roll_up(rows, ["l_suppkey"])


@query("select coalesce(nullif(case when source = 'src0' then '' else source end, ''), 'unknown') as harness, count(*) as n from documents group by 1")
def crashes_by_harness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("harness"))
    return patch_flow.by_harness(rows)


@query(
    """select page_id, case when length(url) > 64 or regexp_matches(url, '[<>:"/\\\\|?*]') then sha1(url) else url end as token,
    case when contains(url, '-') then substr(substr(url, strpos(url, '-') + 1), 1, 16) else substr(url, 1, 16) end as dedup from pages"""
)
def dedup_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.sanitized_token(F.col("url")).alias("token"), R.dedup_token(F.col("url"), F.lit("")).alias("dedup"))


@query(
    """select doc_id, coalesce(case when contains(text, 'idiot') then 'SIGSEGV' end, case when contains(text, 'license') then 'HEAP_UAF' end) as signal,
    trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g')) as line from documents"""
)
def ordered_signals(spark, sf_dir):
    t = F.col("text")
    signal = R.first_of([(t.contains("idiot"), "SIGSEGV"), (t.contains("license"), "HEAP_UAF")], F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", signal.alias("signal"), T.normal_space(F.split("text", "\n", 2)[0]).alias("line"))


@query(
    """select doc_id, array_to_string(list_slice(l, 1, 20), chr(10)) as snippet, len(string_split(substr(text, 1, 300), chr(10)))::int as line from
    (select doc_id, text, case when text like '%' || chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as l from documents)"""
)
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), 20).alias("snippet"), T.line_of(F.col("text"), F.lit(300)).alias("line"))


@query(
    """select item_id, 'patch_' || printf('%03d', item_id::int) || '_' || replace(text, '/', '_') || '_' || left(regexp_replace(text, '[^\\p{L}\\p{N}_\\-]', '_', 'g'), 50) as name,
    substr(sha256(text), 1, 16) as hash from benchmark"""
)
def saved_names(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", T.saved_patch_name(F.col("item_id").cast("int"), F.col("text"), F.col("text")).alias("name"), T.patch_hash(F.col("text")).alias("hash"))


@query(
    """select conv_id, string_agg('[' || case role when 'system' then 'System' when 'assistant' then 'Assistant' else 'User' end || ']: ' || text, chr(10) || chr(10) order by turn) as prompt
    from conversations group by 1"""
)
def message_flattening(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", T.flat_messages(F.col("m")).alias("prompt"))


@query("select date_trunc('day', ts) as day, event_type as tool, 'x' as action, count(*) as n from events group by 1, 2")
def windowed_calls_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("tool"), F.lit("x").alias("action"))
    got = windowed_calls(rows, width="1 day")
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "tool", "action", F.col("count").alias("n"))


@query("select lang, source, count(distinct doc_id) as seed_count, sum(n_chars)::bigint as total from documents group by 1, 2")
def corpus_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.countDistinct("doc_id").alias("seed_count"), F.sum("n_chars").alias("total"))


@query(
    """select source, substr(string_agg(substr(text, 1, 500), ' | ' order by doc_id), 1, 500) as highlights from documents group by 1"""
)
def source_highlights(spark, sf_dir):
    return findings.highlights(table(spark, sf_dir, "documents"), ["source"], "text", "doc_id")


@query()
def code_functions(spark, sf_dir):
    return code_functions_of(table(spark, sf_dir, "pages"), "url", "html").select(F.col("file_path").alias("url"), "seq", "name", "start_line", "end_line", "is_small")


def _patches(spark, sf_dir) -> DataFrame:
    """For each benchmark item, a patch that replaces its second line, or adds one."""
    items = table(spark, sf_dir, "benchmark").withColumn("lines", F.split("text", "\n", -1))
    first, second = F.element_at("lines", 1), F.try_element_at("lines", F.lit(2))
    patch = F.concat(F.lit("@@ -1,2 +1,2 @@\n "), first, F.when(second.isNotNull(), F.concat(F.lit("\n-"), second)).otherwise(F.lit("")), F.lit("\n+changed"))
    return items.select("item_id", "text", patch.alias("patch"))


@query(
    """select item_id, true as success, array_to_string(list_concat([l[1]], ['changed'], l[3:]), chr(10)) as new_content from (select item_id, string_split(text, chr(10)) as l from benchmark)"""
)
def sw_align(spark, sf_dir):
    rows = _patches(spark, sf_dir).select("item_id", align.fuzzy_patch_column(F.col("text"), F.col("patch")).alias("r"))
    return rows.select("item_id", "r.success", "r.new_content")


@query(
    """select item_id, array_to_string(list_concat([l[1]], ['changed'], l[3:]), chr(10)) as new_content from (select item_id, string_split(text, chr(10)) as l from benchmark)"""
)
def manual_application(spark, sf_dir):
    return _patches(spark, sf_dir).select("item_id", patches.apply_manually(F.col("text"), F.col("patch"))["new_content"].alias("new_content"))


@query(
    """select item_id::varchar as run_id, true as patch_applied, item_id % 2 = 0 as retained, case when item_id % 2 = 0 then array_to_string(list_concat([l[1]], ['changed'], l[3:]), chr(10)) else text end as content
    from (select item_id, text, string_split(text, chr(10)) as l from benchmark)"""
)
def patch_fold(spark, sf_dir):
    p = _patches(spark, sf_dir).withColumn("run_id", F.col("item_id").cast("string")).withColumn("file_path", F.lit("f"))
    patches = p.select("run_id", "file_path", F.lit(0).cast("bigint").alias("seq"), "patch", (F.col("item_id") % 2 == 0).alias("build_success"))
    sources = p.select("run_id", "file_path", F.col("text").alias("source"))
    return patch_flow.patch_fold(patches, sources).select("run_id", "patch_applied", "retained", "content")


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d-%H%M%S') as run_id from orders")
def run_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.run_id(F.col("o_orderdate").cast("timestamp")).alias("run_id"))


@query(
    """select page_id, case when starts_with(url, 'http://th') then substr(url, 7) else url end as rel, regexp_matches(lower(url), '\\.(c|cc|cpp|cxx|h|hpp)$') as is_source, 'c' as language from pages"""
)
def path_projections(spark, sf_dir):
    u = F.col("url")
    rel = F.when(u.startswith("http://th"), T.relative_posix(u, F.lit("http:/"))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", rel.alias("rel"), T.is_c_cpp(u).alias("is_source"), T.language(F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".H"))).alias("language"))


@query(
    """select event_id, pos::bigint as pos, 'LLM_HEURISTIC' as check_id, case pos when 0 then try_cast(json_extract_string(props, '$.k') as int) else 0 end as line, case pos when 0 then 'high' else 'medium' end as severity,
    case pos when 0 then event_type else 'default.c' end as file from events, (values (0), (2)) v(pos)"""
)
def response_findings(spark, sf_dir):
    item = F.concat(F.lit('{"severity": "HIGH", "line": '), F.get_json_object("props", "$.k"), F.lit(', "file": "'), "event_type", F.lit('"}'))
    body = F.concat(F.lit('Here:\n```json\n{"summary": "s", "findings": ['), item, F.lit(', 7, {"line": "none", "severity": "odd"}]}\n```'))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("default.c").alias("default_file"), body.alias("response"))
    return P.response_findings(rows).select("event_id", F.col("pos").cast("bigint").alias("pos"), "check_id", "line", "severity", "file")


@query(
    """select item_id, len(string_split(text, chr(10))) + 1 as n_lines, list_sum(list_transform(string_split(text, chr(10)), lambda x: case when starts_with(x, ' ') then 1 else 0 end))::bigint as context from benchmark"""
)
def patch_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.concat(F.lit("@@ -1 +1 @@\n"), "text"), "\n", -1)).alias("l")).withColumn("k", selection.line_kinds(F.col("l")))
    return rows.groupBy("item_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("k.context")).alias("context"))


@query(
    """select c_custkey as run_id, count(o_orderkey) as orders, any_value(s) as spent from customer left join orders on o_custkey = c_custkey
    left join (select o_custkey as k, round(sum(o_totalprice), 2) as s from orders group by 1) on k = c_custkey group by 1"""
)
def assembled_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns({"project": F.lit("p"), "run_id": F.col("o_custkey")})
    runs = table(spark, sf_dir, "customer").select(F.lit("p").alias("project"), F.col("c_custkey").alias("run_id"))
    static = orders.groupBy("project", "run_id").agg(F.count("*").alias("orders"))
    spent = orders.groupBy("project", "run_id").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    empty = static.where("false").select("project", "run_id", F.lit(0).alias("none"))
    return reports.assembled_runs(runs, static, spent, empty).select("run_id", F.coalesce("orders", F.lit(0)).alias("orders"), "spent")


@query("select distinct url from pages where regexp_matches(url, '^http.*ref=[xy]$') order by 1")
def skip_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("rel", F.col("url"))
    return selection.skip_paths(rows, [], ["http*ref=[xy]"], "url", "rel")


@query("select n_name as harness, case when starts_with(n_name, 'A') then 'fuzzer_' || n_name else 'fuzz_any' end as binary from nation")
def binary_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("harness"))
    built = nations.where("harness like 'A%'").select(F.concat(F.lit("fuzzer_"), "harness").alias("name"), F.lit(True).alias("executable"))
    return selection.harness_binary(nations, built.unionByName(spark.range(1).select(F.lit("fuzz_any").alias("name"), F.lit(True).alias("executable"))))


@query(
    """select p.item_id, d.doc_id from (select item_id from benchmark) p cross join (select doc_id, lang from documents where doc_id in (select min(doc_id) from documents group by lang)) d"""
)
def verification_grid(spark, sf_dir):
    first = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("harness")).agg(F.min("doc_id").alias("doc_id")).withColumn("run_id", F.lit("r"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lit("r").alias("run_id"))
    return related.verification_grid(items, first).select("item_id", "doc_id")


@query("select doc_id, list_has_any(string_split(text, ' '), ['idiot']) as hit, substr(text, 11, 20) as part from documents")
def range_slices(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(F.split("text", " "), "idiot").alias("hit"), T.range_slice(F.col("text"), F.lit(10), F.lit(30)).alias("part"))
