"""Queries over files, streams and producers: what is written by name is read back by the scans, and streams are stopped and started again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Run, Target
from ..functions import text as T
from ..operators import producers, selection
from ..scratch import folder
from ..sources import artifacts, documents, files
from ..streaming import streams
from .catalogue import query, table

_CRASHES = [
    "event_id as seq", "'p' as project", "cast(user_id as string) as run_id", "event_type as harness", "'c' || event_id as crash_id", "'/in/' || event_id as input_path", "cast(value * 100 as bigint) as input_size",
    "'t' || (event_id % 4) as dedup_token", "cast(null as timestamp) as timestamp", "'SEGV' as signal", "case when event_id % 3 = 0 then '' else repeat('x', cast(event_id % 700 + 1 as int)) end as stack_trace",
]




@query(
    """with e as (select *, case when event_id % 3 = 0 then 'no_trace_t' || (event_id % 4) else 'traced' end as cluster from events),
    last as (select user_id, max(event_type) as event_type from e group by 1),
    d as (select user_id, cluster, min(event_id) as f, arg_min(event_id, floor(value * 100)::bigint * 1000000000 + event_id) as r, count(*) as c from e group by 1, 2)
    select user_id, 'fuzzing/' || event_type || '_results.json' as rel, count(*) as n, 'c' || min(event_id) as first, (case when min(event_id) % 3 = 0 then 0 else least(500, min(event_id) % 700 + 1) end)::bigint as more from e group by user_id, event_type
    union all select user_id, 'fuzzing/fuzzing_results.json', count(*), 'c' || arg_min(event_id, event_type || lpad(event_id::varchar, 12, '0')), 30 * count(distinct event_type) from e group by 1
    union all select user_id, 'fuzzing/deduplicated_crashes.json', count(*), 'c' || arg_min(r, f), max(c) from d group by 1
    union all select user_id, 'fuzzing/crashes.log', count(*), 'c' || min(event_id), count(*) filter (where event_id % 3 <> 0) from e semi join last using (user_id, event_type) group by 1
    union all select user_id, 'static_analysis.json', count(*) filter (where event_type = 'error'), 'K' || min(event_id) filter (where event_type = 'error'), 1 from e group by 1"""
)
def run_documents(spark, sf_dir):
    """A document for each run and harness, written twice, read back by the scan of artifacts. Logs that stand beside them aren't listed."""
    path, ev = folder(spark, "workspace"), table(spark, sf_dir, "events")
    crashes = ev.selectExpr(*_CRASHES)
    batches = crashes.select("project", "run_id", "harness").distinct()
    zero = F.lit(0).cast("bigint")
    batches = batches.withColumns({"fuzzer_binary": F.lit("/bin/f"), "duration_seconds": F.lit(30), "seeds_initial": zero, "seeds_final": zero, "seeds_found": zero, "summary": F.lit("s")})
    found = ev.where("event_type = 'error'").selectExpr(
        "event_id as seq", "'p' as project", "cast(user_id as string) as run_id", "'infer' as tool", "'K' || event_id as check_id", "'f.c' as file", "1 as line", "'low' as severity", "'t' as title", "'d' as detail", "cast(null as string) as evidence_path",
        "'{}' as raw_payload", "'fn' as function_name",
    )
    static = batches.select("project", "run_id", "summary").distinct()
    rows = documents.fuzzing_documents(batches, crashes).unionByName(documents.dedup_documents(crashes)).unionByName(documents.crash_logs(crashes, F.lit("2025-01-01T00:00:00+00:00"))).unionByName(documents.static_documents(static, found))
    logs = static.select(F.concat("project", F.lit("/"), "run_id", F.lit("/logs/run.log")).alias("name"), F.lit("x").alias("content"))
    files.write_files(rows.unionByName(logs), path, packed=True, times=2)
    got = files.artifact_files(spark, path).where("kind = 'artifacts' and project = 'p'").select(F.col("run_id").cast("bigint").alias("user_id"), "rel", F.col("content").cast("string").alias("c"))
    value = lambda json: F.get_json_object("c", json)
    of = lambda name: F.col("rel").endswith(name)
    n = F.when(of("crashes.log"), F.size(F.split("c", "## Crash: ")) - 1).when(of("deduplicated_crashes.json"), value("$.unique_signatures").cast("int")).when(of("static_analysis.json"), F.json_array_length(value("$.findings"))).otherwise(value("$.crashes_found").cast("int"))
    first = F.when(of("crashes.log"), F.regexp_extract("c", r"## Crash: (\S+)", 1)).when(of("deduplicated_crashes.json"), value("$.unique_crashes[0].crash_id")).when(of("static_analysis.json"), value("$.findings[0].check_id")).otherwise(value("$.crashes[0].crash_id"))
    more = (
        F.when(of("crashes.log"), F.size(F.split("c", "- Stack trace:")) - 1).when(of("deduplicated_crashes.json"), value("$.clusters[0].count").cast("int")).when(of("fuzzing_results.json"), value("$.duration_seconds").cast("int"))
        .when(of("static_analysis.json"), (~F.col("c").contains("function_name") & F.col("c").contains('"evidence_path" : null') | ~F.col("c").contains("check_id")).cast("int")).otherwise(F.char_length(value("$.crashes[0].stack_trace")))
    )
    return got.select("user_id", "rel", n.cast("bigint").alias("n"), first.alias("first"), more.cast("bigint").alias("more"))


@query(
    """select c_custkey, 'patches/patch_' || (c_custkey + 1) || '_src_f' || c_custkey || '.c.patch' as rel, sha1('@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+' || c_name) as content from customer where c_custkey % 3 <> 0
    union all select c_custkey, 'patched_files/patch_' || lpad(c_custkey::varchar, greatest(3, length(c_custkey::varchar))::int, '0') || '_src_f' || c_custkey || '.c_infer_UAF_' || c_custkey, sha1('int ' || c_name || ';') from customer where c_custkey % 2 = 0
    union all select null, 'patching_results.json', sha1(count(*) || ':' || count(*) filter (where c_custkey % 3 <> 0) || ':' || min(c_custkey)) from customer"""
)
def patch_documents(spark, sf_dir):
    """A file for each patch, one for each patched source, and the results of the run."""
    path, c = folder(spark, "patches"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    named = c.select("c_custkey", F.lit("p").alias("project"), F.lit("r").alias("run_id"), F.concat(F.lit("src/f"), key, F.lit(".c")).alias("file_path"), F.concat(F.lit("infer:UAF:"), key).alias("finding_id"), "c_name")
    patch = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("@@ -1 +1 @@\n-a\n+"), "c_name"))
    results = named.select("*", F.col("c_custkey").alias("seq"), patch.alias("patch"), *[F.lit(None).cast("string").alias(x) for x in ("vuln_type", "error_message", "analysis", "fix_strategy")], F.lit(1).alias("line"), patch.isNotNull().alias("success"), F.lit(1).alias("attempts"))
    tests = named.limit(0).selectExpr("project", "run_id", "c_custkey as seq", "finding_id", "true as patch_applied", "true as build_success", "'' as build_error", "'' as patched_file_saved", "0 as crashes_fixed", "0 as crashes_remaining", "array('') as crash_tests")
    batch = named.groupBy("project", "run_id").agg(F.count("*").alias("findings_processed"), *[F.lit(0).alias(x) for x in ("patches_generated", "patches_applied", "patches_tested")], *[F.lit("").alias(x) for x in ("working_copy_path", "patched_files_path", "summary")])
    saved = named.where("c_custkey % 2 = 0").select("project", "run_id", F.col("c_custkey").cast("int").alias("patch_idx"), "file_path", "finding_id", F.concat(F.lit("int "), "c_name", F.lit(";")).alias("content"))
    files.write_files(documents.patch_documents(results).unionByName(documents.snapshot_documents(saved)).unionByName(documents.patching_documents(batch, results, tests)), path)
    got = files.artifact_files(spark, path).where("run_id = 'r'").select(F.regexp_replace("rel", "^patching/", "").alias("rel"), F.col("content").cast("string").alias("c"))
    shown = F.from_json(F.get_json_object("c", "$.patcher_results"), "array<struct<finding_id:string,patch:string>>")
    counted = F.concat_ws(":", F.size(shown).cast("string"), F.size(F.filter(shown, lambda x: x["patch"].isNotNull())).cast("string"), F.element_at(F.split(shown[0]["finding_id"], ":"), 3))
    whole = F.col("rel") == "patching_results.json"
    return got.select(F.when(~whole, F.regexp_extract("rel", r"_f(\d+)\.c", 1).cast("bigint")).alias("c_custkey"), "rel", F.sha1(F.when(whole, counted).otherwise(F.col("c"))).alias("content"))


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) <= 5")
def corpus_restart_stream(spark, sf_dir):
    """The first half of a stream is admitted and stored; a stream with a new checkpoint starts from what is stored and admits the other half. Together they hold what one run would admit."""
    path, schema = folder(spark, "restart"), "user_id bigint, event_type string, event_id bigint"
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    middle = ev.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for k, half in enumerate((ev.where(F.col("event_id") <= middle), ev.where(F.col("event_id") > middle))):
        half.write.parquet(f"{path}/in{k}")
        held = spark.read.schema(schema).parquet(f"{path}/out0") if k else None
        rows = spark.readStream.schema(schema).parquet(f"{path}/in{k}")
        streams.drained(streams.capped_buckets(rows, ["user_id", "event_type"], "event_id", "event_id", 5, held=held), f"{path}/state{k}", f"{path}/out{k}")
    return spark.read.schema(schema).parquet(f"{path}/out0", f"{path}/out1")


@query(
    """select 'seeds' as callback, event_id, null as failed from events union all select 'crashes', event_id, null from events where event_type = 'error'
    union all select 'crashes', null, 'ValueError: not now' union all select 'seeds', null, null"""
)
def callback_ledger(spark, sf_dir):
    """Two callbacks, one of which fails at its first batch; all batches come twice; failed ones are tried again. Each row is delivered once, and the failure stays on record."""
    path, schema = folder(spark, "callbacks"), table(spark, sf_dir, "events").select("event_id", "event_type").schema
    table(spark, sf_dir, "events").select("event_id", "event_type").repartition(3).write.parquet(f"{path}/in")
    calls: list[int] = []
    said: list[str] = []

    def crashes(rows, batch):
        calls.append(batch)
        if len(calls) == 1:
            raise ValueError("not now")
        return rows.where("event_type = 'error'")

    out = streams.Delivery({"seeds": lambda rows, batch: rows, "crashes": crashes}, path)

    def twice(rows, batch):
        out(rows, batch)
        said.extend(r["error"] for r in out.ledger(spark).where("error is not null").collect())
        out(rows, batch)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.on_new_rows(rows, twice, f"{path}/state").awaitTermination()
    out.retry(spark, schema)
    failed = dict.fromkeys(("seeds", "crashes")) | {"crashes": said[0] if said else None}
    done = [out.delivered(spark, name, schema).select(F.lit(name).alias("callback"), "event_id", F.lit(None).cast("string").alias("failed")) for name in failed]
    kept = spark.createDataFrame([(k, None, v) for k, v in failed.items()], "callback string, event_id bigint, failed string")
    return done[0].unionByName(done[1]).unionByName(kept)


@query(
    """select 'heuristic' as producer, 0 as source_seq, count(*) filter (where event_type = 'error') as n from events union all select 'recorded', 2, count(*) filter (where event_type = 'view') from events"""
)
def produced_findings(spark, sf_dir):
    """Three producers, of which one raises."""
    ev = table(spark, sf_dir, "events")

    def of(kind):
        return lambda spark, run: ev.where(F.col("event_type") == kind).select(F.lit("f.c").alias("file"), F.lit(1).alias("line"), F.lit("low").alias("severity"), F.col("event_id").alias("seq"))

    def broken(spark, run):
        raise RuntimeError("no analyser here")

    got = producers.produced(spark, Run(Target("t", "/s")), {"heuristic": of("error"), "broken": broken, "recorded": of("view")})
    assert list(got.errors) == ["broken"]
    return got.findings.groupBy("producer", "source_seq").agg(F.count("*").alias("n"))


_EXT = "case page_id % 9 when 0 then '.c' when 1 then '.CC' when 2 then '.cpp' when 3 then '.cxx' when 4 then '.h' when 5 then '.hpp' when 6 then '.py' when 7 then '.c.txt' else '' end"
_DIR = "case page_id % 7 when 0 then 'objs/' when 1 then 'src/' when 2 then 'fuzz/' when 3 then 'lib/deep/' when 4 then '' when 5 then 'harness_a/' else 'out/' end"


@query(
    f"""select page_id, case when page_id % 7 in (0, 6) then 'build_artifact' when page_id % 9 in (6, 7, 8) then 'non-cpp' when page_id % 7 = 2 then 'fuzz_target' when page_id % 7 = 5 then 'harness' end as reason, page_id % 9 < 6 as is_c_cpp,
    case page_id % 9 when 1 then 'cpp' when 2 then 'cpp' when 3 then 'cpp' when 5 then 'cpp' when 6 then 'python' else 'c' end as language from pages"""
)
def candidate_paths(spark, sf_dir):
    """Files of all extensions, in build, source, fuzz and harness folders."""
    rel = F.concat(F.expr(_DIR), F.lit("f"), F.col("page_id").cast("string"), F.expr(_EXT))
    rows = table(spark, sf_dir, "pages").select("page_id", rel.alias("rel"), F.concat(F.lit("/w/"), rel).alias("path"))
    got = selection.candidate_files(rows, "/w/out", ["fuzz"], ["harness_*"])
    return got.select("page_id", "reason", T.is_c_cpp(F.col("path")).alias("is_c_cpp"), T.language(F.col("path")).alias("language"))


@query(
    """select p_partkey, 'crashes' as kind, 'b' || (p_partkey % 7) as bucket, row_number() over (partition by p_partkey % 7 order by 'id' || p_partkey) - 1 as seq, length(p_name) as size, p_name as source from part
    union all select o_orderkey, 'log', null, row_number() over (order by o_orderkey) - 1, null, 'order ' || o_orderkey from orders"""
)
def corpus_and_log_order(spark, sf_dir):
    """Files of a corpus and lines of a log, written by name, read back with their places."""
    path = folder(spark, "ordered")
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    key = F.col("p_partkey").cast("string")
    corpus = p.select(F.concat(F.lit("corpus/h/crashes/b"), (F.col("p_partkey") % 7).cast("string"), F.lit("/id"), key).alias("name"), F.col("p_name").alias("content"))
    lines = o.select(F.lit("run/p/r/logs/run.log").alias("name"), "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("line"))
    files.write_files(corpus.unionByName(files.log_parts(lines, "o_orderkey")), path)
    root = f"{path}/corpus"
    found = artifacts.corpus(spark, root, content=False)
    crashes = artifacts.listed_crashes(found).select("crash_id", "input_size")
    whole = artifacts.with_content(spark, root, found.join(crashes, F.col("id") == F.col("crash_id")))
    rows = whole.select(F.substring("id", 3, 20).cast("bigint").alias("p_partkey"), "kind", "bucket", "seq", F.col("input_size").alias("size"), F.col("content").cast("string").alias("source"))
    said = artifacts.run_log(spark, f"{path}/run/p/r/logs/run.log.part-*")
    return rows.unionByName(said.select(F.split("value", " ")[1].cast("bigint").alias("p_partkey"), F.lit("log").alias("kind"), F.lit(None).cast("string").alias("bucket"), "seq", F.lit(None).cast("bigint").alias("size"), F.col("value").alias("source")))
