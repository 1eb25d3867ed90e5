"""Files by name, restarts of streams, ledgers and producers."""

import json
import os
import stat
import time

import pytest
from pyspark.sql import functions as F

from faultline.config import Run, Target
from faultline.operators import producers
from faultline.sources import artifacts, documents, files
from faultline.streaming import streams


def listed(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_files_by_name(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([("a.txt", "one"), ("deep/er/b é.txt", "zwei ü"), ("empty", None)], "name string, content string").repartition(3)
    for _ in range(2):
        files.write_files(rows, str(folder))
    assert listed(folder) == {"a.txt": b"one", "deep/er/b é.txt": "zwei ü".encode(), "empty": b""}
    files.write_files(spark.createDataFrame([("c.bin", bytearray(b"\x00\xff"))], "name string, content binary"), f"file://{folder}")
    assert len(listed(folder)) == 4 and listed(folder)["c.bin"] == b"\x00\xff"
    files.write_files(rows.where("name = 'a.txt'"), str(folder), mode="overwrite")
    assert listed(folder) == {"a.txt": b"one"}


@pytest.mark.parametrize("names", [["a", "a"], ["ok", ""], ["ok", None], ["ok", "../out"], ["ok", "/etc/x"]])
def test_failed_writes_leave_nothing(spark, tmp_path, names):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(n, "x") for n in names], "name string, content string").repartition(2)
    with pytest.raises(Exception):
        files.write_files(rows, str(folder))
    assert listed(tmp_path) == {}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception):
        files.write_files(rows.repartition(4), str(folder))
    assert listed(tmp_path) == {}


def test_scan_of_artifacts(spark, tmp_path):
    for project, run, kind, rel in [("p", "r1", "logs", "run.log"), ("p", "r1", "artifacts", "x/y.json"), ("p", "r2", "artifacts", "b"), ("p", "r2", "artifacts", "a"), ("q", "r1", "build", "bin/fuzzer")]:
        path = tmp_path / project / run / kind / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(rel)
    (tmp_path / "q/r1/build/bin/fuzzer").chmod(0o755)
    (tmp_path / "p/r2/artifacts/a").chmod(0o640)
    (tmp_path / "stray").write_text("not in a run")
    rows = files.artifact_files(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    got = [tuple(r) for r in rows.drop("content").collect()]
    assert sorted(got) == sorted(
        (p, r, k, rel, rel.rpartition("/")[2], len(rel), stat.S_IMODE(os.stat(tmp_path / p / r / k / rel).st_mode), k == "build")
        for p, r, k, rel in [("p", "r1", "logs", "run.log"), ("p", "r1", "artifacts", "x/y.json"), ("p", "r2", "artifacts", "a"), ("p", "r2", "artifacts", "b"), ("q", "r1", "build", "bin/fuzzer")]
    )
    few = rows.where("project = 'p' and kind in ('artifacts') and run_id = 'r2'")
    assert few.rdd.getNumPartitions() == 1 and [r.rel for r in few.collect()] == ["a", "b"]  # other folders aren't even listed
    assert rows.where("project = 'none'").count() == 0 and rows.where("kind = 'logs' and length > 100").count() == 0
    assert files.artifact_files(spark, str(tmp_path), content=False).where("content is not null").count() == 0
    assert files.artifact_files(spark, str(tmp_path / "missing")).count() == 0


def test_documents_of_a_run(spark):
    f = spark.createDataFrame([("p", "r", i, "infer", f"K{i}", "a.c", i, "low", "t", None, None, "{}", "fn") for i in (1, 0)], "project string, run_id string, seq bigint, tool string, check_id string, file string, line int, severity string, title string, detail string, evidence_path string, raw_payload string, function_name string")
    b = spark.createDataFrame([("p", "r", "two"), ("p", "none", "no findings")], "project string, run_id string, summary string")
    got = {r.name: json.loads(r.content) for r in documents.static_documents(b, f).collect()}
    assert set(got) == {"p/r/artifacts/static_analysis.json", "p/none/artifacts/static_analysis.json"} and got["p/none/artifacts/static_analysis.json"]["findings"] == []
    one = got["p/r/artifacts/static_analysis.json"]
    assert list(one) == ["project", "run_id", "summary", "findings"] and [x["check_id"] for x in one["findings"]] == ["K0", "K1"] and "function_name" not in one["findings"][0] and one["findings"][0]["detail"] is None
    crash = "project string, run_id string, harness string, seq bigint, crash_id string, input_path string, input_size bigint, dedup_token string, timestamp timestamp, signal string, stack_trace string"
    c = spark.createDataFrame([("p", "r", h, k, f"c{k}", "/i", 9 - k, "t", None, "S", t) for k, (h, t) in enumerate([("h1", "x" * 900), ("h1", None), ("h0", "")])], crash)
    log = documents.crash_logs(c, F.lit("now")).collect()
    assert [r.name for r in log] == ["p/r/artifacts/fuzzing/crashes.log"] and log[0].content.startswith("# Crashes found at now\n\n## Crash: c0\n- Dedup token: t\n") and "c2" not in log[0].content and log[0].content.count("Stack trace") == 1
    dedup = json.loads(documents.dedup_documents(c).first().content)
    assert dedup["total_crashes"] == 3 and dedup["unique_signatures"] == 2 and [x["crash_id"] for x in dedup["unique_crashes"]] == ["c0", "c2"] and len(dedup["unique_crashes"][0]["stack_trace"]) == 900
    assert [x["count"] for x in dedup["clusters"]] == [2, 1]


def admitted(spark, path, rows, k, **more):
    rows.coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    streams.drained(streams.capped_buckets(stream, ["bucket"], "id", "seq", k, **more), f"{path}/cp", f"{path}/out")
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def test_a_new_stream_starts_from_the_stored_corpus(spark, tmp_path):
    schema = "bucket string, id string, seq bigint"
    first = admitted(spark, str(tmp_path / "a"), spark.createDataFrame([("b", "1", 1), ("b", "1", 2), ("c", "9", 3)], schema), 3)
    assert {(r.bucket, r.id) for r in first.collect()} == {("b", "1"), ("c", "9")}
    more = spark.createDataFrame([("b", "1", 4), ("b", "2", 5), ("b", "3", 6), ("b", "4", 7), ("d", "5", 8), ("full", "x", 9)], schema)
    held = first.unionByName(spark.createDataFrame([("full", str(i), 0) for i in range(5)], schema))
    assert {(r.bucket, r.id) for r in admitted(spark, str(tmp_path / "b"), more, 3, held=held).collect()} == {("b", "2"), ("b", "3"), ("d", "5")}



def test_ids_are_forgotten_in_time(spark, tmp_path):
    rows = spark.createDataFrame([("b", str(i), i) for i in range(5)], "bucket string, id string, seq bigint")
    rows.write.parquet(f"{tmp_path}/in")
    stream = streams.capped_buckets(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["bucket"], "id", "seq", 2, ttl_ms=3_600_000)
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if any(p["numInputRows"] for p in running.recentProgress):
                break
            time.sleep(1)
    finally:
        running.stop()
    assert {r.id for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()} == {"0", "1"}


def test_ledger_of_callbacks(spark, tmp_path):
    schema = "id bigint"
    tries = []

    def unsure(rows, batch):
        tries.append(batch)
        if len(tries) < 3:
            raise RuntimeError("down")
        return rows

    out = streams.Delivery({"fine": lambda rows, n: rows.where("id % 2 = 0"), "unsure": unsure}, str(tmp_path))
    rows = spark.range(6).select("id")
    for n in (0, 0, 1):
        out(rows.withColumn("id", F.col("id") + 10 * n), n)
    ledger = {(r.callback, r.batch): (r.rows, r.error) for r in out.ledger(spark).collect()}
    assert ledger == {("fine", 0): (3, None), ("fine", 1): (3, None), ("unsure", 0): (0, "RuntimeError: down"), ("unsure", 1): (6, None)}
    out.retry(spark, rows.schema)
    out.retry(spark, rows.schema)
    assert sorted(r.id for r in out.delivered(spark, "unsure", rows.schema).collect()) == [0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 15] and tries == [0, 0, 1, 0]
    assert out.delivered(spark, "fine", rows.schema).count() == 6 and streams.Delivery({}, str(tmp_path / "none")).ledger(spark).count() == 0 and schema


def test_producers_that_fail_leave_the_others(spark):
    good = lambda spark, run: spark.createDataFrame([("a.c", 3, "low", 7)], "file string, line bigint, severity string, extra int")
    got = producers.produced(spark, Run(Target("t", "/s")), {"a": good, "b": lambda spark, run: spark.range(1), "c": lambda spark, run: 1 / 0, "d": good})
    assert list(got.errors) == ["b", "c"] and "findings need file" in got.errors["b"]
    rows = got.findings.collect()
    assert [(r.producer, r.source_seq, r.file, r.line, r.tool) for r in sorted(rows, key=lambda r: r.source_seq)] == [("a", 0, "a.c", 3, None), ("d", 3, "a.c", 3, None)] and "extra" not in got.findings.columns


def test_text_without_invalid_bytes(spark, tmp_path):
    (tmp_path / "good.c").write_bytes("a\ufffdb".encode())
    (tmp_path / "bad.c").write_bytes("a\ufffd".encode() + b"\xff\xc3b\xe4\xb8")
    kept = {r.rel: r.source for r in artifacts.source_text(spark, str(tmp_path), strict=True).collect()}
    assert kept == {"good.c": "a\ufffdb", "bad.c": "a\ufffdb"}
    shown = {r.rel: r.source for r in artifacts.source_text(spark, str(tmp_path)).collect()}
    assert shown["good.c"] == "a\ufffdb" and shown["bad.c"].count("\ufffd") > 2


def test_corpus_files_in_order(spark, tmp_path):
    for rel in ("h/seeds/b", "h/seeds/a", "h/crashes/t/2", "h/crashes/t/10", "h/crashes/u/1", "g/initial/x", "other"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(rel)
    got = {(r.harness, r.kind, r.bucket, r.id): (r.seq, bytes(r.content).decode()) for r in artifacts.corpus(spark, str(tmp_path)).collect()}
    assert got == {
        ("h", "seeds", None, "a"): (0, "h/seeds/a"), ("h", "seeds", None, "b"): (1, "h/seeds/b"), ("h", "crashes", "t", "10"): (0, "h/crashes/t/10"), ("h", "crashes", "t", "2"): (1, "h/crashes/t/2"),
        ("h", "crashes", "u", "1"): (0, "h/crashes/u/1"), ("g", "initial", None, "x"): (0, "g/initial/x"),
    }
    lines = [f"line {i}" for i in range(5000)]
    log = tmp_path / "p" / "r" / "logs" / "run.log"
    log.parent.mkdir(parents=True)
    log.write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = artifacts.run_log(spark, str(log)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.value for r in sorted(rows, key=lambda r: r.seq)] == lines and {(r.project, r.run_id) for r in rows} == {("p", "r")} and [r.seq for r in sorted(rows, key=lambda r: r.seq)] == list(range(5000))
