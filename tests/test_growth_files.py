"""Many files: written and scanned by tasks."""

import os

from pyspark.sql import functions as F

from faultline import scratch
from faultline.plans.files import corpus_and_log_order
from faultline.sources import artifacts, files


def listed(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


# --- many files ---


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """The driver's commit isn't asked, so no list of names reaches it."""
    monkeypatch.setattr(files.ArtifactWriter, "commit", None)
    rows = spark.range(3000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id").alias("name"), F.col("id").cast("string").alias("content"))
    for _ in range(2):
        files.write_files(rows.repartition(5), str(tmp_path))
    assert listed(tmp_path) == {f"d{i % 7}/f{i}": str(i).encode() for i in range(3000)}
    files.write_files(rows.where("id < 9"), str(tmp_path), mode="overwrite")
    assert set(listed(tmp_path)) == {f"d{i % 7}/f{i}" for i in range(9)} and not [x for x in tmp_path.iterdir() if x.name.startswith(("_", "."))]


def test_a_scan_has_few_partitions(tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"p/r{i:02d}/logs").mkdir(parents=True)
        (tmp_path / f"p/r{i:02d}/logs/run.log").write_text(str(i))
    rows = lambda reader, parts: [r for x in parts for b in reader.read(x) for r in b.to_pylist()]
    whole = files.ArtifactReader({"path": str(tmp_path)})
    want = rows(whole, whole.partitions())
    assert len(whole.partitions()) == 40 and len(want) == 40
    monkeypatch.setattr(files, "TASKS", 6)
    for few in (1000, 5):  # kinds listed by the driver, or by tasks
        monkeypatch.setattr(files, "FEW", few)
        assert len(whole.partitions()) == 6 and rows(whole, whole.partitions()) == want
    monkeypatch.setattr(files, "LARGE", 20)
    for i in range(50):
        (tmp_path / f"p/r00/logs/x{i}").write_text("x")
    one = files.ArtifactReader({"path": str(tmp_path)})
    one.chosen = {"run_id": {"r00"}}
    parts = one.partitions()
    assert len(parts) == files.PARTS and len(rows(one, parts)) == 51 and max(len(rows(one, [x])) for x in parts) < 10


def test_a_corpus_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Spark's source lists every file on the driver and opens a task for a few; a mounted corpus doesn't go by it. The same files and places come out."""
    for rel in ("h/seeds/b", "h/seeds/a", "h/crashes/seeds/2", "h/crashes/t/10", "h/crashes/t/.x", "h/crashes/t/_y", "h/crashes/t/_y=", "h/crashes/crashes/z/1", "g/initial/x", "seeds/q", "other", "h/crashes/deep"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(rel)
    shown = lambda rows: sorted((r.path, r.harness, r.kind, r.bucket, r.id, r.length, r.seq, bytes(r.content).decode()) for r in rows.collect())
    with monkeypatch.context() as m:
        m.setattr(files, "mounted", lambda *_: False)
        want = shown(artifacts.corpus(spark, str(tmp_path)))
    monkeypatch.setattr(artifacts, "_binary", None)
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        assert shown(artifacts.corpus(spark, root)) == want and len(want) == 8
    found = artifacts.corpus(spark, str(tmp_path), content=False)
    assert "content" not in found.columns and shown(artifacts.with_content(spark, str(tmp_path), found)) == want


def test_contents_leave_in_bounded_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "h/seeds").mkdir(parents=True)
    for k in range(20):
        (tmp_path / f"h/seeds/s{k:02d}").write_bytes(bytes([k]) * 10)
    monkeypatch.setattr(files, "BATCH", 25)
    assert {r.id: bytes(r.content) for r in artifacts.corpus(spark, str(tmp_path)).collect()} == {f"s{k:02d}": bytes([k]) * 10 for k in range(20)}


def test_logs_in_parts(spark, tmp_path):
    """A log of any length is written in parts, none of them longer than a part, and read as one."""
    lines = spark.range(1000, numPartitions=5).select(F.concat(F.lit("p/r"), F.col("id") % 2, F.lit("/logs/run.log")).alias("name"), (-F.col("id")).alias("at"), F.concat(F.lit("line "), "id").alias("line"))
    parts = files.log_parts(lines, "at", 9)
    assert max(r.content.count("\n") for r in parts.collect()) == 8
    files.write_files(parts, str(tmp_path))
    got = artifacts.run_log(spark, f"{tmp_path}/p/*/logs/run.log.part-*").collect()
    assert sorted((r.run_id, r.seq, r.value) for r in got) == sorted((f"r{k % 2}", n, f"line {k}") for half in (0, 1) for n, k in enumerate(range(998 + half, -1, -2)))


def test_the_log_holds_all_orders(spark, tmp_path):
    spark.range(3).selectExpr("id as p_partkey", "'n' || id as p_name").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 60, 7).selectExpr("id as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r.seq, r.p_partkey, r.source) for r in corpus_and_log_order(spark, str(tmp_path)).where("kind = 'log'").collect())
    assert got == [(n, k, f"order {k}") for n, k in enumerate(range(1, 60, 7))]


def test_packed_files_take_less_disk(spark, tmp_path):
    """Files of a run can be written compressed; the scan shows the names, lengths and contents that were given, and no stored rows stay behind."""
    rows = spark.range(40).select(F.concat(F.lit("p/r"), F.col("id") % 3, F.lit("/artifacts/f/d"), "id", F.lit(".json")).alias("name"), F.concat(F.repeat(F.lit("text "), 5000), F.col("id").cast("string")).alias("content"))
    size = lambda folder: sum(len(x) for x in listed(folder).values())
    shown = {}
    before = set(scratch._made)
    for packed in (False, True):
        files.write_files(rows, str(tmp_path / f"w{packed}"), packed=packed, times=2)
        for content in (True, False):
            shown[packed, content] = sorted((r.project, r.run_id, r.kind, r.rel, r.name, r.length, r.content and bytes(r.content)) for r in files.artifact_files(spark, str(tmp_path / f"w{packed}"), content).collect())
    assert shown[True, True] == shown[False, True] and shown[True, False] == shown[False, False] and len(shown[True, True]) == 40
    assert size(tmp_path / "wTrue") * 20 < size(tmp_path / "wFalse")
    assert not [path for _, path in set(scratch._made) - before if "/files-" in path and os.path.exists(files.plain_path(path))]
