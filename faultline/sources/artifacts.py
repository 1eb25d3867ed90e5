"""Scans of run artifacts. Paths are read by Spark, so any store that Spark reads will do (a corpus in a mounted folder by tasks of its own); schemas are declared, never inferred."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import scanned
from ..schemas import COMPILE_COMMANDS, INFER_ISSUES, TOOL_CALLS
from . import files

_RUN = r"/([^/]+)/([^/]+)/(?:logs|artifacts)/"


def with_run(rows: DataFrame, path: str = "path") -> DataFrame:
    """project and run_id from the folder layout <workspace>/<project>/<run_id>/{logs,artifacts}."""
    return rows.withColumns({"project": F.regexp_extract(path, _RUN, 1), "run_id": F.regexp_extract(path, _RUN, 2)})


def infer_report(spark: SparkSession, path: str) -> DataFrame:
    """Issues of report.json files with `seq`, their place in a file. A file is one JSON array, which is split after it is read."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{INFER_ISSUES}>>").alias("a"))
    return text.select("path", F.posexplode("a").alias("seq", "i")).select("path", F.col("seq").cast("bigint"), "i.*")


def source_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, rel, length of all files below root, without reading them; a pattern prunes the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^file:/+", "/")
    return reader.load(root).select(plain.alias("path"), F.regexp_replace(plain, "^" + _quoted(base), "").alias("rel"), "length", "modificationTime")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def source_text(spark: SparkSession, root: str, pattern: str | None = None, strict: bool = False) -> DataFrame:
    """path, rel, source of files; invalid UTF-8 becomes the replacement character, or is left out where strict. A replacement character that stands in a file stays. Spark's source gives no row for an empty file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    given = F.col("content").cast("string")
    text = F.make_valid_utf8(given)
    if strict:  # bytes are looked at one by one only in the files that need it
        text = F.when(F.is_valid_utf8(given), text).otherwise(F.pandas_udf(_without_invalid, "string")(F.when(~F.is_valid_utf8(given), F.col("content"))))
    return reader.load(root).select(plain.alias("path"), F.regexp_replace(plain, "^" + _quoted(root.rstrip("/") + "/"), "").alias("rel"), text.alias("source"))


def _without_invalid(contents: pd.Series) -> pd.Series:
    return contents.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))


def corpus(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Files of a corpus: harness, kind (seeds, crashes, initial), bucket (of crashes), id, length, content, path, and seq, from 0 by path within harness, kind and bucket. Harness is the folder above.
    Without contents no file is opened; with_content adds them. A mounted folder is listed by tasks, any other by Spark's source."""
    rows = files.listed(spark, root) if files.mounted(spark, root) else _binary(spark, root).select("path", "length")
    at = lambda k: F.try_element_at("_parts", F.lit(k))
    crash = F.coalesce((at(-3) == "crashes") & (at(-4) != "") & (at(-2) != "") & (at(-1) != ""), F.lit(False))
    kept = at(-2).isin("seeds", "initial") & (at(-3) != "") & (at(-1) != "")
    rows = rows.withColumn("_parts", F.split("path", "/")).select(
        F.when(crash, at(-4)).when(kept, at(-3)).alias("harness"), F.when(crash, at(-3)).when(kept, at(-2)).alias("kind"), F.when(crash, at(-2)).alias("bucket"), F.when(crash | kept, at(-1)).alias("id"), "length", "path"
    )
    numbered = scanned(rows.where("kind is not null"), ["harness", "kind", "bucket"], ["path"], place="_n").withColumn("seq", F.col("_n") - 1).drop("_n")
    return with_content(spark, root, numbered).select("harness", "kind", "bucket", "id", "length", "content", "path", "seq") if content else numbered


def with_content(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """rows of a corpus, or of a join or choice of them, with the contents of their files. Each run of the result reads them again."""
    return files.with_content(rows) if files.mounted(spark, root) else rows.join(_binary(spark, root).select("path", "content"), "path")


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def listed_crashes(found: DataFrame) -> DataFrame:
    """Crashes as a corpus lists them: sizes from the file, no time and no trace."""
    return found.where("kind = 'crashes'").select(
        F.col("id").alias("crash_id"), F.col("path").alias("input_path"), F.col("length").alias("input_size"), F.col("bucket").alias("dedup_token"), "harness",
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit("").alias("stack_trace"), F.lit("").alias("signal"),
    )


def compile_commands(spark: SparkSession, path: str, root: str | None = None, mount: str = "/src") -> DataFrame:
    """Entries of compile_commands.json; with a root, paths below it are moved to the mount."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{COMPILE_COMMANDS}>>").alias("a"))
    rows = text.select(F.posexplode("a").alias("seq", "c")).select("seq", "c.*")
    if root:
        moved = lambda c: F.replace(c, F.lit(root), F.lit(mount))
        rows = rows.withColumns({"directory": moved(F.col("directory")), "file": moved(F.col("file")), "command": moved(F.col("command")), "output": moved(F.col("output")), "arguments": F.transform("arguments", moved)})
    return rows


def binaries(spark: SparkSession, build_dir: str) -> DataFrame:
    """name and executable of a build folder's files. Mode bits aren't in any Spark source, so the Hadoop file system lists the folder on the driver."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(build_dir)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(f.getPath().getName(), "x" in f.getPermission().toString()) for f in listed if f.isFile()]
    return spark.createDataFrame(rows, "name string, executable boolean")


def tool_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOOL_CALLS).json(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of run logs with project, run_id and seq, their place in the log from 0. A log is a file, or the files <log>.part-<number>, in order."""
    # lines of one part of a file are in order of the id, parts in order of their place
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part_at"), F.monotonically_increasing_id().alias("_line"))
    part = F.regexp_extract("_file", r"\.part-(\d+)$", 1)
    rows = rows.withColumns({"path": F.regexp_replace("_file", r"\.part-\d+$", ""), "_file_at": F.when(part != "", part.cast("bigint")).otherwise(0)}).drop("_file")
    numbered = scanned(rows, ["path"], ["_file_at", "_part_at", "_line"], place="_n")
    return with_run(numbered.select("value", "path", (F.col("_n") - 1).alias("seq")))
