"""Findings: normalisation of analyser reports, union, histograms, the heuristic scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import infer_severity

# Literal, check, severity, detail; their order counts.
HEURISTICS = [
    ("strcpy", "BUFFER_OVERRUN", "high", "Unbounded string copy via strcpy"),
    ("memcpy", "BUFFER_OVERRUN", "medium", "Potential buffer overflow via memcpy"),
    ("sprintf", "BUFFER_OVERRUN", "high", "Unbounded sprintf into buffer"),
    ("gets", "BUFFER_OVERRUN", "critical", "Use of unsafe gets() function"),
    ("scanf(", "BUFFER_OVERRUN", "medium", "Potential buffer overflow via scanf"),
    ("free(", "USE_AFTER_FREE", "medium", "Memory deallocation - check for UAF"),
    ("printf(", "FORMAT_STRING", "medium", "Printf call - check format string safety"),
    ("malloc(", "NULLPTR_DEREFERENCE", "low", "Malloc call - check NULL return"),
]


def infer_findings(issues: DataFrame) -> DataFrame:
    """Rows of an Infer report as findings."""
    return issues.select(
        F.lit("infer").alias("tool"), F.coalesce("bug_type", F.lit("UNKNOWN")).alias("check_id"), F.coalesce("file", F.lit("unknown")).alias("file"),
        F.coalesce("line", F.lit(0)).alias("line"), infer_severity(F.col("severity")).alias("severity"),
        F.coalesce("qualifier", "bug_type_hum", F.lit("Infer issue")).alias("title"), F.coalesce(F.to_json("bug_trace"), F.lit("")).alias("detail"),
        F.to_json(F.struct(*[c for c in issues.columns if c != "seq"])).alias("raw_payload"), "seq",
    )


def union_all(*parts: DataFrame) -> DataFrame:
    """Parts in order; `seq` is (part, seq) as one number, and nothing is deduplicated."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("seq", F.lit(k).cast("bigint") * F.lit(1 << 40) + F.col("seq"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def by_source(findings: DataFrame) -> DataFrame:
    """llm, infer and total counts."""
    llm = F.count_if(F.col("tool") == "langchain-llm")
    return findings.agg(llm.alias("llm_findings"), F.count_if(F.col("tool") == "infer").alias("infer_findings"), F.count("*").alias("total"))


def histogram(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """Counts of values with the place at which each was first seen."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))


def breakdown(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """One row: `value:count` in first-seen order, or 'no issues'."""
    listed = F.sort_array(F.collect_list(F.struct("first_seq", value, "n")))  # one entry for each value
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x[value], x["n"].cast("string"))), ", ")
    return histogram(rows, value, seq).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit("no issues")).alias("breakdown"))


def highlights(rows: DataFrame, keys: list[str], text: str, seq: str, n: int = 500) -> DataFrame:
    """Texts of a group joined in order and cut, without nulls; null for a group that has none. Only the first n of them can show, so no more are gathered."""
    from pyspark.sql import Window

    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(text).isNull(), seq))).where(F.col("_n") <= n)
    shown = F.when(F.col(text).isNotNull(), F.struct("_n", F.substring(text, 1, n).alias("t")))
    few = few.groupBy(*keys).agg(F.sort_array(F.collect_list(shown)).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["t"]), " | ")
    return few.select(*keys, F.when(F.size("_l") > 0, F.substring(joined, 1, n)).alias("highlights"))


def heuristic_hits(code: Column, table: list[tuple] = HEURISTICS, limit: int = 3) -> Column:
    """array<struct<check_id, severity, detail>> of the first `limit` literals that occur, in the order of the table."""
    entries = [
        F.when(code.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("check_id"), F.lit(s).alias("severity"), F.lit(d).alias("detail"))) for p, c, s, d in table
    ]
    return F.slice(F.filter(F.array(*entries), lambda x: x.isNotNull()), 1, limit)


def heuristic_findings(units: DataFrame, code: str = "code", file: str = "file_path") -> DataFrame:
    """The offline findings of code units."""
    rows = units.select("*", F.posexplode(heuristic_hits(F.col(code))).alias("pos", "_h"))
    title = F.concat(F.lit("Potential "), F.initcap(F.replace(F.col("_h.check_id"), F.lit("_"), F.lit(" "))))
    return rows.select(
        F.lit("langchain-llm").alias("tool"), F.col("_h.check_id").alias("check_id"), F.col(file).alias("file"), F.lit(0).alias("line"), F.col("_h.severity").alias("severity"),
        title.alias("title"), F.concat(F.lit("[OFFLINE] "), "_h.detail").alias("detail"), F.lit("unknown").alias("function_name"), "pos",
    )
