"""Reading model responses: findings as JSON, patches as YAML, unified diffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import valid_severity

# Patterns that results depend on.
FENCED_JSON = r"(?U)```(?:json)?\s*\n?([\s\S]*?)\n?```"
BRACES = r"(\{[\s\S]*\})"
PATCH_BLOCKS = [r"(?is)```yaml\s*(.*?)```", r"(?is)```yml\s*(.*?)```", r"(?is)```\s*(analysis:.*?)```"]
#: Keys with a plain line or a block each, in ASCII, which libyaml and PyYAML read alike; they differ in some tags, flow items, tabs and marks.
ALIKE = re.compile(r"(?:[A-Za-z_]+: (?:[A-Za-z0-9_][A-Za-z0-9_ ./(),;'+=<>-]*\n|[|>][-+]?\n(?: [\x20-\x7e]*\n|\n)*))+")
DIFF_HUNK = r"(?s)(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@.*?)(?=\n@@ |\n```|\z)"

#: One item of a findings list; everything is read as a string, as models mix types.
_ITEM = "check_id string, severity string, file string, line string, title string, detail string, function_name string"


def json_text(response: Column) -> Column:
    """The JSON in a response: of the first fenced block, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(response, r"(?U)^\s+|\s+$", ""))
    fenced = F.regexp_extract(bare, FENCED_JSON, 1)
    inner = F.when(bare.rlike(FENCED_JSON), F.regexp_replace(fenced, r"(?U)^\s+|\s+$", "")).otherwise(bare)
    return F.when(inner.startswith("{"), inner).otherwise(F.coalesce(F.nullif(F.regexp_extract(inner, BRACES, 1), F.lit("")), inner))


def response_findings(responses: DataFrame, response: str = "response", default_file: str = "default_file") -> DataFrame:
    """Rows of responses, one for each finding: check_id, file, line, severity, title, detail, function_name, raw_payload, pos. A response
    that isn't JSON has none; items that aren't objects are left out; missing fields have defaults."""
    parsed = F.try_parse_json(json_text(F.col(response)))
    items = F.from_json(F.coalesce(F.to_json(F.try_variant_get(parsed, "$.findings", "array<variant>")), F.lit("[]")), "array<string>")
    rows = responses.withColumn("_items", items).select("*", F.posexplode("_items").alias("pos", "raw_payload")).drop("_items")
    rows = rows.where(F.col("raw_payload").startswith("{")).withColumn("_i", F.from_json("raw_payload", _ITEM))
    i = F.col("_i")
    line = F.coalesce(i["line"].try_cast("int"), F.when(i["line"].rlike(r"^-?\d+\.\d+$") & F.col("raw_payload").rlike(r'"line"\s*:\s*-?\d'), i["line"].try_cast("double").cast("int")), F.lit(0))
    return rows.select(
        *[c for c in responses.columns if c != response], "pos", F.lit("langchain-llm").alias("tool"), F.coalesce(i["check_id"], F.lit("LLM_HEURISTIC")).alias("check_id"),
        F.coalesce(i["file"], F.col(default_file)).alias("file"), line.alias("line"), valid_severity(F.coalesce(i["severity"], F.lit("medium"))).alias("severity"),
        F.coalesce(i["title"], F.lit("Potential vulnerability")).alias("title"), F.coalesce(i["detail"], F.lit("")).alias("detail"), i["function_name"].alias("function_name"), "raw_payload",
    )


def response_summary(response: Column) -> Column:
    """The summary of a response, or that it couldn't be read."""
    parsed = F.try_parse_json(json_text(response))
    bad = F.concat(F.lit("JSON parse error. Raw response: "), F.substring(response, 1, 200))
    return F.when(parsed.isNull(), bad).otherwise(F.coalesce(F.try_variant_get(parsed, "$.summary", "string"), F.lit("")))


_PATCH = "analysis string, fix_strategy string, file_path string, patch string"


def patch_text(response: Column) -> Column:
    """The YAML of a patch response, or null: a yaml, yml or plain fenced block, else the whole text if it looks like one."""
    first = F.lit(None).cast("string")
    for p in reversed(PATCH_BLOCKS):
        first = F.when(response.rlike(p), F.regexp_extract(response, p, 1)).otherwise(first)
    first = F.nullif(F.regexp_replace(first, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(first, F.when(response.contains("analysis:") & response.contains("patch:"), response))


def loaded(text: str) -> object:
    """yaml.safe_load, by libyaml where it is there and the text is of the usual form; what it refuses is left to the other."""
    import yaml

    if yaml.__with_libyaml__ and ALIKE.fullmatch(text if text.endswith("\n") else f"{text}\n"):
        try:
            return yaml.load(text, Loader=yaml.CSafeLoader)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(text)


def _yaml(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    names = [x.split()[0] for x in _PATCH.split(", ")]
    for series in texts:
        rows = []
        for text in series:
            row: list = [None] * 4
            if text is not None:
                try:
                    got = loaded(text)
                except yaml.YAMLError:
                    got = None
                if isinstance(got, dict) and all(n in got for n in names):
                    row = [str(got[n]) for n in names]
            rows.append(row)
        yield pd.DataFrame(rows, columns=names)


def parsed_patch(response: Column) -> Column:
    """struct<analysis, fix_strategy, file_path, patch>; its fields are null where there is no patch. YAML needs Python, in Arrow batches."""
    return F.pandas_udf(_yaml, _PATCH)(patch_text(response))


def unified_diff(text: Column) -> Column:
    """All hunks in a text, joined; else the lines that look like one; else null."""
    hunks = F.regexp_extract_all(text, F.lit(DIFF_HUNK), F.lit(1))
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, line: Column) -> Column:
        on = acc["on"] | line.startswith("@@")
        keeps = line.rlike(r"^(@@| |\+|-)") | (F.trim(line) == "")
        got = F.when(on & keeps, F.concat(acc["got"], F.array(line))).otherwise(acc["got"])
        return F.when(acc["over"], acc).otherwise(F.struct(on.alias("on"), (on & ~keeps & line.startswith("```")).alias("over"), got.alias("got")))

    like = F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: acc["got"])
    return F.when(F.size(hunks) > 0, F.array_join(hunks, "\n")).when(F.size(like) > 0, F.array_join(like, "\n"))
