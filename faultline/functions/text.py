"""Scalar expressions: severities, tokens, truncation, names, paths, prompts, context windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
INFER_SEVERITY = {"medium": "medium", "moderate": "medium", "high": "high", "major": "high", "critical": "critical", "blocker": "critical"}
SEVERITIES = ["info", "low", "medium", "high", "critical"]
LANGUAGES = {".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".java": "java", ".py": "python"}
#: What ends a line for str.splitlines, as a Java pattern.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SMALL_LINES = 10


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def infer_severity(severity: Column) -> Column:
    return _lookup(INFER_SEVERITY, F.lower(F.coalesce(severity, F.lit("LOW"))), "low")


def valid_severity(severity: Column) -> Column:
    """Lower-cased; medium if missing or unknown."""
    return F.when(F.lower(severity).isin(SEVERITIES), F.lower(severity)).otherwise(F.lit("medium"))


def safe_int(text: Column) -> Column:
    """A whole number, 0 if there is none."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def finding_id(tool: Column, check_id: Column, file: Column, line: Column) -> Column:
    return F.concat_ws(":", tool, check_id, file, line.cast("string"))


def function_prefix(file: Column, name: Column) -> Column:
    return F.concat_ws(":", file, name)


def range_slice(source: Column, start: Column, end: Column) -> Column:
    """Characters of a half-open range, from 0."""
    return F.substr(source, start + 1, end - start)


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def is_small(start: Column, end: Column) -> Column:
    return line_count(start, end) < SMALL_LINES


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines gives them: the empty one after a last line end is dropped."""
    bare = F.regexp_replace(text, F.lit(rf"(?:{LINE_END})\z"), F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, LINE_END, -1))


def snippet(text: Column, lines: int = 200) -> Column:
    return F.array_join(F.slice(split_lines(text), 1, lines), "\n")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n", -1))


def normal_space(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def n_words(text: Column) -> Column:
    bare = normal_space(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " ")))


def token_estimate(prompt: Column) -> Column:
    """By words: 1.3 tokens each."""
    return n_words(prompt) * F.lit(1.3)


def token_quarter(*texts: Column) -> Column:
    """By characters: a quarter of the summed lengths, rounded down."""
    total = F.lit(0)
    for t in texts:
        total = total + F.char_length(t)
    return F.floor(total / 4)


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1)), "c")


def is_c_cpp(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(c|cc|cpp|cxx|h|hpp)$")


def relative_posix(path: Column, root: Column) -> Column:
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.char_length(base) + 1)).otherwise(path)


def content_id(content: Column) -> Column:
    return F.sha1(content)


def patch_hash(patch: Column) -> Column:
    return F.substring(F.sha2(patch, 256), 1, 16)


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def saved_patch_name(index: Column, path: Column, finding: Column) -> Column:
    safe = F.substring(F.regexp_replace(finding, r"(?U)[^\w\-]", "_"), 1, 50)
    return F.concat(F.format_string("patch_%03d_", index), F.regexp_replace(path, r"[/\\]", "_"), F.lit("_"), safe)


def harness_seconds(total: Column, harnesses: Column) -> Column:
    return F.greatest(F.lit(30), F.floor(total / harnesses))


def context_window(source: Column, line: Column, k: int) -> Column:
    """Numbered lines around one, which is marked."""
    first = F.greatest(F.lit(0), line - k - 1)
    shown = F.slice(split_lines(source), first + 1, F.greatest(line + k - first, F.lit(0)))
    number = lambda i: first + i + 1
    rows = F.transform(shown, lambda x, i: F.concat(F.format_string("%4d", number(i)), F.when(number(i) == line, F.lit(">>> ")).otherwise(F.lit("    ")), x))
    return F.array_join(rows, "\n")


def glob_pattern(glob: str) -> str:
    """A Java pattern for a file-name glob whose * crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i:end].replace("\\", "\\\\")
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def flat_messages(messages: Column) -> Column:
    """array<struct<role, content>> as one prompt."""
    name = lambda m: F.when(m["role"] == "system", "System").when(m["role"] == "assistant", "Assistant").otherwise("User")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), name(m), F.lit("]: "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def function_prompt(project: Column, file: Column, names: Column, lines: Column, code: Column, limit: int) -> Column:
    """The review request of an analysis unit."""
    return F.concat(
        F.lit("Project: "), project, F.lit("\nFile: "), file, F.lit("\nFunctions: "), F.array_join(names, ", "), F.lit("\nLines: "), lines,
        F.lit(f"\nReport at most {limit} findings as JSON.\n\n"), code,
    )


def patch_prompt(vuln: Column, severity: Column, file: Column, line: Column, description: Column, function: Column, trace: Column, context: Column) -> Column:
    """The fix request of a finding; a crash trace is added where there is one."""
    return F.concat(
        F.lit("**Vulnerability:** "), vuln, F.lit("\n**Severity:** "), severity, F.lit("\n**File:** "), file, F.lit("\n**Line:** "), line.cast("string"),
        F.lit("\n**Description:** "), description, F.when(F.coalesce(function, F.lit("")) != "", F.concat(F.lit("\n**Function:** "), function)).otherwise(F.lit("")),
        F.when(trace.isNotNull(), F.concat(F.lit("\n**Trace:**\n"), F.when(trace == "", F.lit("N/A")).otherwise(trace))).otherwise(F.lit("")),
        F.lit("\n```"), language(file), F.lit("\n"), context, F.lit("\n```"),
    )


def placeholder_patch(prompt: Column) -> Column:
    """A patch that changes nothing, for a request made offline."""
    file = F.coalesce(F.nullif(F.regexp_extract(prompt, r"(?U)\*\*File:\*\*\s*(\S+)", 1), F.lit("")), F.lit("unknown.c"))
    line = F.coalesce(F.nullif(F.regexp_extract(prompt, r"(?U)\*\*Line:\*\*\s*(\d+)", 1), F.lit("")), F.lit("1"))
    return F.concat(
        F.lit("```yaml\nanalysis: |\n  [OFFLINE MODE] no analysis\nfix_strategy: |\n  [OFFLINE MODE] no strategy\nfile_path: "), file,
        F.lit("\npatch: |\n  @@ -"), line, F.lit(",1 +"), line, F.lit(",1 @@\n   // [OFFLINE] no changes made\n```"),
    )
