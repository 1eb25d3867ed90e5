"""Unified diffs: hunks, validation, manual application."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import split_lines

# Hunk headers, as aligned patches and directly applied ones read them.
HEADER = r"(?U)^@@\s-(\d*),?\d*\s\+\d*,?\d*\s@@"
STRICT = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_HUNK = "array<struct<line_number:int,elines:array<struct<op:string,text:string>>>>"


def _hunks(lines: Column, header: str, kind) -> Column:
    """Folds lines into hunks: kind(line) is a struct<op, text>, or null for lines that don't count."""
    empty = F.array().cast("array<struct<op:string,text:string>>")
    start = F.struct(F.array().cast(_HUNK).alias("done"), F.lit(None).cast("int").alias("at"), empty.alias("now"))

    def state(done: Column, at: Column, now: Column) -> Column:
        return F.struct(done.alias("done"), at.cast("int").alias("at"), now.alias("now"))

    def closed(acc: Column) -> Column:
        one = F.struct(acc["at"].alias("line_number"), acc["now"].alias("elines"))
        return F.when(acc["at"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(one)))

    def step(acc: Column, line: Column) -> Column:
        number = F.coalesce(F.regexp_extract(line, header, 1).try_cast("int"), F.lit(1))
        entry = kind(line)
        return (
            F.when(line.rlike(header), state(closed(acc), number, empty))
            .when(acc["at"].isNull() | entry.isNull(), acc)
            .otherwise(state(acc["done"], acc["at"], F.concat(acc["now"], F.array(entry))))
        )

    return F.aggregate(lines, start, step, closed)


def _entry(op: Column, text: Column) -> Column:
    return F.struct(op.alias("op"), text.alias("text"))


def fuzzy_hunks(patch: Column) -> Column:
    """Hunks for alignment: file headers are skipped, a line without a sign is context whether or not it begins with a space."""

    def kind(line: Column) -> Column:
        op = F.when(line.startswith("+"), "+").when(line.startswith("-"), "-").otherwise("")
        text = F.when(line.rlike(r"^[+\- ]"), F.substring(line, 2, 1 << 30)).otherwise(line)
        return F.when(~(line.startswith("--- ") | line.startswith("+++ ")), _entry(op, text))

    return _hunks(split_lines(patch), HEADER, kind)


def manual_hunks(patch: Column) -> Column:
    """Hunks for direct application: lines of another kind are dropped, empty ones are context."""

    def kind(line: Column) -> Column:
        return F.when(line.rlike(r"^[+\- ]"), _entry(F.substring(line, 1, 1), F.substring(line, 2, 1 << 30))).when(line == "", _entry(F.lit(" "), F.lit("")))

    return _hunks(F.split(patch, "\n", -1), STRICT, kind)


def apply_manually(source: Column, patch: Column) -> Column:
    """struct<success, new_content, error>: each hunk, last first, replaces as many lines as it names at its stated line. Context isn't compared,
    so the result can be wrong; callers flag it."""
    hunks = manual_hunks(patch)

    def put(lines: Column, hunk: Column) -> Column:
        first = F.greatest(hunk["line_number"] - 1, F.lit(0))
        gone = F.size(F.filter(hunk["elines"], lambda e: e["op"].isin("-", " ")))
        new = F.transform(F.filter(hunk["elines"], lambda e: e["op"].isin("+", " ")), lambda e: e["text"])
        return F.concat(F.slice(lines, 1, first), new, F.slice(lines, first + gone + 1, F.greatest(F.size(lines) - first - gone, F.lit(0))))

    done = F.array_join(F.aggregate(F.reverse(hunks), F.split(source, "\n", -1), put), "\n")
    none = F.size(hunks) == 0
    return F.struct((~none).alias("success"), F.when(none, source).otherwise(done).alias("new_content"), F.when(none, "No valid hunks found in patch").alias("error"))


def validation_errors(patch: Column, file: Column, exists: Column) -> Column:
    """array<string> of warnings; a missing file is the only one then."""
    bad = [
        (~patch.contains("@@ -"), F.lit("Patch does not contain valid hunk headers (@@ -...)")),
        (patch.contains("// [OFFLINE]") & (F.size(F.split(patch, "\n", -1)) - 1 < 3), F.lit("Patch appears to be an offline placeholder")),
        (~patch.rlike(STRICT.replace("^", "")), F.lit("No valid hunk headers found in patch")),
    ]
    found = F.filter(F.array(*[F.when(test, text) for test, text in bad]), lambda x: x.isNotNull())
    return F.when(~exists, F.array(F.concat(F.lit("Target file not found: "), file))).otherwise(found)


def cleaned_line(line: Column) -> Column:
    """A patch line with the space that context lines begin with put back where it is missing."""
    fine = line.rlike(HEADER) | line.rlike(r"^(--- |\+\+\+ | |\+|-)")
    return F.when(fine, line).otherwise(F.concat(F.lit(" "), line))
