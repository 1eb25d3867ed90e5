"""Functions in C sources: by pattern and plain braces, or by the grammar of definitions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .definitions import KEYWORDS, SMALL_LINES, UNMATCHED, Definition, Lines, definitions, found_definitions, function_row, parse_definitions

# Fixed values.
HEAD = re.compile(r"^(?P<signature>(?:static\s+)?(?:inline\s+)?(?:const\s+)?[\w\s*]+\s+(?P<name>\w+)\s*\([^)]*\))\s*\{", re.MULTILINE)
NONE = "No functions found (regex fallback mode)"

_BRACE = re.compile("[{}]")

_FUNCTION = "seq:bigint,name:string,start_line:int,end_line:int,signature:string,body:string,byte_range:struct<start_byte:int,end_byte:int>,is_small:boolean"
_PARSED = f"struct<functions:array<struct<{_FUNCTION}>>,parse_errors:array<string>>"
_RANGE = pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32())])
_FIELDS = [("seq", pa.int64()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("body", pa.string()), ("byte_range", _RANGE), ("is_small", pa.bool_())]
_RESULT = pa.struct([("functions", pa.list_(pa.struct(_FIELDS))), ("parse_errors", pa.list_(pa.string()))])
#: Characters of signatures and bodies, and functions, in one batch, about.
BATCH, ROWS = 4 << 20, 4096


def closing_braces(source: str, wanted: set[int] | None = None) -> dict[int, int]:
    """The place after the brace that closes each one, or each wanted one, for those that are closed; all braces count. One pass with a stack."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for b in _BRACE.finditer(source):
        if b[0] == "{":
            open_.append(b.start())
        elif open_ and (wanted is None or open_[-1] in wanted):
            out[open_.pop()] = b.end()
        elif open_:
            open_.pop()
    return out


def found_functions(source: str) -> Iterator[tuple | str]:
    """Function rows of one source in order, and errors. Offsets are in characters."""
    heads = [(m.start(), m.end() - 1, m["name"], m.end("signature")) for m in HEAD.finditer(source) if m["name"] not in KEYWORDS]
    closed = closing_braces(source, {brace for _, brace, _, _ in heads}) if heads else {}
    lines, seq = Lines(source), 0
    for start, brace, name, signed in heads:
        if end := closed.get(brace):
            first, last = lines.of(start, end)
            yield seq, name, first, last, source[start:signed].strip(), source[start:end], (start, end), last - first + 1 < SMALL_LINES
            seq += 1
        else:
            yield UNMATCHED.format(name)


def parse_functions(source: str) -> tuple[list[tuple], list[str]]:
    """Function rows and errors of one source."""
    found = list(found_functions(source))
    rows, errors = [x for x in found if not isinstance(x, str)], [x for x in found if isinstance(x, str)]
    return rows, errors or ([] if rows else [NONE])


_MODES: dict[str, tuple[Callable, Callable]] = {"pattern": (parse_functions, found_functions), "syntax": (parse_definitions, found_definitions)}


def _struct(row: tuple) -> dict:
    return dict(zip((n for n, _ in _FIELDS), row)) | {"byte_range": {"start_byte": row[6][0], "end_byte": row[6][1]}}


def parsed_files(sources: DataFrame, path: str = "path", source: str = "source", mode: str = "pattern") -> DataFrame:
    """sources with `functions` and `parse_errors`, by mode pattern or syntax. Brace matching over arbitrary text needs Python, in Arrow batches; what is put out at once is the functions of
    a few sources, however many come in. `functions` puts them out one by one."""
    parse = _MODES[mode][0]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            rows, size = [], 0
            for text in array:
                found, errors = parse(text.as_py() or "")
                rows.append({"functions": [_struct(f) for f in found], "parse_errors": errors})
                size += sum(len(f[5]) + 500 for f in found)
                if size > BATCH:
                    yield pa.array(rows, _RESULT)
                    rows, size = [], 0
            yield pa.array(rows, _RESULT)

    return sources.withColumn("_p", F.arrow_udf(run, _PARSED)(F.col(source))).select("*", "_p.functions", "_p.parse_errors").drop("_p")


def parse_errors(sources: DataFrame, source: str = "source", mode: str = "pattern") -> DataFrame:
    """sources with `parse_errors` alone, for which no function is put out."""
    found_in = _MODES[mode][1]

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            rows = []
            for text in array:
                errors, some = [], False
                for x in found_in(text.as_py() or ""):
                    if isinstance(x, str):
                        errors.append(x)
                    some = some or not isinstance(x, str)
                rows.append(errors or ([] if some or mode != "pattern" else [NONE]))
            yield pa.array(rows, pa.list_(pa.string()))

    return sources.withColumn("parse_errors", F.arrow_udf(run, "array<string>")(F.col(source)))


def functions(sources: DataFrame, path: str = "path", source: str = "source", mode: str = "pattern") -> DataFrame:
    """One row for each function: file_path and the fields of a function, in order of their first line. A task holds a batch of rows, and of a file its text, not the list of its functions."""
    found_in = _MODES[mode][1]
    kind = sources.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.columns
            at: list[int] = []
            rows: list[tuple] = []
            size = 0

            def made() -> pa.RecordBatch:
                columns = [list(c) for c in zip(*rows)]
                columns[6] = [{"start_byte": a, "end_byte": b} for a, b in columns[6]]
                return pa.RecordBatch.from_arrays([paths.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, (_, k) in zip(columns, _FIELDS))], ["file_path", *(n for n, _ in _FIELDS)])

            for k in range(batch.num_rows):
                for f in found_in(texts[k].as_py() or ""):
                    if isinstance(f, str):
                        continue
                    at.append(k)
                    rows.append(f)
                    size += len(f[4]) + len(f[5])
                    if size > BATCH or len(rows) >= ROWS:
                        yield made()
                        at, rows, size = [], [], 0
            if rows:
                yield made()

    return sources.select(path, source).mapInArrow(run, f"file_path {kind}, " + ", ".join(x.replace(":", " ", 1) for x in _split(_FUNCTION)))


def _split(fields: str) -> list[str]:
    """The fields of a type, whose nested ones hold commas too."""
    return re.findall(r"(?:[^,<]|<[^>]*>)+", fields)


@udtf(returnType=_FUNCTION.replace("byte_range:struct<start_byte:int,end_byte:int>", "start_byte:int,end_byte:int"))
class CFunctions:
    """The functions of a C source by grammar, as a table function: rows leave one by one, so a file's list is never held."""

    def eval(self, source: str) -> Iterator[tuple]:
        if source is None:
            return
        lines = Lines(source)
        found = (x for x in definitions(source) if not isinstance(x, Definition))
        for seq, (head, end) in enumerate(found):
            name, first, last, signature, body, (start, stop), small = function_row(source, lines, head, end)
            yield seq, name, first, last, signature, body, start, stop, small


def register(spark: SparkSession) -> None:
    """Makes `c_functions(source)` known to SQL, for `LATERAL`."""
    spark.udtf.register("c_functions", CFunctions)
