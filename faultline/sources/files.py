"""Run artifacts as a Spark data source: a scan of the folders of runs, and a writer that puts one named file for each row.

    register(spark)
    spark.read.format("artifact_files").load(workspace).where("project = 'p' and kind = 'logs'")
    write_files(rows.select("name", "content"), folder)

Scan: files below <workspace>/<project>/<run_id>/<kind>/, in order of their path within a folder. Filters on project, run_id and kind choose folders before anything in them is listed.
A partition is a folder, or many of them where there are more than TASKS; a folder on a mounted disk with more than LARGE files is dealt to several. Beyond FEW runs the executors list what is in them.
Mode bits are read by the executors, where the folder is a mounted one; elsewhere they are null. Option content=false leaves contents out.

listed, with_content: files of any layout below a mounted folder. Tasks list a level of folders at a time, so the driver holds no list of files; contents are read by path, after rows are numbered, joined or chosen.

log_parts: lines of logs of any length as rows for write_files; a log's parts are files <name>.part-<number>, in order.

write_files: rows (name, content as string or binary) are stored; when all are made and their names known to be good and unique, tasks write the files, each under a hidden name first. Short ones are dealt to
all tasks first, as a file costs its time however short it is; the stored rows go when the files are there. So nothing but counts reaches the driver, rows that fail leave no files, no file is ever seen in part, and writing the same rows again changes nothing. A name that comes twice, is empty, null or leads out of the folder fails the write. A null
content is an empty file. Paths are what pyarrow's file systems open (mounted folders, hdfs, object stores). The data source writes by the same rules into a folder beside, and its driver moves the files: for some
thousand of them.
"""

from __future__ import annotations

import gzip
import logging
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.scan import scanned
from ..scratch import dropped, stored, stored_bytes
from ..scratch import folder as scratch

log = logging.getLogger(__name__)

FILES = "project string, run_id string, kind string, rel string, name string, length bigint, mode int, executable boolean, content binary"
_ARROW = pa.schema([(n, pa.string()) for n in ("project", "run_id", "kind", "rel", "name")] + [("length", pa.int64()), ("mode", pa.int32()), ("executable", pa.bool_()), ("content", pa.binary())])
_FOLDERS = ("project", "run_id", "kind")
_STAGED = "_staged-"
#: The end of the names of files that are written compressed. The scan shows them by the name and with the content and length that were given.
PACKED = ".packed.gz"
#: Tasks of a scan of many folders; runs whose folders the driver lists; files of a folder that one task reads; parts of a larger one.
TASKS, FEW, LARGE, PARTS = 256, 1000, 20_000, 64
#: Bytes of contents and files in one batch, about.
BATCH, ROWS = 4 << 20, 4096
#: Lines in a part of a log.
LOG_LINES = 50_000


def plain_path(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(plain_path(path))


def scheme_of(path: str) -> str:
    """What stands before a path of a store that isn't mounted."""
    return path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def _listed(store: fs.FileSystem, path: str, kind: fs.FileType) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((x for x in found if x.type == kind and not hidden(x.base_name)), key=lambda x: x.path)


def _entries(store: fs.FileSystem, path: str) -> list[tuple[str, bool]]:
    """Names in a folder, and whether each is a folder, in order of the paths below them."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as found:
            names = [(x.name, x.is_dir()) for x in found]
    else:
        names = [(x.base_name, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(path))]
    return sorted(names, key=lambda x: x[0] + "/" * x[1])


def walked(store: fs.FileSystem, path: str) -> Iterator[str]:
    """Paths of the files below a folder, in order, but for those with a hidden name. One folder's names are held at a time, and those of the folders above it."""
    for name, is_folder in _entries(store, path):
        if is_folder:
            yield from walked(store, f"{path}/{name}")
        elif not hidden(name):
            yield f"{path}/{name}"


def _many(path: str) -> bool:
    """Whether a mounted folder holds more than LARGE files; counting ends there."""
    seen = 0
    for _, _, names in os.walk(path):
        seen += len(names)
        if seen > LARGE:
            return True
    return False


def read_file(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


@dataclass
class Folders(InputPartition):
    """Folders (project, run_id, kind, or None for all kinds) and, of their files, those of one part of `parts`."""

    folders: list[tuple[str, str, str | None]]
    part: int = 0
    parts: int = 1


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        #: Of project, run_id and kind: the values that may be.
        self.chosen: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", ()) else None
            values = {f.value} if isinstance(f, (EqualTo, EqualNullSafe)) else set(f.value) if isinstance(f, In) else None
            if name in _FOLDERS and values is not None:
                self.chosen[name] = self.chosen.get(name, values) & values
            else:
                yield f

    def _below(self, store: fs.FileSystem, path: str, level: str) -> Iterator[tuple[str, str]]:
        chosen = self.chosen.get(level)
        for x in _listed(store, path, fs.FileType.Directory):
            if chosen is None or x.base_name in chosen:
                yield x.base_name, x.path

    def partitions(self) -> list[Folders]:
        store, root = opened(self.path)
        runs = [(project, run_id) for project, path in self._below(store, root, "project") for run_id, _ in self._below(store, path, "run_id")]
        if len(runs) <= FEW:
            found = [(project, run_id, kind) for project, run_id in runs for kind, _ in self._below(store, posixpath.join(root, project, run_id), "kind")]
        else:
            found = [(project, run_id, None) for project, run_id in runs]
        if len(found) > TASKS:
            return [Folders(found[k * len(found) // TASKS : (k + 1) * len(found) // TASKS]) for k in range(TASKS)]
        out = []
        for x in found:
            many = len(found) < PARTS and isinstance(store, fs.LocalFileSystem) and _many(posixpath.join(root, *x))
            out += [Folders([x], k, PARTS) for k in range(PARTS)] if many else [Folders([x])]
        return out

    def read(self, partition: Folders | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one task for a scan without partitions
            return
        store, root = opened(self.path)
        rows, size = [], 0
        for row in self._rows(store, root, partition):
            rows.append(row)
            size += len(row[-1] or b"")
            if size > BATCH or len(rows) >= ROWS:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, store: fs.FileSystem, root: str, partition: Folders) -> Iterator[tuple]:
        local = isinstance(store, fs.LocalFileSystem)
        for project, run_id, only in partition.folders:
            run = posixpath.join(root, project, run_id)
            for kind in [only] if only is not None else [kind for kind, _ in self._below(store, run, "kind")]:
                folder = posixpath.join(run, kind)
                for path in walked(store, folder):
                    rel = path[len(folder) + 1 :]
                    if partition.parts > 1 and zlib.crc32(rel.encode("utf-8", "surrogateescape")) % partition.parts != partition.part:
                        continue
                    state = os.stat(path) if local else None
                    size, packed = state.st_size if local else store.get_file_info(path).size, rel.endswith(PACKED)
                    content = read_file(store, path) if self.content or packed else None
                    if packed:
                        rel, content = rel.removesuffix(PACKED), gzip.decompress(content)
                        size, content = len(content), content if self.content else None
                    mode = None if state is None else state.st_mode & 0o7777
                    yield project, run_id, kind, rel, posixpath.basename(rel), size, mode, None if mode is None else bool(mode & 0o111), content


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _clean(name: str | None) -> str:
    clean = posixpath.normpath(name or "")
    if clean in ("", ".") or clean.startswith(("/", "..")) or clean.split("/")[0].startswith(_STAGED):
        raise ValueError(f"{name!r} is no name of a file below the folder")
    return clean


def _bytes(content: str | bytes | None) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content or b"")


def _staged_files(rows: Iterable[tuple], store: fs.FileSystem, folder: str) -> Iterator[tuple[str, str]]:
    """Each row (name, content) put into a file of a folder: where it is and the name it is to have."""
    store.create_dir(folder, recursive=True)
    for k, (name, content) in enumerate(rows):
        clean = _clean(name)
        place = posixpath.join(folder, f"{k:09d}")
        with store.open_output_stream(place, compression=None) as f:
            f.write(_bytes(content))
        yield place, clean


@dataclass
class Written(WriterCommitMessage):
    #: Where the task has put each file, and its name.
    files: list[tuple[str, str]]


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.at = [schema.names.index("name"), schema.names.index("content")]
        self.staged = f"{_STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.path)
        folder = posixpath.join(root, self.staged, uuid.uuid4().hex)  # of this attempt
        return Written(list(_staged_files(((row[self.at[0]], row[self.at[1]]) for row in iterator), store, folder)))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"{len(names) - len(set(names))} names come more than once")
        kept = set(names)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if x.type == fs.FileType.File and posixpath.relpath(x.path, root) not in kept and not posixpath.relpath(x.path, root).startswith(_STAGED):
                    store.delete_file(x.path)
        for folder in sorted({posixpath.dirname(posixpath.join(root, name)) for name in names}):
            store.create_dir(folder, recursive=True)
        for place, name in files:
            store.move(place, posixpath.join(root, name))
        self.abort(messages)
        log.info("wrote %d files to %s", len(files), self.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        staged = posixpath.join(root, self.staged)
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class ArtifactFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArtifactFiles)


def artifact_files(spark: SparkSession, workspace: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("artifact_files").option("content", str(content).lower()).load(workspace)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches one by one."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _pairs(rows: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str]] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["place", "name"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["place", "name"])


def write_files(rows: DataFrame, folder: str, mode: str = "append", packed: bool = False, times: int = 1) -> None:
    """One file for each row (name, content) of rows; with mode overwrite, other files of the folder go. packed: files are compressed, which artifact_files doesn't show.
    times: so many writes one after another, of rows that are made once."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode {mode} isn't append or overwrite")
    end = PACKED if packed else ""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([_clean(x) + end for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, batch.column(1)], ["name", "content"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        local = isinstance(store, fs.LocalFileSystem)
        task, made = uuid.uuid4().hex, set()
        for batch in batches:
            for k, (name, content) in enumerate(_slices([batch])):
                target = posixpath.join(root, name)
                if (above := posixpath.dirname(target)) not in made:
                    store.create_dir(above, recursive=True)
                    if len(made) >= ROWS:
                        made.clear()
                    made.add(above)
                part = f"{above}/.{task}-{k}"  # a move within a folder needs no lock of the whole disk
                try:
                    with open(part, "wb") if local else store.open_output_stream(part, compression=None) as f:
                        f.write(gzip.compress(_bytes(content), 1, mtime=0) if packed else _bytes(content))
                    if local:
                        os.replace(part, target)
                    else:
                        store.move(part, target)
                except BaseException:
                    if store.get_file_info(part).type == fs.FileType.File:
                        store.delete_file(part)
                    raise
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    kind = rows.schema["content"].dataType.simpleString()
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "files")
    try:
        rows.select("name", "content").mapInArrow(checked, f"name string, content {kind}").write.parquet(path)
        put = spark.read.schema(f"name string, content {kind}").parquet(path)
        more = put.groupBy("name").count().where("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
        if more:
            raise ValueError(f"{more} names come more than once")
        if mode == "overwrite":
            _others_deleted(spark, folder, put)
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = put.repartition(tasks) if stored_bytes(spark, path) < tasks * BATCH else put  # many short files lie in few partitions; long ones needn't move again
        for _ in range(times):
            count = dealt.mapInArrow(written, "n bigint").agg(F.sum("n")).first()[0]
            log.info("wrote %d files to %s", count or 0, folder)
    finally:
        dropped(spark, path)


def _others_deleted(spark: SparkSession, folder: str, kept: DataFrame) -> None:
    """Files below a folder whose names aren't among the kept ones go; each entry of the folder is walked by one task."""
    store, root = opened(folder)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for (top,) in _slices(batches):
            path = posixpath.join(root, top)
            files = _files(store, path) if store.get_file_info(path).type == fs.FileType.Directory else [path]
            yield from _pairs((x, posixpath.relpath(x, root)) for x in files)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for (place,) in _slices([batch]):
                store.delete_file(place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    tops = [(x.base_name,) for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not x.base_name.startswith(_STAGED)]
    others = spark.createDataFrame(tops, "top string").mapInArrow(found, "place string, name string").join(kept.select("name"), "name", "left_anti")
    others.select("place").mapInArrow(deleted, "n bigint").agg(F.sum("n")).first()


def _files(store: fs.FileSystem, path: str) -> Iterator[str]:
    for name, is_folder in _entries(store, path):
        yield from _files(store, f"{path}/{name}") if is_folder else [f"{path}/{name}"]


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path is one of a mounted folder, without a pattern, so that tasks can list it themselves."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
    return not set(path) & set("*?[{") and (path.startswith("file:") or path.startswith("/") and default.startswith("file:"))


def _left_out(name: str) -> bool:
    """Names that Spark's sources pass over."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files below a mounted folder, but for those that Spark's sources pass over. A folder's names are listed by one task, level by level."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, int | None]]:
            for (path,) in _slices(batches):
                with os.scandir(plain_path(path)) as names:
                    for x in names:
                        if not _left_out(x.name):
                            yield f"{path}/{x.name}", None if x.is_dir() else x.stat().st_size

        held = found()
        while rows := list(islice(held, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()))], ["path", "length"])

    top = plain_path(root).rstrip("/")
    if not os.path.isdir(top):
        raise FileNotFoundError(f"{root} is no folder")
    folders, out, tasks = spark.createDataFrame([(f"file:{top}",)], "path string"), None, spark.sparkContext.defaultParallelism
    while not folders.isEmpty():
        level = stored(folders.repartition(tasks).mapInArrow(entries, "path string, length bigint"), "listed")
        files = level.where("length is not null")
        out = files if out is None else out.unionByName(files)
        folders = level.where("length is null").select("path")
    return out


def with_content(rows: DataFrame) -> DataFrame:
    """rows (with the path of files of a mounted folder) with `content`. Rows leave by BATCH bytes."""
    schema = StructType([*rows.schema.fields, StructField("content", BinaryType())])
    at, names = rows.columns.index("path"), schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, held = 0, 0, []
            for k, path in enumerate(batch.column(at).to_pylist()):
                with open(plain_path(path), "rb", 0) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size > BATCH or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], names)
                    first, size, held = k + 1, 0, []

    return rows.mapInArrow(read, schema)


def log_parts(lines: DataFrame, order: str, size: int = LOG_LINES) -> DataFrame:
    """lines (name, line and a column for their order) as rows (name, content) for write_files: parts of so many lines, named <name>.part-<number>. No task holds more than a part."""
    numbered = scanned(lines.select("name", F.col(order).alias("_o"), "line"), ["name"], ["_o"], place="_n")
    part = F.expr(f"(_n - 1) div {size}")
    parts = numbered.groupBy("name", part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_n", "line"))).alias("x"))
    number = F.col("_part").cast("string")
    return parts.select(F.concat("name", F.lit(".part-"), F.lpad(number, 9, "0")).alias("name"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("content"))
