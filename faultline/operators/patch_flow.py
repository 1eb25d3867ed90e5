"""Patches in sequence: each applies to what the ones before it left; a failed build takes its patch back.

A step is put out as the edits that it makes, so a row is as long as its patch, not as its file. Where an edit falls in the first source comes from
the numbers of its lines: each is a place in the first source, or of one step. Contents are rebuilt from the edits on demand.
A step finds its place by an index of how lines begin (LongFile), so a long file isn't read again for each patch.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import GAP, REACH, Edit, Failed, Lines, beginnings, joined, patch_edits, plain, scores

#: at, gone: place and number of the lines that an edit replaces, in what the edits before it left. source_first, source_last: the lines of the first source that go
#: (half open; an empty span where none do, at the place that follows).
EDIT = "struct<at:int,gone:int,lines:array<string>,source_first:int,source_last:int>"
_EDITS = pa.list_(pa.struct([("at", pa.int32()), ("gone", pa.int32()), ("lines", pa.list_(pa.string())), ("source_first", pa.int32()), ("source_last", pa.int32())]))
#: Characters of the contents in one batch, about, and rows of a fold.
BATCH, ROWS = 4 << 20, 4096


class Pieces:
    """A file as runs of lines: (origin, first, last) with origin None for the first source, else any mark of what brought the lines. Folds number lines instead (Traced)."""

    def __init__(self, n: int) -> None:
        self.runs: list[tuple[object, int, int]] = [(None, 0, n)] if n else []
        self.n = n

    def copy(self) -> Pieces:
        out = Pieces(0)
        out.runs, out.n = list(self.runs), self.n
        return out

    def _cut(self, at: int) -> int:
        """The index of the run that begins at a place; a run that holds it is cut there."""
        seen = 0
        for k, (origin, first, last) in enumerate(self.runs):
            if seen == at:
                return k
            if at < seen + last - first:
                self.runs[k : k + 1] = [(origin, first, first + at - seen), (origin, first + at - seen, last)]
                return k + 1
            seen += last - first
        return len(self.runs)

    def replace(self, edit: Edit, origin: object) -> tuple[int, int]:
        """The span of the first source that goes."""
        a = self._cut(edit.start)
        b = self._cut(edit.end)
        own = [(first, last) for o, first, last in self.runs[a:b] if o is None]
        after = next((first for o, first, _ in self.runs[b:] if o is None), self.n)
        self.runs[a:b] = [(origin, 0, len(edit.lines))] if edit.lines else []
        return (own[0][0], own[-1][1]) if own else (after, after)


class Part:
    """A run of items of Blocks, and its number among the parts."""

    __slots__ = ("items", "number")

    def __init__(self, items: list, number: int) -> None:
        self.items, self.number = items, number


class Blocks:
    """A long list in parts of about the square root of its length, so that an edit moves few of its items."""

    LEAST = 512

    def __init__(self, items: list | array) -> None:
        self.size = max(self.LEAST, math.isqrt(len(items)))
        self.parts = [Part(items[k : k + self.size], n) for n, k in enumerate(range(0, max(1, len(items)), self.size))]
        self._count()

    def _count(self) -> None:
        *self.starts, self.n = accumulate((len(p.items) for p in self.parts), initial=0)

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator:
        return chain.from_iterable(p.items for p in self.parts)

    def place(self, k: int) -> tuple[Part, int]:
        part = self.parts[bisect_right(self.starts, k) - 1]
        return part, k - self.starts[part.number]

    def __getitem__(self, k: int) -> object:
        part, at = self.place(k if k >= 0 else self.n + k)
        return part.items[at]

    def after(self, k: int) -> Iterator:
        """The items from k on."""
        part, at = self.place(k)
        return chain(islice(part.items, at, None), *([chain.from_iterable(p.items for p in islice(self.parts, part.number + 1, None))]))

    def replace(self, start: int, end: int, items: list) -> tuple[list, list[Part]]:
        """The items that go, and the parts that have got others."""
        part, at = self.place(start)
        gone = part.items[at : at + end - start]
        changed = [part]
        part.items[at : at + end - start] = items
        for p in islice(self.parts, part.number + 1, None):
            if len(gone) == end - start:
                break
            left = end - start - len(gone)
            gone += p.items[:left]
            del p.items[:left]
        if len(part.items) > 2 * self.size:
            pieces = [part.items[k : k + self.size] for k in range(0, len(part.items), self.size)]
            part.items = pieces[0]
            changed += [Part(x, 0) for x in pieces[1:]]
            self.parts[part.number + 1 : part.number + 1] = changed[1:]
            for n, p in enumerate(self.parts):
                p.number = n
        self._count()
        return gone, changed


class Kept:
    """The lines of a text that comes in blocks, in Arrow arrays: a line costs its bytes and 8, where a str costs 50 more."""

    LINES = 8192

    def __init__(self) -> None:
        self.chunks: list[pa.Array] = []
        self.starts: list[int] = []
        self.n, self.blocks, self.held, self.open = 0, 0, [], None
        self.digest = hashlib.sha256()

    def add(self, block: str) -> None:
        """The next block; between two blocks stands an end of line."""
        if self.open is not None:
            self._take((self.open + "\n").splitlines())
        self.digest.update((("\n" if self.blocks else "") + block).encode())
        self.open, self.blocks = block, self.blocks + 1

    def _take(self, lines: list[str], last: bool = False) -> None:
        self.held += lines
        if self.held and (last or len(self.held) >= self.LINES):
            self.starts.append(self.n)
            self.chunks.append(pa.array(self.held, pa.large_string()))
            self.n, self.held = self.n + len(self.held), []

    def end(self) -> bool:
        """After the last block: whether the text ends with an end of line."""
        ended = self.open.endswith("\n") or not self.open and self.blocks > 1
        self._take(self.open.splitlines(), True)
        return ended

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> str:
        at = bisect_right(self.starts, k) - 1
        return self.chunks[at][k - self.starts[at]].as_py()

    def __iter__(self) -> Iterator[str]:
        return chain.from_iterable(c.to_pylist() for c in self.chunks)


class Traced(Lines):
    """Lines that know which of them are of the first source: each has a number, its place there, or a negative one if a step has brought it."""

    def __init__(self, lines: list[str]) -> None:
        super().__init__(lines)
        self.first, self.ids = len(lines), list(range(len(lines)))
        self.spans: list[tuple[int, int]] = []

    def _span(self, gone: list[int], rest: Iterator[int]) -> tuple[int, int]:
        """The span of the first source that goes."""
        own = [k for k in gone if k >= 0]
        after = own[0] if own else next((k for k in rest if k >= 0), self.first)
        return (own[0], own[-1] + 1) if own else (after, after)

    def replace(self, edit: Edit) -> tuple:
        gone = self.ids[edit.start : edit.end]
        self.spans.append(self._span(gone, islice(self.ids, edit.end, None)))
        self.ids[edit.start : edit.end] = [-1] * len(edit.lines)
        return super().replace(edit), gone

    def back(self, old: tuple) -> None:
        edit, gone = old
        self.ids[edit.start : edit.end] = gone
        super().replace(edit)


class LongFile(Traced):
    """Traced lines of a long file that takes many patches. Lines are found by what they begin with: those of the first source by sorted hashes, those of steps in a dictionary. So a
    patch costs what its candidates cost, not what the file does."""

    #: From so many lines on, for files with so many patches.
    LINES, PATCHES = 2000, 4
    #: Hashes with more lines than this keep them by text.
    MANY = 32

    def __init__(self, lines: list[str] | Kept) -> None:
        self.first, self.spans = len(lines), []
        self.given = lines
        self.spaced: dict[int, str] = {}  # plain forms of lines that aren't plain
        hashes = np.fromiter(self._hashes(), np.int64, len(lines))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.blocks = Blocks(array("q", range(len(lines))))
        #: The part that a line is in, None for one that went.
        self.home: list[Part | None] = [p for p in self.blocks.parts for _ in p.items]
        self.brought: dict[int, tuple[str, str]] = {}  # lines of steps and their plain forms
        self.brought_home: dict[int, Part] = {}
        self.begun: dict[str, dict[str, dict[int, None]]] = {}
        self.texts: dict[str, dict[str, list[int]]] = {}
        self.last = 0

    def _hashes(self) -> Iterator[int]:
        for k, x in enumerate(self.given):
            bare = " ".join(x.split())
            if bare != x:
                self.spaced[k] = bare
            yield hash(bare[:-REACH])

    def _bare(self, k: int) -> str:
        return self.spaced[k] if k in self.spaced else self.given[k]

    def __len__(self) -> int:
        return len(self.blocks)

    def __getitem__(self, k: int) -> str:
        n = self.blocks[k]
        return self.given[n] if n >= 0 else self.brought[n][0]

    def __iter__(self) -> Iterator[str]:
        return (self.given[n] if n >= 0 else self.brought[n][0] for n in self.blocks)

    def _put(self, start: int, end: int, ids: list[int] | array) -> array:
        gone, parts = self.blocks.replace(start, end, array("q", ids))
        for k in gone:
            if k >= 0:
                self.home[k] = None
            else:
                del self.brought_home[k]
                bare = self.brought[k][1]
                del self.begun[bare[:-REACH]][bare][k]
        for k in ids:
            if k < 0:
                bare = self.brought[k][1]
                self.begun.setdefault(bare[:-REACH], {}).setdefault(bare, {})[k] = None
        for part in parts:
            for k in ids if len(parts) == 1 else part.items:
                if k >= 0:
                    self.home[k] = part
                else:
                    self.brought_home[k] = part
        return gone

    def replace(self, edit: Edit) -> tuple:
        ids = list(range(self.last - 1, self.last - 1 - len(edit.lines), -1))
        self.last -= len(ids)
        self.brought.update(zip(ids, zip(edit.lines, plain(edit.lines))))
        gone = self._put(edit.start, edit.end, ids)
        self.spans.append(self._span(gone, self.blocks.after(edit.start + len(ids))))
        return edit.start, edit.start + len(ids), gone

    def back(self, old: tuple) -> None:
        for k in self._put(*old):
            del self.brought[k]

    def _candidates(self, head: str) -> Iterator[tuple[str, list[int]]]:
        """Plain lines of the first source that begin so, with their numbers; some that don't may be among them, and some that have gone."""
        low, high = (int(np.searchsorted(self.hashes, hash(head), side)) for side in ("left", "right"))
        if high - low <= self.MANY:
            yield from ((self._bare(k), [k]) for k in self.order[low:high].tolist())
            return
        if head not in self.texts:
            texts = self.texts[head] = {}
            for k in self.order[low:high].tolist():
                texts.setdefault(self._bare(k), []).append(k)
        yield from self.texts[head].items()

    def told(self, patch: list[str]) -> dict[int, tuple[float, ...]]:
        whole = [*patch, GAP]
        begun = beginnings(whole)
        hits: dict[int, tuple[float, ...]] = {}
        for head in begun:
            for text, ids in chain(self._candidates(head), self.begun.get(head, {}).items()):
                if ids and (row := scores(text, whole, begun)):
                    hits.update(dict.fromkeys((k for k in ids if k < 0 or self.home[k] is not None), row))
        if len(hits) * self.blocks.size > 8 * len(self):
            return {at: hits[k] for at, k in enumerate(self.blocks) if k in hits}
        found = {}
        for k, row in hits.items():
            part = self.home[k] if k >= 0 else self.brought_home[k]
            found[self.blocks.starts[part.number] + part.items.index(k)] = row
        return dict(sorted(found.items()))


def settled(lines: Traced | Blocks, ended: bool) -> tuple[Edit | None, bool]:
    """Between two patches a file is a text: what reading it again changes in its lines, and whether the text ends with an end of line."""
    if not len(lines):
        return (Edit(0, 0, [""]) if ended else None), ended
    if lines[-1] == "" and len(lines) > 1:
        return Edit(len(lines) - 1, len(lines), []), True
    return (Edit(0, 1, []), False) if len(lines) == 1 and lines[0] == "" and not ended else (None, ended)


def steps_of(source: str, steps: list[tuple[str, bool]]) -> Iterator[tuple[bool, bool, str | None, list[tuple], Traced, bool]]:
    """Of each step (patch, whether it built): applied, retained, error, edits; the file after it, and whether that ends with an end of line."""
    return Fold(source.splitlines(), source.endswith("\n"), len(steps)).steps(steps)


class Fold:
    """A file that takes patches in turn."""

    def __init__(self, lines: list[str] | Kept, ended: bool, patches: int) -> None:
        long = len(lines) >= LongFile.LINES and patches >= LongFile.PATCHES
        self.file = LongFile(lines) if long else Traced(list(lines))
        self.ended = ended
        #: What the last retained step left, if any: whether it ended with an end of line, and what takes back that it was read again.
        self.left: tuple[bool, tuple | None] | None = None

    def steps(self, steps: list[tuple[str, bool]]) -> Iterator[tuple[bool, bool, str | None, list[tuple], Traced, bool]]:
        file, settles = self.file, None
        for patch, built in steps:
            if settles:
                self.left = self.left[0], file.replace(settles)
                settles = None
            file.spans = []
            done = patch_edits(file, patch)
            if isinstance(done, Failed):
                yield False, False, done.error, [], file, self.ended
                continue
            edits, undone = done
            made = [(e.start, e.end - e.start, e.lines, *span) for e, span in zip(edits, file.spans)]
            if not built:
                for old in reversed(undone):
                    file.back(old)
            yield True, built, None, made, file, self.ended
            if built:
                self.left = self.ended, None
                settles, self.ended = settled(file, self.ended)

    def last(self) -> str | None:
        """The SHA-256 of the file after the last step, or None where no step was retained. No step may follow."""
        if self.left is None:
            return None
        ended, read_again = self.left
        if read_again:
            self.file.back(read_again)
        out, lines, last, n = hashlib.sha256(), iter(self.file), None, 0
        while some := list(islice(lines, Kept.LINES)):
            out.update(("\n" * (n > 0) + "\n".join(some)).encode())
            last, n = some[-1], n + len(some)
        if ended and not (n > 1 and last == ""):
            out.update(b"\n")
        return out.hexdigest()


def folded(source: str, steps: list[tuple[str, bool]]) -> list[tuple[bool, bool, str | None, list[tuple]]]:
    """Of each step (patch, whether it built): applied, retained, error, edits."""
    return [x[:4] for x in steps_of(source, steps)]


def _lists(patches: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each file: run_id, file_path, source, its patches in order. Patches and sources meet in one shuffle, and files are dealt to all partitions, as a few of them, small by bytes, may be the work of
    a whole run."""
    step = F.struct("seq", "patch", F.coalesce("build_success", F.lit(False)).alias("build_success"))
    keys = ["run_id", "file_path"]
    given = sources.select(*[F.col(k).cast(patches.schema[k].dataType) for k in keys], F.struct("source").alias("_s"), F.lit(None).cast(patches.select(step).schema[0].dataType).alias("_p"))
    rows = patches.select(*keys, F.lit(None).cast(given.schema["_s"].dataType).alias("_s"), step.alias("_p")).unionByName(given)
    dealt = rows.dropna(subset=keys).repartition(int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    lists = dealt.groupBy(*keys).agg(F.collect_list("_s").alias("_s"), F.sort_array(F.collect_list("_p")).alias("p")).where("size(p) > 0")
    return lists.select(*keys, F.explode("_s").alias("_s"), "p").select(*keys, "_s.source", "p")


def _files(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, list[tuple[str, bool]]]]:
    """Of each row of a batch of _lists: its place, source, where its patches begin among those of the batch, and these."""
    lists = batch.column(3)
    offsets, flat = lists.offsets.to_pylist(), lists.values
    first, texts = offsets[0] if offsets else 0, flat.field("patch").to_pylist()
    built = flat.field("build_success").to_pylist()
    for k in range(batch.num_rows):
        a, b = offsets[k], offsets[k + 1]
        yield k, batch.column(2)[k].as_py() or "", a, [(texts[n] or "", built[n]) for n in range(a, b)]


def _folding(patches: DataFrame, sources: DataFrame, whole: bool) -> DataFrame:
    """Files folded: of each step its edits, or with `whole` the file after it. Rows leave by BATCH characters or ROWS steps, also within one file."""
    lists = _lists(patches, sources)
    kinds = {f.name: f.dataType.simpleString() for f in [*lists.schema, patches.schema["seq"]]}
    last, kind = ("content", pa.string()) if whole else ("edits", _EDITS)
    names = ["run_id", "file_path", "seq", "patch_applied", "retained", "error", last]

    def rows_of(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        rows, places, applied, retained, errors, values = zip(*held)
        at = pa.array(rows)
        keys = [batch.column(0).take(at), batch.column(1).take(at), batch.column(3).values.field("seq").take(pa.array(places))]
        return pa.RecordBatch.from_arrays([*keys, pa.array(applied), pa.array(retained), pa.array(errors, pa.string()), pa.array(values, kind)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for row, source, first, steps in _files(batch):
                text = source
                for n, (applied, retained, error, edits, file, ended) in enumerate(steps_of(source, steps), first):
                    text = joined(file, ended) if whole and retained else text
                    held.append((row, n, applied, retained, error, text if whole else edits))
                    size += len(text) if whole else sum(len(x) for e in edits for x in e[2])
                    if size > BATCH or len(held) >= ROWS:
                        yield rows_of(batch, held)
                        held, size = [], 0
            if held:
                yield rows_of(batch, held)

    return lists.mapInArrow(run, f"run_id {kinds['run_id']}, file_path {kinds['file_path']}, seq {kinds['seq']}, patch_applied boolean, retained boolean, error string, {last} {'string' if whole else f'array<{EDIT}>'}")


def fold_edits(patches: DataFrame, sources: DataFrame) -> DataFrame:
    """patches (run_id, file_path, seq, patch, build_success) folded over sources (run_id, file_path, source): whether each applied, whether it was kept, why
    not, and its edits. A fold is sequential; runs and files are independent. A source moves once, to the list of its patches, which a run's limit bounds."""
    return _folding(patches, sources, False)


def patch_fold(patches: DataFrame, sources: DataFrame) -> DataFrame:
    """fold_edits with the file after each step instead of the edits."""
    return _folding(patches, sources, True)


def fold_blocks(patches: DataFrame, blocks: DataFrame) -> DataFrame:
    """fold_edits for files that are too long to be one value: blocks (run_id, file_path, block, text) in order, with an end of line between two, are the text of a file. `last`, on the row of a
    file's last step, is the SHA-256 of the file after it. A file's blocks and patches stream to one task in order, which holds its lines as Arrow arrays and an index of them, and nothing twice."""
    keys, kinds = ["run_id", "file_path"], {f.name: f.dataType.simpleString() for f in patches.schema}
    given = blocks.select(*[F.col(k).cast(kinds[k]) for k in keys], F.lit(0).alias("_kind"), F.col("block").cast("bigint").alias("_at"), F.lit(None).cast(kinds["seq"]).alias("seq"), F.col("text").alias("_text"), F.lit(False).alias("_built"))
    steps = patches.select(*keys, F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_at"), "seq", F.col("patch").alias("_text"), F.coalesce("build_success", F.lit(False)).alias("_built"))
    rows = given.unionByName(steps).dropna(subset=keys).repartition(int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "_kind", "_at", "seq", "_text", "_built")
    names = [*keys, "seq", "patch_applied", "retained", "error", "edits", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, source, steps, types = None, Kept(), [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not source.blocks or not steps:
                return
            fold = Fold(source, source.end(), len(steps))
            held, size = [], 0
            for n, (applied, retained, error, edits, _, _) in enumerate(fold.steps([x[1:] for x in steps])):
                held.append((steps[n][0], applied, retained, error, edits))
                size += sum(len(x) for e in edits for x in e[2])
                if (size > BATCH or len(held) >= ROWS) and n < len(steps) - 1:
                    yield out(held, None)
                    held, size = [], 0
            yield out(held, fold.last() or source.digest.hexdigest())

        def out(held: list[tuple], last: str | None) -> pa.RecordBatch:
            seqs, applied, retained, errors, edits = zip(*held)
            n = len(held)
            columns = [pa.array([x] * n, t) for x, t in zip(key, types)] + [pa.array(seqs, types[2]), pa.array(applied), pa.array(retained), pa.array(errors, pa.string()), pa.array(edits, _EDITS), pa.array([None] * (n - 1) + [last], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            types = [batch.column(0).type, batch.column(1).type, batch.column(4).type]
            for run_id, path, kind, _, seq, text, built in _slices(batch):
                if (run_id, path) != key:
                    yield from done()
                    key, source, steps = (run_id, path), Kept(), []
                if kind:
                    steps.append((seq, text or "", built))
                else:
                    source.add(text or "")
        yield from done()

    return rows.mapInArrow(run, f"run_id {kinds['run_id']}, file_path {kinds['file_path']}, seq {kinds['seq']}, patch_applied boolean, retained boolean, error string, edits array<{EDIT}>, last string")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, some at a time as Python values."""
    for k in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, 256).columns))


def contents(steps: DataFrame, sources: DataFrame, last: bool = False) -> DataFrame:
    """steps (of fold_edits) with `content`, the file after each; with last, only the last step of each file. Rows leave one by one: a task holds one file."""
    lists = steps.groupBy("run_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("seq", "patch_applied", "retained", "error", "edits"))).alias("p"))
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    names = ["run_id", "file_path", "seq", "patch_applied", "retained", "error", "content"]
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for run_id, path, steps, source in zip(*(c.to_pylist() for c in batch.columns)):
                text: str | None = source or ""
                lines, ended, settles = Blocks(text.splitlines()), text.endswith("\n"), None
                for k, step in enumerate(steps):
                    if step["retained"]:
                        if settles:
                            lines.replace(*settles)
                        for e in step["edits"]:
                            lines.replace(e["at"], e["at"] + e["gone"], e["lines"])
                        text, whole = None, ended
                        settles, ended = settled(lines, ended)
                    if last and k < len(steps) - 1:
                        continue
                    text = joined(lines, whole) if text is None else text
                    held.append((run_id, path, step["seq"], step["patch_applied"], step["retained"], step["error"], text))
                    size += len(text)
                    if size > BATCH:
                        yield _rows(held, names, batch)
                        held, size = [], 0
            if held:
                yield _rows(held, names, batch)

    def _rows(held: list[tuple], names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = {"run_id": batch.column(0).type, "file_path": batch.column(1).type, "seq": batch.column(2).type.value_type.field("seq").type}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n) or (pa.bool_() if n in ("patch_applied", "retained") else pa.string())) for n, v in zip(names, zip(*held))], names)

    whole = lists.join(sources.select("run_id", "file_path", "source"), ["run_id", "file_path"])
    return whole.select("run_id", "file_path", "p", "source").mapInArrow(run, schema)


def crash_counts(tests: DataFrame, keys: list[str]) -> DataFrame:
    """crashes_fixed and crashes_remaining of each patch."""
    return tests.groupBy(*keys).agg(F.count_if(~F.col("still_crashes")).alias("crashes_fixed"), F.count_if(F.col("still_crashes")).alias("crashes_remaining"))


def by_harness(crashes: DataFrame) -> DataFrame:
    return crashes.groupBy(F.coalesce(F.nullif(F.col("harness"), F.lit("")), F.lit("unknown")).alias("harness")).agg(F.count("*").alias("n"))


def final_state(patch_tests: DataFrame, crashes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each run: the counts of the last patch that built and was tested, else none fixed and all remaining."""
    good = F.col("build_success") & (F.size(F.coalesce("crash_tests", F.array().cast("array<struct<crash_id:string>>"))) > 0) if "crash_tests" in patch_tests.columns else F.col("build_success")
    pick = F.max_by(F.when(good, F.struct("crashes_fixed", "crashes_remaining")), F.when(good, F.col("patch_idx")))
    last = patch_tests.groupBy(*keys).agg(pick.alias("_s"))
    total = crashes.groupBy(*keys).agg(F.count("*").cast("int").alias("_n"))
    out = last.join(total, keys, "full")
    return out.select(*keys, F.coalesce("_s.crashes_fixed", F.lit(0)).alias("crashes_fixed"), F.coalesce("_s.crashes_remaining", "_n", F.lit(0)).alias("crashes_remaining"))


def roll_up(patch_tests: DataFrame, keys: list[str]) -> DataFrame:
    """generated, applied (a patch taken back still counts), retained and tested of each run."""
    tested = F.col("build_success") & (F.col("crashes_fixed") + F.col("crashes_remaining") > 0)
    return patch_tests.groupBy(*keys).agg(
        F.count("*").alias("generated"), F.count_if(F.col("patch_applied")).alias("applied"), F.count_if(F.col("patch_applied") & F.col("build_success")).alias("retained"), F.count_if(tested).alias("tested")
    )
