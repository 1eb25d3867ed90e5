"""Whitening of vectors by singular value decompositions that are merged up a tree.

Vectors become integers, x = floor(256 c). The fit list is each distinct x once. A partition keeps (n, exact sums, singular values, right vectors) of its
centred rows; the next batch B is appended to what is kept as [diag(s) Vt; B - mean(B); sqrt(n m / (n + m)) (mean(B) - mean)], whose own decomposition is
that of all rows together, as the last row corrects for the two means. Partitions are merged the same way, FAN at a time, up to one summary; all
dimensions are kept at each step, so nothing is lost but rounding. A covariance is never formed: singular values have twice the digits of its eigenvalues.

Moved: each distinct vector once (as integers of 1 to 8 bytes), then a summary of dims^2 numbers for each partition. The driver gets the last one.

Edge cases: rows with a null vector, a null or non-finite entry, or an entry with |x| of 2^61 or more are dropped, and so are empty vectors and those of
another length than the most frequent one (the longer of two). Equal vectors are fitted once and returned each. A component without variance (equal vectors,
fewer vectors than components) has whitened 0 and no part in identity_error. deviation is null where it doesn't fit 64 bits. Empty tables give none.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroid_clusters import components
from .shared import stored

SCALE, COMPONENTS = 256, 4
#: Rows with an entry beyond count as not finite; differences of others fit 64 bits.
LARGEST = 2.0**61
#: Vectors that are appended at once, and summaries that one task merges.
BLOCK, FAN = 2048, 16
#: A singular value below this part of the largest counts as none.
RANK = 1e-12
_SUMMARY = "part bigint, n bigint, sums array<decimal(38,0)>, s array<double>, vt array<double>"


@dataclass
class Summary:
    """What is kept of some rows: their number, their exact sums, and the singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    s: np.ndarray
    vt: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([x / self.n for x in self.sums])


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def leaf(x: np.ndarray) -> Summary:
    """Of integer rows. They are centred at exact sums: with a whole number near the mean taken off first, what is left is small."""
    sums = [int(v) for v in x.sum(axis=0)] if np.abs(x.astype(np.float64)).max() * len(x) < 2**62 else [sum(map(int, c)) for c in x.T]
    near = np.array([v // len(x) for v in sums], np.int64)
    rest = np.array([(v - int(a) * len(x)) / len(x) for v, a in zip(sums, near)])
    return Summary(len(x), sums, *_decomposed((x - near).astype(np.float64) - rest))


def merged(parts: list[Summary]) -> Summary:
    """Of all rows of the parts."""
    out = parts[0]
    for p in parts[1:]:
        n = out.n + p.n
        step = np.sqrt(out.n * p.n / n) * (p.mean - out.mean)
        s, vt = _decomposed(np.vstack([out.s[:, None] * out.vt, p.s[:, None] * p.vt, step[None, :]]))
        out = Summary(n, [a + b for a, b in zip(out.sums, p.sums)], s, vt)
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as integers of 1, 2, 4 or 8 bytes, the fewest that hold it. Rows have one number of components, so lengths tell the widths."""
    most = np.maximum(x.max(axis=1), -1 - x.min(axis=1)) if len(x) else np.zeros(0)
    out: list[bytes] = [b""] * len(x)
    low = -1
    for width in (1, 2, 4, 8):
        top = (1 << (8 * width - 1)) - 1
        at = np.nonzero((most > low) & (most <= top))[0]
        blob, size = np.ascontiguousarray(x[at].astype(f"<i{width}")).tobytes(), width * x.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = blob[k * size : (k + 1) * size]
        low = top
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    lengths = np.array([len(r) for r in rows])
    for width in (1, 2, 4, 8):
        at = np.nonzero(lengths == width * dims)[0]
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at.tolist()), f"<i{width}").reshape(len(at), dims)
    return out


def _integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    at, c = components(column, dims)
    with np.errstate(over="ignore"):
        x = np.floor(scale * c)
    fits = (np.abs(x) < LARGEST).all(axis=1)
    return at[fits], x[fits].astype(np.int64)


def _plain(vectors: DataFrame, dims: int, *more: str) -> DataFrame:
    rows = vectors.where(F.size("embedding") == dims).select(*more, "embedding")
    floating = rows.schema["embedding"].dataType.elementType.simpleString() in ("float", "double")
    return rows if floating else rows.withColumn("embedding", F.col("embedding").cast("array<double>"))


def distinct_vectors(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """x, packed: the fit list. Copies meet in partial sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(_integers(batch.column(0), dims, scale)[1]), pa.binary())], ["x"])

    return _plain(vectors, dims).mapInArrow(run, "x binary").distinct()


def _row(part: int, s: Summary) -> pa.RecordBatch:
    from decimal import Decimal

    values = [[part], [s.n], [[Decimal(v) for v in s.sums]], [s.s.tolist()], [s.vt.ravel().tolist()]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "n", "sums", "s", "vt"])


def _summary(n: int, sums: list, s: list[float], vt: list[float]) -> Summary:
    return Summary(n, [int(v) for v in sums], np.array(s), np.array(vt).reshape(len(s), len(sums)))


def _leaves(distinct: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Summary | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = leaf(unpacked(batch.column(0).slice(at, BLOCK).to_pylist(), dims))
                held = merged([held, part]) if held else part
        if held:
            yield _row(TaskContext.get().partitionId(), held)

    return distinct.mapInArrow(run, _SUMMARY)


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    return pa.Table.from_batches([_row(key[0].as_py(), merged([_summary(r["n"], r["sums"], r["s"], r["vt"]) for r in rows]))])


def fitted(distinct: DataFrame, dims: int) -> Summary | None:
    """The summary of a stored fit list, or None if it is empty. Levels are stored; the driver reads their number of rows and the last row."""
    level = stored(_leaves(distinct, dims), "svd")
    while (count := level.count()) > 1:
        # parts are numbered by their place, which the driver knows only as a number of partitions at most
        groups = level.withColumn("_group", F.floor(F.col("part") / FAN).cast("bigint"))
        level = stored(groups.groupBy("_group").applyInArrow(_merge, _SUMMARY), "svd")
    row = level.first() if count else None
    return row and _summary(row["n"], row["sums"], row["s"], row["vt"])


def _projected(x: np.ndarray, fit: Summary, scales: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """Whitened rows, and their exact deviations."""
    near = np.array([v // fit.n for v in fit.sums], np.int64)
    rest = np.array([(v - int(a) * fit.n) / fit.n for v, a in zip(fit.sums, near)])
    centred = (x - near).astype(np.float64) - rest
    out = centred @ fit.vt[: len(scales)].T * scales
    y, r, n = x - near, [v - int(a) * fit.n for v, a in zip(fit.sums, near)], fit.n
    most = float(np.abs(y).max()) + 1 if len(y) else 1.0
    if max(most, n) * most * x.shape[1] < 2.0**62:  # sums of y y and y r fit 64 bits; n times them may not
        squares, mixed, rests = (y * y).sum(axis=1).tolist(), (y * np.array(r, np.int64)).sum(axis=1).tolist(), sum(v * v for v in r)
        big = [n * n * a - 2 * n * b + rests for a, b in zip(squares, mixed)]
    else:
        big = [sum((n * int(v) - b) ** 2 for v, b in zip(row, r)) for row in y]
    return out, [v if v < 1 << 63 else None for v in big]


def dimensions(vectors: DataFrame) -> int | None:
    """The most frequent length of the vectors that aren't empty."""
    lengths = vectors.select(F.size("embedding").alias("d")).where("d > 0").groupBy("d").agg(F.count("*").alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return found and found["d"]


def whitening(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Summary | None]:
    """vec_id, component, n, deviation, whitened, explained, identity_error for the first k components of each row that remains; and the summary of the fit."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dims = dimensions(vectors)
    distinct = dims and stored(distinct_vectors(vectors, dims, scale), "distinct")
    fit = fitted(distinct, dims) if dims else None
    if fit is None:
        return spark.createDataFrame([], schema), None
    k, kept = min(k, dims), len(fit.s)
    values = np.zeros(max(k, kept))
    values[:kept] = fit.s**2 / fit.n
    live = int((fit.s[:k] > RANK * max(fit.s[0], 1e-300)).sum()) if fit.s[0] > 0 else 0
    scales = 1 / np.sqrt(values[:live])
    explained = [float(v / values.sum()) if i < live else 0.0 for i, v in enumerate(values[:k])]
    error = _identity_error(distinct, fit, scales, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                at, x = _integers(part.column(1), dims, scale)
                if not len(x):
                    continue
                white, deviation = _projected(x, fit, scales)
                full = np.zeros((len(x), k))
                full[:, :live] = white
                ids, rows = part.column(0).take(pa.array(np.repeat(at, k))), len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, fit.n, np.int64)),
                     pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(full.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(rows, error))],
                    schema=None, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return _plain(vectors, dims, "vec_id").mapInArrow(run, schema), fit


def _identity_error(distinct: DataFrame, fit: Summary, scales: np.ndarray, dims: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from one more pass over it."""
    k = len(scales)
    if not k:
        return 0.0
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(pairs))
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                w, _ = _projected(unpacked(batch.column(0).slice(s, BLOCK).to_pylist(), dims), fit, scales)
                total += np.concatenate([w.sum(axis=0), [(w[:, i] * w[:, j]).sum() for i, j in pairs]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "x"])

    sums = dict(distinct.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect())  # k (k + 3) / 2 rows
    mean = [sums[i] / fit.n for i in range(k)]
    return max(abs(sums[k + p] / fit.n - mean[i] * mean[j] - (i == j)) for p, (i, j) in enumerate(pairs))
