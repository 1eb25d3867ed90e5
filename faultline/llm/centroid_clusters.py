"""Centroid clustering of quantised vectors: float32 products screen the centroids, exact integers decide.

Vectors become integers, floor(64 x). The centroid nearest to a vector q is the one with the least |c|^2 - 2 q c. A batch of vectors is multiplied with all
centroids in float32. Each product lies within a radius of the true one: for sums of m products in any order |error| <= g |q| |c| with g = (m + 2) u / (1 - (m + 2) u),
u = 2^-24 (two more factors for the rounding of q and c), and some units of float64 for the rest. A centroid stays if the low end of its interval isn't above
the lowest high end. One that stays alone is the nearest; where several do, their distances are computed in 64-bit integers, and ties go to the lowest number.

Each round reads the stored integers once and shuffles, from each task, a sum for each centroid and component. The driver holds the centroids only.

Edge cases: vectors that are null, of another length than `dims`, or with a null or non-finite component are left out; so are those with an integer beyond
LARGEST, as squared distances of such vectors don't fit 64 bits. Repeated rows each count. Vectors without an id are clustered, and start as a centroid only if
too few others are there. With fewer than k vectors there are fewer centroids; an empty table gives none. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

K, DIMS, ROUNDS, SCALE = 16, 64, 3, 64
LARGEST = 1 << 27
#: Vectors that are screened at once.
BLOCK = 4096
_U32, _U64 = 2.0**-24, 2.0**-53


def components(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists with just `dims` finite components, and these as float64 rows."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.nonzero(lengths == dims)[0]
    values = column.take(pa.array(at)).flatten().cast(pa.float64())
    rows = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dims)
    good = np.isfinite(rows).all(axis=1)
    return at[good], rows[good]


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and `q`, the components as 32-bit integers in one binary, of the vectors that are kept."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    plain = vectors.where(F.size("embedding") == dims).select("vec_id", F.col("embedding"))
    if plain.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        plain = plain.withColumn("embedding", F.col("embedding").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = components(batch.column(1), dims)
            with np.errstate(over="ignore"):
                q = np.floor(scale * x)
            fits = (np.abs(q) <= LARGEST).all(axis=1)
            ids, q = batch.column(0).take(pa.array(at[fits])), np.ascontiguousarray(q[fits].astype("<i4"))
            if len(q):
                blob = pa.Array.from_buffers(pa.binary(4 * dims), len(q), [None, pa.py_buffer(q)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, blob], ["vec_id", "q"])

    return plain.mapInArrow(run, f"vec_id {kind}, q binary")


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a binary column of `quantised`, as 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dims).astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the centroid nearest to each row, and how many rows needed exact distances."""
    single, norms = centroids.astype(np.float32), (centroids**2).sum(axis=1)
    products = (q.astype(np.float32) @ single.T).astype(np.float64)
    m = q.shape[1] + 2
    g = m * _U32 / (1 - m * _U32)
    # norms of the exact integers, rounded up
    lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9), np.sqrt(norms.astype(np.float64)) * (1 + 1e-9)
    score = norms.astype(np.float64) - 2 * products
    radius = 2 * g * np.outer(*lengths) + 8 * _U64 * (norms.astype(np.float64) + 2 * np.abs(products)) + 1e-30
    open_ = score - radius <= (score + radius).min(axis=1, keepdims=True)
    best = open_.argmax(axis=1)
    unsure = np.nonzero(open_.sum(axis=1) > 1)[0]
    if len(unsure):
        row, number = np.nonzero(open_[unsure])
        exact = np.full((len(unsure), len(centroids)), np.iinfo(np.int64).max)
        exact[row, number] = ((q[unsure[row]] - centroids[number]) ** 2).sum(axis=1)
        best[unsure] = exact.argmin(axis=1)  # the first of equal ones
    return best, len(unsure)


def _sums(rows: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """Of each centroid that has vectors: number, sums of the components and, at the end, the number of vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                q = integers(batch.column(0).slice(s, BLOCK), dims)
                best, _ = nearest(q, centroids)
                order = np.argsort(best, kind="stable")
                used, starts = np.unique(best[order], return_index=True)
                total[used, :dims] += np.add.reduceat(q[order], starts, axis=0)
                total[:, dims] += np.bincount(best, minlength=k)
        used = np.nonzero(total[:, dims])[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = rows.select("q").mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("at", "x"))
    whole = parts.groupBy("cluster", "at").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("x"))
    return [(r["cluster"], [v["x"] for v in r["x"]]) for r in whole.collect()]  # k rows


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of quantised rows."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                q = integers(part.column(1), dims)
                best, _ = nearest(q, centroids)
                distance = ((q - centroids[best]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "q").mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def starting(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors whose ids hash lowest, in order of the hash; equal hashes by components."""
    picked = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)).orderBy(F.col("_h").asc_nulls_last(), "q").limit(k)
    found = [bytes(r["q"]) for r in picked.select("q").collect()]  # k rows
    return np.frombuffer(b"".join(found), "<i4").reshape(len(found), dims).astype(np.int64)


def centroid_clusters(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """The kept vectors with their final cluster and squared distance, stored, and the final centroids."""
    rows = stored(quantised(vectors, dims, scale), "vectors")
    centroids = starting(rows, k, seed, dims)
    if not len(centroids):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for number, sums in _sums(rows, centroids):
            moved[number] = [x // sums[-1] for x in sums[:-1]]
        centroids = moved
    return stored(assigned(rows, centroids), "assigned"), centroids


def digest(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """clusters with cluster_inertia, inertia and centroid_sha256."""
    per = {r["cluster"]: r["d"] for r in clusters.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(i, per[i], sum(per.values()), hashes[i]) for i in sorted(per)]
    known = clusters.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return clusters.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
