"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K-1 share one weight for each hashed text feature; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold[k] - w.x). The expected grade and the tail probability P(grade >= SELECT_GRADE) follow, and a
document is kept if its tail probability is at least SELECT_TAIL.

Fit on at most SAMPLE labelled rows, drawn by a hash of their id, one for each id (that with the least text); all documents are scored in one scan with
no shuffle. Features: lower-cased words and their beginnings (counts up to 3), shapes of words
(share of the text's words), repeated neighbours and variety. Only features seen in MIN_DOCS sampled documents have a weight.

Nulls and edge cases: a null text, an empty one or one without words has the score of no features and is
rejected, as there is nothing to keep. Labels with a null id or two nulls are left out; repeated labels of an id
count once, with the lowest grade. With no labels, or labels of one grade, every document with words is kept with grade null.
Extra columns are dropped, repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_arrow

#: Labelled rows used for the fit, at most.
SAMPLE = 8000
BUCKETS = 1 << 18
MIN_DOCS = 20
#: Bytes of a word that count as its beginning, so that inflected forms share a weight.
PREFIX = 4
L2 = 1e-4
STEPS = 200
GRADES = 3
SELECT_GRADE = 2
SELECT_TAIL = 0.3

SCHEMA = "doc_id bigint, score double, expected_grade double, tail double, kept boolean"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score):
        """P(grade <= k) for each k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds - np.asarray(score)[..., None], -40, 40)))


_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


class _Features(dict):
    """Of a word: the buckets of the word, of its beginning and of its shape; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        core = word.lower().strip(b".,;:!?\"'()[]{}#*$%&|<>")
        shape = _DIGITS.sub(b"9", _LETTERS.sub(b"a", _CAPITALS.sub(b"A", word)))
        hashed = ((core, 1), (core[:PREFIX], 2), (shape, 3))
        out = tuple(xxhash.xxh32_intdigest(x, seed) % BUCKETS for x, seed in hashed)
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def features(text: bytes, table: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    both = np.array([table[w] for w in words], np.int64)
    n_words = len(words)
    again = float((both[1:, 0] == both[:-1, 0]).sum()) / n_words
    w, n = np.unique(both[:, 0], return_counts=True)
    b, k = np.unique(both[:, 1], return_counts=True)
    s, m = np.unique(both[:, 2], return_counts=True)
    distinct = len(w) / n_words ** 0.8
    extra = xxhash.xxh32_intdigest(b"again", 4) % BUCKETS, xxhash.xxh32_intdigest(b"distinct", 4) % BUCKETS
    return np.concatenate([w, b, s, extra]).astype(np.int32), np.concatenate([np.minimum(n, 3) / 3, np.minimum(k, 3) / 3, 4.0 * m / n_words, [4.0 * again, distinct]]).astype(np.float32)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("bigint"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labels: doc_id, grade. The sample is the first rows by hash of the id, so it doesn't depend on how tables are stored."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Features()
        for batch in batches:
            pairs = [features(t or b"", table) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            cols = [batch.column(0), pa.array([p[0].tobytes() for p in pairs], pa.binary()), pa.array([p[1].tobytes() for p in pairs], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["grade", "at", "value"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(drawn), "doc_id")  # `sample` rows at most
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # and one of each id here
    got = rows.select("grade", "text").mapInArrow(run, "grade int, at binary, value binary").collect()
    got = sorted((r["grade"], bytes(r["at"]), bytes(r["value"])) for r in got)
    return train([np.frombuffer(r[1], np.int32) for r in got], [np.frombuffer(r[2], np.float32) for r in got], np.array([r[0] for r in got], np.int64))


def train(at: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, steps: int = STEPS) -> Model | None:
    """Maximum likelihood with an L2 penalty, by Adam on all rows; gaps between thresholds stay positive as exponentials."""
    if len(set(grade.tolist())) < 2:
        return None
    flat, values = np.concatenate(at), np.concatenate(value)
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    seen = np.bincount(flat, minlength=BUCKETS)
    use = seen[flat] >= MIN_DOCS
    flat, values, row = flat[use], values[use], row[use]
    kept, flat = np.unique(flat, return_inverse=True)
    share = np.bincount(grade, minlength=grades) + 1.0
    weight = (len(grade) / (grades * share))[grade]  # rare grades count as much as common ones
    p = np.concatenate([np.zeros(len(kept)), [-1.0], np.zeros(grades - 2)])  # weights, first threshold, log of the gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    n, d = len(grade), len(kept)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))
        score = np.bincount(row, values * p[flat], n)
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(cuts - score[:, None], -30, 30))), np.ones((n, 1))], 1)
        dens = cdf * (1 - cdf)
        i = np.arange(n)
        hi, lo = grade + 1, grade
        prob = np.maximum(cdf[i, hi] - cdf[i, lo], 1e-9)
        d_score = weight * (dens[i, hi] - dens[i, lo]) / prob / n  # of the negative log-likelihood
        d_cut = np.zeros((n, grades + 1))
        d_cut[i, hi] -= weight * dens[i, hi] / prob / n
        d_cut[i, lo] += weight * dens[i, lo] / prob / n
        d_cut = d_cut.sum(0)[1:grades]
        g = np.empty_like(p)
        g[:d] = np.bincount(flat, values * d_score[row], d) + L2 * p[:d]
        g[d] = d_cut.sum()
        for k in range(grades - 2):
            g[d + 1 + k] = np.exp(p[d + 1 + k]) * d_cut[k + 1 :].sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = p[:d]
    return Model(weights, np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])])))


def score(docs: DataFrame, model: Model | None, grade: int = SELECT_GRADE, tail: float = SELECT_TAIL) -> DataFrame:
    """One row for each document: doc_id, score, expected_grade, tail, kept."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, _Features()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            some = [bool(t and not t.isspace()) for t in texts]
            if m is None:
                nulls = pa.nulls(len(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), nulls, nulls, nulls, pa.array(some)], [x.split()[0] for x in SCHEMA.split(", ")])
                continue
            s = np.zeros(len(texts))
            for i, t in enumerate(texts):
                at, value = features(t or b"", table)
                s[i] = float(m.weights[at] @ value)
            below = m.below(s)
            high = 1 - below[:, grade - 1]
            cols = [batch.column(0), pa.array(s), pa.array(len(m.thresholds) - below.sum(1)), pa.array(high), pa.array((high >= tail) & np.array(some, bool), pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def ordinal_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, graded(labels), sample))


def selected(docs: DataFrame, model: Model | None, grade: int = SELECT_GRADE, tail: float = SELECT_TAIL) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, _Features()
        for batch in batches:
            keep = []
            for t in batch.column(place).cast(pa.binary()).to_pylist():
                some = bool(t and not t.isspace())
                if some and m is not None:
                    at, value = features(t, table)
                    some = bool(1 - m.below(float(m.weights[at] @ value))[grade - 1] >= tail)
                keep.append(some)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
