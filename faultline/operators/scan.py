"""Running sums and last places along an order, for keys of any length.

Rows are range partitioned by key and order, so a long key lies in many partitions one after another. Each partition sums its own rows and is stored; of each partition
only the key that goes on from an earlier one needs an offset, one row for each partition at most, which is broadcast. So a run of any length is spread
over all tasks, where a window by run would put it into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def _starts(batch: pa.RecordBatch, n_keys: int, before: list | None) -> np.ndarray:
    """Which rows of a batch begin a new key. before: the key of the last row of the batch before."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = [batch.column(k)[0].as_py() for k in range(n_keys)] != before
    for k in range(n_keys):
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~np.asarray(same)
    return new


def _local(n_keys: int, n_sums: int, n_last: int):
    """Rows (keys, sums, flags) in order to the same with, of each key within the partition: the place from 1, sums of the rows before, the last flagged place so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        carry = np.zeros(1 + n_sums + n_last, object)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _starts(batch, n_keys, before)
            segment = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the key of the batch before goes on
            going, first = segment < 0, np.maximum(segment, 0)
            place = np.arange(n) - first + 1 + np.where(going, int(carry[0]), 0)
            out = [pa.array(np.full(n, part, np.int64)), pa.array(place)]
            carry[0] = int(place[-1])
            for i in range(n_sums):
                values = pc.fill_null(batch.column(n_keys + i), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(values)
                earlier = np.concatenate([[upto.dtype.type(0)], upto[:-1]])
                sums = earlier - earlier[first] + np.where(going, carry[1 + i], upto.dtype.type(0)).astype(upto.dtype)
                out.append(pa.array(sums))
                carry[1 + i] = (sums[-1] + values[-1]).item()
            for i in range(n_last):
                flags = np.asarray(pc.fill_null(batch.column(n_keys + n_sums + i), False))
                marked = np.maximum.accumulate(np.where(flags, np.arange(n), -1))
                last = np.where(marked >= first, place[marked], np.where(going, int(carry[1 + n_sums + i]), 0))
                out.append(pa.array(last))
                carry[1 + n_sums + i] = int(last[-1])
            before = [batch.column(k)[n - 1].as_py() for k in range(n_keys)]
            names = [*batch.schema.names, "_part", "_place", *(f"_s{i}" for i in range(n_sums)), *(f"_l{i}" for i in range(n_last))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names)

    return run


def scanned(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, place: str = "place", part: str | None = None) -> DataFrame:
    """rows with `place`, the number of a row in its key's order, from 1; for each of sums the sum over the rows before, 0 for the first; for each of last the place of the last row up
    to this one for which it holds, 0 where none does. Sums are bigint for whole numbers, else double; nulls add nothing and count as false. Null keys are one key. Rows that tie in order come as they come.
    part: a column for the number of the range that a row lies in, as with_first takes it."""
    sums, last = sums or {}, last or {}
    names = [f"_k{i}" for i in range(len(keys))]
    marks = [f"_v{i}" for i in range(len(sums))] + [f"_f{i}" for i in range(len(last))]
    given = rows.withColumns({n: F.col(k) for n, k in zip(names, keys)} | dict(zip(marks, [*sums.values(), *last.values()])))
    whole = ("tinyint", "smallint", "int", "bigint")
    given = given.withColumns({n: F.col(n).cast("bigint" if f.dataType.simpleString() in whole else "double") for f in given.schema if (n := f.name) in marks[: len(sums)]})
    dealt = given.repartitionByRange(*names, *order).sortWithinPartitions(*names, *order)
    wide = dealt.select(*names, *marks, F.struct(*rows.columns).alias("_row"))
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    made = {"_part": "bigint", "_place": "bigint"} | {f"_s{i}": kinds[f"_v{i}"] for i in range(len(sums))} | {f"_l{i}": "bigint" for i in range(len(last))}
    local = stored(wide.mapInArrow(_local(len(keys), len(sums), len(last)), ", ".join(f"{n} {k}" for n, k in (kinds | made).items())), "scan")
    # of each key in each partition what it adds up to; of those that went on from an earlier partition, what was before
    ends = local.groupBy("_part", *names).agg(
        F.max("_place").alias("_n"), *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))], *[F.max(f"_l{i}").alias(f"_m{i}") for i in range(len(last))]
    )
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = ends.withColumns({f"_c{i}": F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)) for i in range(len(sums))} | {
        f"_d{i}": F.coalesce(F.max(F.when(F.col(f"_m{i}") > 0, F.col("_from") + F.col(f"_m{i}"))).over(before), F.lit(0)) for i in range(len(last))
    }).where("_from > 0")
    carried = carried.select(F.col("_part").alias("_p"), *[F.col(n).alias(f"_{n}") for n in names], "_from", *[f"_c{i}" for i in range(len(sums))], *[f"_d{i}" for i in range(len(last))])
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    out = local.join(F.broadcast(carried), [F.col("_part") == F.col("_p"), *same], "left")  # at most a row for each partition
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = [(F.col("_place") + zero("_from")).alias(place)]
    columns += [(F.col(f"_s{i}") + zero(f"_c{i}")).alias(n) for i, n in enumerate(sums)]
    columns += [F.when(F.col(f"_l{i}") > 0, F.col(f"_l{i}") + zero("_from")).otherwise(zero(f"_d{i}")).alias(n) for i, n in enumerate(last)]
    return out.select("_row.*", *columns, *([F.col("_part").alias(part)] if part else []))


def with_first(rows: DataFrame, keys: list[str], place: str, part: str, test: Column, value: Column, name: str) -> DataFrame:
    """rows (of scanned, with `part`) with `name`, struct<at, value> of the first place of their key for which the test holds, or null. Each range of a key has a row of its own to be joined
    with, so a join by key and range leaves no more than a range to one task, however long the key."""
    names = [f"_k{i}" for i in range(len(keys))]
    one = F.struct(F.col(place).alias("at"), value.alias("value"))
    ends = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(part).alias("_p")).agg(F.min_by(F.when(test, one), F.when(test, F.col(place))).alias("_first"))
    hit = ends.withColumn(name, F.min_by("_first", "_first.at").over(Window.partitionBy(*names))).drop("_first")
    return rows.join(hit, [F.col(part) == F.col("_p"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]], "left").drop(*names, "_p")
