"""Which interval holds a point: the first one by list order, for lists of any length on one key.

Places are cut into cells of `width`. An interval enters the cells of its two ends, cut at their edges; the cells between them it covers whole, and of those
that cover a cell only the first by order counts. So the covered range is cut into aligned runs of 2^l cells, at most two for each l, which partial aggregates
reduce to one candidate a run; a cell asks its own run of each length. Points at one place share one answer, so each place is asked once.

Cells are hashed to tasks and sorted by place, and one pass holds the intervals that are open at a place in a heap by list order. What one task holds is bounded
by a cell, however long a key's list is, and a point costs the logarithm of the open intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a cell. Lines of a source by default.
WIDTH = 4096
#: Runs of 2^0 to 2^LEVELS cells.
LEVELS = 51

_WHOLE = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz")


def _place(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    if kind not in _WHOLE:
        raise TypeError(f"{name} is {kind}; places are whole numbers, dates or timestamps")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_micros(F.col(name)) if kind == "timestamp" else F.unix_date(F.col(name)).cast("bigint") if kind == "date" else F.col(name).cast("bigint")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events in order of key, cell and place, intervals before points. Columns: _p, _e, _w, _a, _b, cell, keys. A point has no _w."""
    cell: tuple | None = None
    open_: list[tuple] = []
    for batch in batches:
        found: list[tuple[int, tuple]] = []
        for i, (place, end, order, first, last, *here) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if here != cell:
                cell, open_ = here, []
            if order is not None:
                heappush(open_, (order, first, last, end))
                continue
            while open_ and open_[0][3] < place:
                heappop(open_)
            if open_:
                found.append((i, open_[0]))
        at = pa.array([i for i, _ in found], pa.int64())
        won = [pa.array([w[k] for _, w in found], batch.column(j).type) for k, j in ((0, 2), (1, 3), (2, 4))]
        keys = [batch.column(j).take(at) for j in range(6, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *won, *keys], ["_p", "_w", "_a", "_b", *(batch.schema.names[6:])])


def first_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, order: str, width: int = WIDTH) -> DataFrame:
    """For each key and place that some interval holds, ends included: the keys as _k0.., _p, and _w, _a, _b, order, start and end of the first one.

    order: a column that tells list order; of intervals that share it, the one with the lower start, then end, is first. Nulls in keys, places or order match nothing."""
    names = [f"_k{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names)]
    known = lambda df, *cols: df.where(" and ".join(f"{c} is not null" for c in (*names, *cols)))
    cell_of = lambda place: F.floor(place / F.lit(width)) if width & (width - 1) else F.shiftright(place, width.bit_length() - 1)
    places = known(points.select(*renamed, _place(points, point).alias("_p")), "_p").distinct().withColumn("_cell", cell_of(F.col("_p")))
    spans = known(intervals.select(*renamed, F.col(order).alias("_w"), _place(intervals, start).alias("_a"), _place(intervals, end).alias("_b")), "_w", "_a", "_b").where("_a <= _b")
    spans = spans.withColumns({"_ca": cell_of(F.col("_a")), "_cb": cell_of(F.col("_b"))})
    ends = spans.withColumn("_cell", F.explode(F.when(F.col("_ca") == F.col("_cb"), F.array("_ca")).otherwise(F.array("_ca", "_cb"))))
    ends = ends.withColumns({"_p": F.greatest("_a", F.col("_cell") * width), "_e": F.least("_b", (F.col("_cell") + 1) * width - 1)})
    # aligned runs of cells between the ends: at length 2^l the range shrinks to whole runs, and an odd one at either side is taken
    right = F.expr(f"""filter(transform(sequence(0, {LEVELS}), l -> if(-shiftright(-(_ca + 1), l) < shiftright(_cb, l) and (shiftright(_cb, l) & 1) = 1,
        struct(l as level, shiftright(_cb, l) - 1 as run), null)), x -> x is not null)""")
    left = F.expr(f"""filter(transform(sequence(0, {LEVELS}), l -> if(-shiftright(-(_ca + 1), l) < shiftright(_cb, l) and (-shiftright(-(_ca + 1), l) & 1) = 1,
        struct(l as level, -shiftright(-(_ca + 1), l) as run), null)), x -> x is not null)""")
    covered = spans.where("_cb - _ca > 1").withColumn("_r", F.explode(F.concat(left, right)))
    best = covered.groupBy(*names, F.col("_r.level").alias("_level"), F.col("_r.run").alias("_run")).agg(F.min(F.struct("_w", "_a", "_b")).alias("_best"))
    asked = places.select(*names, "_cell").distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("_run", F.expr("shiftright(_cell, _level)"))
    carried = asked.join(best, [*names, "_level", "_run"]).groupBy(*names, "_cell").agg(F.min("_best").alias("_best"))
    carried = carried.select(*names, "_cell", (F.col("_cell") * width).alias("_p"), ((F.col("_cell") + 1) * width - 1).alias("_e"), "_best.*")
    columns = ["_p", "_e", "_w", "_a", "_b", "_cell", *names]
    none = {c: F.lit(None).cast(spans.schema[c].dataType) for c in ("_w", "_a", "_b")}
    events = ends.select(*columns).unionByName(carried.select(*columns)).unionByName(places.withColumns({"_e": F.col("_p"), **none}).select(*columns))
    dealt = events.repartition(*names, "_cell").sortWithinPartitions(*names, "_cell", "_p", F.col("_w").isNull())
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return dealt.mapInArrow(_sweep, ", ".join(f"{c} {kinds[c]}" for c in ("_p", "_w", "_a", "_b", *names)))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """points with the value of the first interval (by order) of their keys that holds them, ends included, or null."""
    names = [f"_k{i}" for i in range(len(keys))]
    won = first_intervals(points, intervals, keys, point, start, end, order, width)
    values = intervals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(order).alias("_w"), _place(intervals, start).alias("_a"), _place(intervals, end).alias("_b"), value.alias("_value"))
    values = values.groupBy(*names, "_w", "_a", "_b").agg(F.any_value("_value").alias(name))
    found = won.join(values, [*names, "_w", "_a", "_b"]).select(*names, F.col("_p").alias("_at"), F.col(name).alias("_found"))
    same = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    out = points.withColumn("_here", _place(points, point)).join(found, [*same, F.col("_here") == F.col("_at")], "left")
    return out.withColumn(name, F.col("_found")).drop("_here", "_at", "_found", *names)
