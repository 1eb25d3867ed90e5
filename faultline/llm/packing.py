"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised once; those longer than a sequence are cut into full sequences and a rest. Pieces are dealt by hash
into blocks of about BLOCK pieces, each a bin-packing problem that fits easily in one task. Every block is evolved
by several islands that start from random packings: a chromosome is a set of bins, crossover injects whole well-filled bins of one parent into the other, drops the bins that
now hold duplicates, and best-fits the displaced documents. After each epoch the elites of a block's islands migrate, each to the next
island; a block all of whose bins but one are well filled has settled and moves no more. The pieces of poorly filled bins of all blocks are pooled and packed again, until one block is left.

Nulls and edge cases: a null or empty text has only the end token. A null id keeps its piece. Repeated rows are packed
each on their own. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_arrow, stored
from .tokens import END_ID, TOKENIZER, encoder

CAPACITY = 4096
BLOCK = 2048
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 14
POPULATION = 6
#: Shares of the bins that crossover brings in, and that mutation opens twice.
INJECTED, OPENED = 0.3, 0.3
#: Bins filled less than this are opened again together with those of other blocks.
WELL_FILLED = 0.995

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of documents cut at the capacity."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


# --- the grouping genetic algorithm; a chromosome is its bins, lists of item numbers, and their fills ---

Bins = tuple[list[list[int]], list[int]]


def placed(bins: Bins, items: Iterable[int], size: list[int], capacity: int) -> Bins:
    """Put each item, in the order given, into the fullest bin that still holds it."""
    inside, fills = bins
    free = sorted((capacity - f, k) for k, f in enumerate(fills))
    for i in items:
        need = size[i]
        at = bisect_left(free, (need, -1))
        if at == len(free):
            inside.append([i])
            fills.append(need)
            insort(free, (capacity - need, len(inside) - 1))
        else:
            room, k = free.pop(at)
            inside[k].append(i)
            fills[k] += need
            insort(free, (room - need, k))
    return bins


def best_fit(bins: Bins, items: Iterable[int], size: list[int], capacity: int) -> Bins:
    """Best-fit decreasing: largest first."""
    return placed(bins, sorted(items, key=lambda i: (-size[i], i)), size, capacity)


def fitness(bins: Bins, capacity: int) -> float:
    """Fewer bins first, then the mean square of their fill."""
    fill = np.array(bins[1]) / capacity
    return -len(fill) + float((fill**2).mean()) if len(fill) else 0.0


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """INJECTED of the bins of b, drawn by their fill, come whole into a; bins of a that hold any of their items go, and what they lose is best-fitted."""
    weight = (np.array(b[1]) / capacity) ** 8
    chosen = sorted(rng.choice(len(b[0]), max(1, int(len(b[0]) * INJECTED)), replace=False, p=weight / weight.sum()).tolist())
    taken = {i for k in chosen for i in b[0][k]}
    inside, fills, displaced = [list(b[0][k]) for k in chosen], [b[1][k] for k in chosen], []
    for x, f in zip(*a):
        if taken.isdisjoint(x):
            inside.append(list(x))
            fills.append(f)
        else:
            displaced += [i for i in x if i not in taken]
    return best_fit((inside, fills), displaced, size, capacity)


def mutate(a: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Open the emptiest OPENED of the bins and as many drawn ones, and best-fit their items in the rest."""
    n = max(2, int(len(a[0]) * OPENED))
    opened = {*np.argsort(a[1], kind="stable")[:n].tolist(), *rng.integers(0, len(a[0]), n).tolist()}
    rest = [list(x) for k, x in enumerate(a[0]) if k not in opened], [f for k, f in enumerate(a[1]) if k not in opened]
    return best_fit(rest, [i for k in opened for i in a[0][k]], size, capacity)


def settled(bins: Bins, bound: int, capacity: int) -> bool:
    """Nothing left to gain: one bin at most is poorly filled, or the number of bins is least and two are."""
    poor = sum(f < WELL_FILLED * capacity for f in bins[1])
    return poor <= 1 or (len(bins[0]) <= bound and poor <= 2)


def evolve(size: list[int], seeds: list[Bins], capacity: int, seed: int, generations: int = GENERATIONS) -> tuple[Bins, int, int]:
    """The best packing, the generations run, and the crossovers whose child was better than the parent it came from. Who isn't among the seeds starts as a random packing."""
    rng, n = np.random.default_rng(seed), len(size)
    bound, accepted = -(-sum(size) // capacity), 0
    best = lambda: max(people, key=lambda x: fitness(x, capacity))
    people = list(seeds)
    if people and settled(best(), bound, capacity):
        return best(), 0, 0
    while len(people) < POPULATION:
        people.append(placed(([], []), rng.permutation(n).tolist(), size, capacity))
    done = 0
    while done < generations and len(best()[0]) > 1:
        done += 1
        people.sort(key=lambda x: -fitness(x, capacity))
        half = people[: POPULATION // 2]
        for parent in list(half):
            child = crossover(parent, people[int(rng.integers(len(people)))], size, capacity, rng)
            accepted += fitness(child, capacity) > fitness(parent, capacity)
            half.append(mutate(child, size, capacity, rng))
        people = half
        if settled(best(), bound, capacity):
            break
    return best(), done, accepted


_STATE = "block bigint, island int, length array<bigint>, bins array<int>, score double, settled boolean, generations int, crossovers int"


def _as_bins(labels, size: list[int]) -> Bins:
    inside: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        inside.setdefault(int(k), []).append(i)
    return list(inside.values()), [sum(size[i] for i in x) for x in inside.values()]


def _evolver(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                size = [int(x) for x in r.length]
                seeds = [_as_bins(x, size) for x in (r.bins, r.migrant) if x is not None and len(x)]
                best, generations, accepted = evolve(size, seeds, capacity, hash((int(r.block), int(r.island), epoch)) & 0xFFFFFFFF)
                label = np.zeros(len(size), np.int32)
                for k, b in enumerate(best[0]):
                    label[b] = k
                rows.append((r.block, r.island, size, label, fitness(best, capacity), settled(best, -(-sum(size) // capacity), capacity), r.generations + generations, r.crossovers + accepted))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _packed_blocks(items: DataFrame, blocks: int, capacity: int, turn: int) -> DataFrame:
    """items (key, length) with block, bin, and the generations and accepted crossovers of the block; every block is evolved by ISLANDS islands, and one that has settled on any of them stops."""
    block = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(blocks))
    grouped = items.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("length", "key")), asc=False).alias("items"))  # about BLOCK pieces
    grouped = stored(grouped, "pack-blocks")
    none, zero = F.lit(None).cast("array<int>"), F.lit(0)
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = grouped.select("block", islands, F.col("items.length").alias("length"), none.alias("bins"), none.alias("migrant"), zero.alias("generations"), zero.alias("crossovers"))
    found = None
    for epoch in range(EPOCHS):
        state = stored(state.repartition("block", "island").mapInPandas(_evolver(capacity, epoch), _STATE), "pack-state")
        last = epoch + 1 == EPOCHS
        by = state.groupBy("block").agg(F.bool_or("settled").alias("over"))
        over = state if last else state.join(by.where("over").drop("over"), "block")
        found = over if found is None else found.unionByName(over)
        if last or not by.where("not over").limit(1).count():
            break
        state = state.join(by.where("not over").drop("over"), "block")
        elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("migrant"))
        state = state.drop("score", "settled").join(elite, ["block", "island"])
    best = found.groupBy("block").agg(F.max_by("bins", F.struct("score", F.negative("island"))).alias("bins"), F.sum("generations").alias("generations"), F.sum("crossovers").alias("crossovers"))
    rows = grouped.join(best, "block").select("block", "generations", "crossovers", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    return rows.select("block", "generations", "crossovers", F.col("x.items.key").alias("key"), F.col("x.items.length").alias("length"), F.col("x.bins").cast("bigint").alias("bin"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (key string unique, length 1..capacity) with sequence_id, offset, the turn of pooling, and generations and accepted crossovers of its block's islands. Sequences are as few as the search finds."""
    zero = F.lit(0).cast("bigint")
    full = items.where(F.col("length") >= capacity).select("key", F.xxhash64("key").alias("sequence_id"), zero.alias("offset"), F.lit(-1).alias("turn"), zero.alias("generations"), zero.alias("crossovers"))
    rest, out, turn, last = items.where(F.col("length") < capacity).select("key", "length"), [], 0, None
    while True:
        n = rest.count()
        blocks = max(1, -(-n // BLOCK))
        packed = _packed_blocks(rest, blocks, capacity, turn)
        fill = packed.groupBy("block", "bin").agg(
            F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("key", "length"))).alias("inside"), F.max("generations").alias("generations"), F.max("crossovers").alias("crossovers")
        )  # at most capacity tokens, so at most capacity pieces
        fill = stored(fill, "pack-bins")
        stop = blocks == 1 or (last is not None and n > 0.9 * last)
        done = fill if stop else fill.where(F.col("fill") >= WELL_FILLED * capacity)
        out.append(done.select(F.xxhash64(F.lit(turn), "block", "bin").alias("sequence_id"), "inside", F.lit(turn).alias("turn"), "generations", "crossovers"))
        if stop:
            break
        rest = fill.where(F.col("fill") < WELL_FILLED * capacity).select(F.explode("inside").alias("x")).select("x.key", "x.length")
        last, turn = n, turn + 1
    spread = None
    for part in out:
        lengths = F.transform("inside", lambda x: x["length"])
        at = F.transform(F.sequence(F.lit(1), F.size("inside")), lambda i: F.aggregate(F.slice(lengths, 1, i - 1), F.lit(0).cast("bigint"), lambda s, x: s + x))
        rows = part.select("sequence_id", "turn", "generations", "crossovers", F.explode(F.arrays_zip(F.col("inside"), at.alias("at"))).alias("x"))
        rows = rows.select(F.col("x.inside.key").alias("key"), "sequence_id", F.col("x.at").alias("offset"), "turn", "generations", "crossovers")
        spread = rows if spread is None else spread.unionByName(rows)
    return spread.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, turn (of pooling; -1: fills a sequence), generations and crossovers (accepted ones) of the search that placed it."""
    cut = pieces(docs, tokenizer, capacity).withColumn("key", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id()))
    cut = stored(cut, "pack-pieces")
    placed = stored(pack(cut.select("key", "length"), capacity), "pack-placed")
    return cut.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "turn", "generations", "crossovers")
