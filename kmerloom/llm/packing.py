"""Filling containers of fixed capacity with items of whole-number length.

Only the histogram of lengths (at most `capacity` numbers) is solved centrally: a linear program over the ways to fill
one container, by multiplicative weights. The price of a length is its size, times a weight that falls exponentially as
more of its items are covered than of the others'; a knapsack table over these prices gives the dearest way to fill any
room, and from one table ways are read off, each beginning with another length, while they are worth nearly as much as
the dearest (CLOSE). A way is taken as often as the items left allow, at most a STRIDE of a length's items at a time, in
whole containers: so the steps are rounded as they are made, every item is placed by the program, and nothing is left for
another packing. Any prices bound the program's value from below; if the best bound of all steps is over GAP away, it is
solved again with smaller strides, and the best solution counts. The result is a table of (length, ranks of its items,
containers); the items themselves never leave their tasks: each finds its container by its rank among equal lengths.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.tables import stage

STEPS, RATE, CLOSE, STRIDES, GAP, MISSES, RANK_BLOCK = 2_000, 1.0, 0.9995, (1.0, 0.3, 0.1), 0.01, 4, 500_000


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The largest sum of prices that fits into each room from 0 to `capacity`. `lengths` ascend."""
    best = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        n = fitting[room]
        best[room] = max(best[room - 1], (best[room - lengths[:n]] + prices[:n]).max()) if n else best[room - 1]
    return best


def read_off(best: np.ndarray, lengths: np.ndarray, prices: np.ndarray, room: int, limit: np.ndarray, first: int | None = None) -> np.ndarray:
    """The way that the knapsack table gives for `room`, with no more than `limit` items of a length; `first` is in it."""
    way, rest = np.zeros(len(lengths), np.int64), limit.copy()
    if first is not None:
        way[first], room = 1, room - lengths[first]
        rest[first] -= 1
    there = np.nonzero(rest)[0]
    size, price = lengths[there], prices[there]
    while n := int(np.searchsorted(size, room, "right")):
        k = int((best[room - size[:n]] + price[:n]).argmax())
        i = there[k]
        way[i] += 1
        rest[i] -= 1
        room -= size[k]
        if not rest[i]:
            there, size, price = (np.delete(x, k) for x in (there, size, price))
    return way


def dearest_way(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many items of each length to put into one container for the largest sum of prices."""
    return read_off(knapsack(lengths, prices, capacity), lengths, prices, capacity, np.full(len(lengths), capacity))


def solved(lengths: np.ndarray, counts: np.ndarray, capacity: int, stride: float) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Ways to fill a container, each with its number of containers, together holding exactly `counts`; and the best lower bound of the program."""
    left, ways, bound = counts.copy(), [], float(lengths @ counts) / capacity
    for step in range(STEPS):
        alive = np.nonzero(left)[0]
        if not len(alive):
            break
        size, share = lengths[alive], left[alive] / counts[alive]
        prices = size * np.exp(RATE * (share - share.max()))
        best = knapsack(size, prices, capacity)
        bound = max(bound, float(prices @ counts[alive]) / best[capacity])
        last = step == STEPS - 1  # whatever is left then is read off the last table
        budget = left[alive].copy() if last else np.minimum(left[alive], np.maximum(1, (stride * counts[alive]).astype(np.int64)))
        taken = misses = 0
        for i in np.argsort(-share, kind="stable").tolist():
            while budget[i] > 0 and misses < MISSES:
                way = read_off(best, size, prices, capacity, budget, i)
                if taken and not last and way @ prices < CLOSE * best[capacity]:
                    misses += 1
                    break
                used = np.nonzero(way)[0]
                times = int((budget[used] // way[used]).min())
                budget[used] -= times * way[used]
                left[alive[used]] -= times * way[used]
                whole = np.zeros(len(lengths), np.int64)
                whole[alive] = way
                ways.append((whole, times))
                taken += 1
            if misses >= MISSES:
                break
    return ways, bound


@lru_cache(maxsize=8)
def _program(histogram: tuple[tuple[int, int], ...], capacity: int) -> tuple[list[tuple[np.ndarray, int]], int, float]:
    """The ways, their number of containers, and the lower bound, for the (length, count) of all lengths over 0."""
    lengths, counts = (np.array(x, np.int64) for x in zip(*histogram))
    found, bound = None, 0.0
    for stride in STRIDES:
        ways, low = solved(lengths, counts, capacity, stride)
        bound = max(bound, low)
        value = sum(times for _, times in ways)
        if found is None or value < found[1]:
            found = (ways, value)
        if found[1] <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)):
            break
    return (*found, bound)


def program(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[np.ndarray, int]], int, float]:
    """The solution of the linear program in whole containers: ways with their numbers of containers, the sum of these, and the lower bound."""
    some = tuple(sorted((int(n), int(c)) for n, c in histogram.items() if n > 0 and c > 0))
    return _program(some, capacity) if some else ([], 0, 0.0)


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The ways of the program, each with its number of containers, together covering all counts."""
    return solved(lengths, counts, capacity, STRIDES[0])[0]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first container, items a container) and the number of containers."""
    ways, containers, _ = program(histogram, capacity)
    lengths = np.array(sorted(n for n, c in histogram.items() if n > 0 and c > 0), np.int64)
    done, rows, at = np.zeros(len(lengths), np.int64), [], 0
    for way, times in ways:
        for i in np.nonzero(way)[0]:
            rows.append((int(lengths[i]), int(done[i]), int(done[i] + way[i] * times), at, int(way[i])))
        done += way * times
        at += times
    return rows, containers


def pack(df: DataFrame, item: str, length: str, capacity: int) -> DataFrame:
    """(item, piece, piece_start, piece_length, container) for all rows of `df`.

    An item longer than `capacity` becomes pieces of `capacity` and a rest; no other is split. Null and negative lengths
    count as 0; items of length 0 take no room and are spread over the containers (container 0 if there is no other).
    `item` should be unique. An empty table gives no rows.
    """
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    sized = stage(df.select(F.col(item).alias("item"), n.alias("n")), "pack-lengths")
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int") - 1))
    start = F.col("piece").cast("long") * capacity
    pieces = sized.select("item", "n", cut.alias("piece")).select("item", "piece", start.alias("piece_start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("piece_length"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("piece_length").count().collect()}  # at most capacity + 1 rows
    rows, containers = plan(histogram, capacity)
    blocks = max(8, -(-sum(histogram.values()) // RANK_BLOCK))
    zero = F.when(F.lit(containers) > 0, F.pmod(F.xxhash64("item"), F.lit(max(containers, 1)))).otherwise(0)

    # The rank among equal lengths: within a block of items, plus the items of the blocks before.
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)).cast("int"))
    sized_blocks = blocked.where("piece_length > 0")
    sizes = sized_blocks.groupBy("piece_length", "block").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("piece_length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("piece_length", "block", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("piece_length", "block").orderBy("item", "piece")) - 1
    ranked = sized_blocks.withColumn("within", within).join(offsets, ["piece_length", "block"]).withColumn("rank", F.col("before") + F.col("within"))

    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    per_length = max(histogram.values(), default=0) + 1
    starts = table[:, 0] * per_length + table[:, 1]

    @F.arrow_udf(T.LongType())
    def container_of(size: pa.Array, rank: pa.Array) -> pa.Array:
        size, rank = size.to_numpy(), rank.to_numpy()
        row = table[np.searchsorted(starts, size * per_length + rank, "right") - 1]
        return pa.array(row[:, 3] + (rank - row[:, 1]) // row[:, 4], pa.int64())

    columns = [F.col("item").alias(item), "piece", "piece_start", "piece_length"]
    some = ranked.select(*columns, container_of(F.col("piece_length").cast("long"), "rank").alias("container"))
    none = pieces.where("piece_length = 0").select(*columns, zero.cast("long").alias("container"))
    return some.unionByName(none)
