"""Most frequent values in bounded memory: a heavy part of voting buckets over a light part of plain counters.

Each task keeps BUCKETS x SLOTS residents with exact counts since they moved in, and one array of counters. A value
without a slot votes against its bucket; when the votes reach LAMBDA times the smallest resident, that resident is
evicted, its count falls into the counter of its hash, and the value moves in. Partial sketches are rows; they merge by
bucket: counts of the same value add up, the SLOTS largest stay, the rest falls into the counters, which add up cell by
cell. A value's true count is at least `lower` (its heavy count) and at most `upper` (that and its counter), that of a value
without a slot at most its counter. So no value is missed over the largest counter; where an answer needs values below
that, `at_least_share` counts those of the large counters exactly, and `most_frequent` says which rows are certain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.tables import stage

BUCKETS, SLOTS, LAMBDA, CELLS = 4096, 8, 2, 1 << 17


class HeavyLight:
    """The sketch of one task. Memory: BUCKETS * SLOTS values and CELLS counters, whatever the input."""

    def __init__(self, buckets: int, cells: int) -> None:
        self.buckets, self.cells = np.uint64(buckets), np.uint64(cells)
        self.hash = np.zeros((buckets, SLOTS), np.uint64)
        self.count = np.zeros((buckets, SLOTS), np.int64)  # 0: the slot is free
        self.part = np.zeros((buckets, SLOTS), bool)  # some of the resident's count may be in the light part
        self.value = np.empty((buckets, SLOTS), object)
        self.against = np.zeros(buckets, np.int64)
        self.light = np.zeros(cells, np.int64)
        self.total = 0

    def add(self, h: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
        """Add distinct values with their hashes and positive counts."""
        b = (h % self.buckets).astype(np.int64)
        same = (self.hash[b] == h[:, None]) & (self.count[b] > 0)
        known = same.any(1)
        self.count[b[known], same[known].argmax(1)] += n[known]
        h, value, n, b = h[~known], value[~known], n[~known], b[~known]
        order = np.lexsort((h, -n, b))
        h, value, n, b = h[order], value[order], n[order], b[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        for r in range(int(rank.max()) + 1 if len(rank) else 0):  # at most one value a bucket in each round
            i = rank == r
            self._challenge(h[i], value[i], n[i], b[i])

    def _challenge(self, h: np.ndarray, value: np.ndarray, n: np.ndarray, b: np.ndarray) -> None:
        slot = self.count[b].argmin(1)
        least = self.count[b, slot]
        self.against[b] += np.where(least > 0, n, 0)
        wins = (least == 0) | (self.against[b] >= LAMBDA * least)
        np.add.at(self.light, (h[~wins] >> np.uint64(20)) % self.cells, n[~wins])
        h, value, n, b, slot, least = h[wins], value[wins], n[wins], b[wins], slot[wins], least[wins]
        out = self.hash[b, slot]
        np.add.at(self.light, (out >> np.uint64(20)) % self.cells, least)
        self.hash[b, slot], self.count[b, slot], self.value[b, slot] = h, n, value
        self.part[b, slot] = (least > 0) | (self.against[b] > 0)
        self.against[b[least > 0]] = 0

    def rows(self) -> pa.RecordBatch:
        b, s = np.nonzero(self.count)
        cells = np.nonzero(self.light)[0]
        n, m = len(b), len(cells)
        nulls = pa.nulls
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.zeros(n, np.int8), np.ones(m, np.int8), np.int8(2)], pa.int8()),
                pa.array(np.r_[b, cells, 0], pa.int64()),
                pa.concat_arrays([pa.array(self.value[b, s], pa.string()), nulls(m + 1, pa.string())]),
                pa.array(np.r_[self.hash[b, s].view(np.int64), np.zeros(m + 1, np.int64)], pa.int64()),
                pa.array(np.r_[self.count[b, s], self.light[cells], self.total], pa.int64()),
                pa.array(np.r_[self.part[b, s], np.zeros(m + 1, bool)], pa.bool_()),
            ],
            names=["kind", "place", "value", "hash", "n", "part"],
        )


def _sketch(batches: Iterator[pa.RecordBatch], buckets: int, cells: int) -> Iterator[pa.RecordBatch]:
    sketch = HeavyLight(buckets, cells)
    for batch in batches:
        value, h, weight = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if batch.num_rows == 0:
            continue
        sketch.total += int(weight.sum())
        coded = value.dictionary_encode()
        code = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        n = np.zeros(len(coded.dictionary) + 1, np.int64)
        np.add.at(n, code, weight)
        first = np.zeros(len(n), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        keep = np.nonzero(n[:-1] > 0)[0]
        sketch.add(h[first[keep]].astype(np.int64).view(np.uint64), coded.dictionary.take(pa.array(keep)).to_numpy(zero_copy_only=False), n[keep])
    yield sketch.rows()


def heavy_light(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """The partial sketches of `df`, one set of rows per task, written to the shared folder.

    Rows: kind 0 = a resident (place = bucket), 1 = a counter (place = cell), 2 = the task's total. The total counts all
    rows; a null value adds to nothing else. A null weight is 0, a negative one an error of the caller; without `weight`
    every row weighs 1.
    """
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    v, buckets, cells = F.col(value).cast("string"), BUCKETS, CELLS
    rows = df.select(v.alias("v"), F.xxhash64(v).alias("h"), w.alias("w")).mapInArrow(lambda b: _sketch(b, buckets, cells), "kind TINYINT, place BIGINT, value STRING, hash BIGINT, n BIGINT, part BOOLEAN")
    return stage(rows, "heavy-light")


def total_of(sketch: DataFrame) -> DataFrame:
    """One row (total)."""
    return sketch.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _ranked(sketch: DataFrame) -> DataFrame:
    """The residents of all tasks added up, with their rank in their bucket and their counter's cell."""
    one = sketch.where("kind = 0").groupBy("place", "value", "hash").agg(F.sum("n").alias("n"), F.sum((~F.col("part")).cast("int")).alias("whole"))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "value"))
    return one.withColumn("rank", rank).withColumn("cell", _cell(F.col("hash")))


def _cell(hash_: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(hash_, 20), F.lit(CELLS))


def counters(sketch: DataFrame) -> DataFrame:
    """(cell, below): the light part of the merged sketch; all counts of a value without a slot are in its cell."""
    fallen = _ranked(sketch).where(f"rank > {SLOTS}").select("cell", "n")
    return sketch.where("kind = 1").select(F.col("place").alias("cell"), "n").unionByName(fallen).groupBy("cell").agg(F.sum("n").alias("below"))


def merged(sketch: DataFrame, light: DataFrame | None = None) -> DataFrame:
    """(value, lower, upper) of the residents of the merged sketch, at most BUCKETS * SLOTS rows. `light`: its counters, if they are at hand."""
    tasks = sketch.where("kind = 2").agg(F.count("*").alias("tasks")).scalar()
    both = _ranked(sketch).where(f"rank <= {SLOTS}").join(counters(sketch) if light is None else light, "cell", "left")
    upper = F.col("n") + F.when(F.col("whole") < tasks, F.coalesce("below", F.lit(0))).otherwise(0)
    return both.select("value", F.col("n").alias("lower"), upper.alias("upper"))


def most_frequent(df: DataFrame, value: str, weight: str | None, top: int) -> DataFrame:
    """(value, estimate, lower, upper, certain): the `top` values by approximate count, with the bounds of the count. No rows for an empty table.

    A row is certain if no value that isn't listed can have a larger count; the guarantee holds for the listed rows whose
    lower bound is at least every counter and the upper bound of every other resident.
    """
    sketch = heavy_light(df, value, weight)
    light = stage(counters(sketch), "heavy-counters")
    residents = stage(merged(sketch, light), "heavy-residents")
    turn = F.row_number().over(Window.orderBy(F.desc("lower"), "value"))  # at most BUCKETS * SLOTS rows
    ranked = residents.withColumn("turn", turn)
    others = ranked.where(F.col("turn") > top).agg(F.coalesce(F.max("upper"), F.lit(0)).alias("m")).scalar()
    unheld = light.agg(F.coalesce(F.max("below"), F.lit(0)).alias("m")).scalar()
    rows = ranked.where(F.col("turn") <= top).select("value", F.col("lower").alias("estimate"), "lower", "upper", (F.col("lower") >= F.greatest(others, unheld)).alias("certain"))
    return rows.orderBy(F.desc("estimate"), "value")


def at_least_share(df: DataFrame, value: str, weight: str | None, share_per_mille: float) -> DataFrame:
    """(value, n): every value whose exact count is at least that share of the total; none is missed, however small the share.

    The sketch gives the candidates (upper bound at or over the share: no more than BUCKETS * SLOTS, so they are
    broadcast), a second pass over `df` their exact counts. A counter at or over the share may hide a value without a
    slot; then all values of such counters (no more than CELLS, broadcast too) are counted exactly in the same pass. Null
    values only count in the total.
    """
    sketch = heavy_light(df, value, weight)
    least = total_of(sketch).scalar() * share_per_mille
    return _counted(df, value, weight, sketch, lambda n: n * 1000 >= least)


def exact_top(df: DataFrame, value: str, weight: str | None, top: int) -> DataFrame:
    """(value, n): the `top` values by exact count, of equal ones the first by value; fewer if there are no more with a count over 0.

    The lower bounds of the sketch's `top` largest residents tell what count is enough; the values that may reach it are
    counted in a second pass.
    """
    sketch = heavy_light(df, value, weight)
    enough = merged(sketch).orderBy(F.desc("lower")).limit(top).agg(F.count("*").alias("n"), F.min("lower").alias("least")).first()
    least = max(enough.least or 1, 1) if enough.n == top else 1
    return _counted(df, value, weight, sketch, lambda n: n >= least).orderBy(F.desc("n"), "value").limit(top)


def _counted(df: DataFrame, value: str, weight: str | None, sketch: DataFrame, reaches: Callable[[Column], Column]) -> DataFrame:
    """(value, n): the exact counts, over 0, that reach what is asked for."""
    light = stage(counters(sketch), "heavy-counters")
    candidates = merged(sketch, light).where(reaches(F.col("upper"))).select(F.col("value").alias("v"), F.lit(True).alias("listed"))
    crowded = light.where(reaches(F.col("below"))).select("cell", F.lit(True).alias("crowded"))
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1)
    rows = df.select(F.col(value).cast("string").alias("v"), w.alias("w")).where("v is not null")
    if crowded.isEmpty():
        rows = rows.join(F.broadcast(candidates), "v")
    else:
        placed = rows.withColumn("cell", _cell(F.xxhash64("v"))).join(F.broadcast(crowded), "cell", "left")
        rows = placed.join(F.broadcast(candidates), "v", "left").where("listed or crowded")
    exact = rows.groupBy("v").agg(F.sum("w").alias("n"))
    return exact.where(reaches(F.col("n")) & (F.col("n") > 0)).select(F.col("v").alias("value"), "n")
