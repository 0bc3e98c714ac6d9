"""Distinct counts from mergeable samples: of each group, the K smallest hashes of its identifiers.

A sketch is the sorted array of the K smallest distinct 64-bit hashes (all of them if there are no more than K, then the
count is exact). Sketches merge by keeping the K smallest of both. With m hashes below the threshold t (a fraction of the
hash range) the count is m / t; its relative standard error is at most 1 / sqrt(K - 2), 3.1 % for K = 1024. Unions,
intersections and differences are counted below the smaller threshold of the two. Bounds are at 95 %.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, HELD_HASHES, MERGE_AT, SALT_FILES, Z = 1024, 4_000_000, 64, 1_024, 1.96
_RANGE = 2.0**64


def bounds(m: int, t: float) -> tuple[float, float, float]:
    """Estimate, lower and upper bound of a count of which m fell below the fraction t of the hash range."""
    if t >= 1:
        return float(m), float(m), float(m)
    spread = Z * Z * (1 - t)
    root = Z * np.sqrt((1 - t) * (m + Z * Z * (1 - t) / 4))
    return m / t, max(float(m), (m + spread / 2 - root) / t), (m + spread / 2 + root + 1) / t


def threshold(sketch: np.ndarray, k: int) -> float:
    return 1.0 if len(sketch) < k else float(sketch[-1]) / _RANGE


def below(sketch: np.ndarray, t: float) -> np.ndarray:
    return sketch if t >= 1 else sketch[: np.searchsorted(sketch, np.uint64(min(t * _RANGE, _RANGE - 2048)))]


def estimate(sketch: np.ndarray, k: int) -> tuple[float, float, float]:
    t = threshold(sketch, k)
    return bounds(len(below(sketch, t)), t)


def merge(parts: list[np.ndarray], k: int) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))[:k]


def _schema(df: DataFrame, groups: list[str]) -> str:
    return ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)


class Combiner:
    """Sketches by group, put out whenever they hold HELD_HASHES; so memory stays bounded, whatever the number of groups."""

    def __init__(self, k: int, groups: list[str], types: list[pa.DataType]) -> None:
        self.k, self.groups, self.types, self.held, self.by = k, groups, types, 0, {}

    def add(self, group: tuple, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        old = self.by.get(group)
        self.by[group] = sketch if old is None else merge([old, sketch], self.k)
        self.held += len(self.by[group]) - (0 if old is None else len(old))
        if self.held > HELD_HASHES:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        items, self.by, self.held = list(self.by.items()), {}, 0
        for i in range(0, len(items), 500):
            part = items[i : i + 500]
            columns = [pa.array([g[c] for g, _ in part], t) for c, t in enumerate(self.types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for _, s in part], pa.binary())], names=[*self.groups, "sketch"])


def _code(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for the group of each row, and the groups by number."""
    seen: dict[tuple, int] = {}
    code = [seen.setdefault(g, len(seen)) for g in zip(*(batch.column(c).to_pylist() for c in range(n)))] if n else [0] * batch.num_rows
    return np.array(code, np.int64), list(seen) if n else [()]


def _from_hashes(batches: Iterator[pa.RecordBatch], groups: list[str], k: int) -> Iterator[pa.RecordBatch]:
    combiner = None
    for batch in batches:
        combiner = combiner or Combiner(k, groups, [f.type for f in batch.schema][:-1])
        lists = batch.column(len(groups))
        if lists.null_count:
            lists = lists.fill_null(pa.scalar([], lists.type))
        code, names = _code(batch, len(groups))
        code = np.repeat(code, np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        there = ~np.asarray(flat.is_null())
        code, h = code[there], flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)[there]
        order = np.lexsort((h, code))
        code, h = code[order], h[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])] if len(h) else np.zeros(0, bool)
        code, h = code[new], h[new]
        cuts = np.searchsorted(code, np.arange(len(names) + 1))
        for i, g in enumerate(names):
            if cuts[i] < cuts[i + 1]:
                yield from combiner.add(g, h[cuts[i] : min(cuts[i + 1], cuts[i] + k)].copy())
    if combiner:
        yield from combiner.rows()


def _merged_groups(batches: Iterator[pa.RecordBatch], groups: list[str], k: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(group, sketch) of rows sorted by group; the parts of a group are merged as they come, so no more than MERGE_AT of them are held."""
    n, now, parts = len(groups), None, []
    for batch in batches:
        for *g, b in zip(*(batch.column(c).to_pylist() for c in range(n + 1))):
            g = tuple(g)
            if g != now:
                if parts:
                    yield now, merge(parts, k)
                now, parts = g, []
            parts.append(np.frombuffer(b, np.uint64))
            if len(parts) > MERGE_AT:
                parts = [merge(parts, k)]
    if parts:
        yield now, merge(parts, k)


def partial_sketches(df: DataFrame, groups: list[str], hashes: Column, k: int = K) -> DataFrame:
    """(groups, sketch): partial sketches, one or more per group and task, of the list column of 64-bit hashes.

    Nulls among the groups are a group of their own; null hashes, null and empty lists add nothing.
    """
    return df.select(*groups, hashes.alias("h")).mapInArrow(lambda b: _from_hashes(b, groups, k), f"{_schema(df, groups)}, sketch BINARY")


def _sketches(partial: DataFrame, groups: list[str], k: int) -> DataFrame:
    """One sketch per group and partition; the rows of a group must lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        out = Combiner(k, groups, [f.type for f in first.schema][:-1])
        for g, sketch in _merged_groups(chain([first], batches), groups, k):
            yield from out.add(g, sketch)
        yield from out.rows()

    return partial.mapInArrow(run, partial.schema)


def _together(partial: DataFrame, groups: list[str], near: list[str], k: int, salts: int) -> DataFrame:
    """Partial sketches, those of one group side by side in the partition of their columns `near`, sorted by these first.

    With `salts` over 1 the parts of a group first meet in so many places, by their task, and leave each as one.
    """
    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts > 1:
        spread = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition(n, *groups, "_salt")
        partial = _sketches(spread.sortWithinPartitions(*groups).select(*partial.columns), groups, k)
    return partial.repartition(n, *near).sortWithinPartitions(*near, *(g for g in groups if g not in near))


def merged_sketches(partial: DataFrame, groups: list[str], near: list[str], k: int = K, salts: int = 1) -> DataFrame:
    """One sketch per group. Partial sketches meet in the partition of their columns `near` (a subset of `groups`); for `salts` see salts_for."""
    return _sketches(_together(partial, groups, near, k, salts), groups, k)


def salts_for(df: DataFrame) -> int:
    """In how many places the partial sketches of one group should meet before they meet in one: one for each SALT_FILES files of `df`."""
    return 1 + len(df.inputFiles()) // SALT_FILES


def rolled_up(partial: DataFrame, groups: list[str], sets: list[list[str]], k: int = K) -> DataFrame:
    """(grouping, groups, sketch): partial sketches of coarser groups; the columns not in a set are null, `grouping` names it."""
    schema = f"grouping STRING, {_schema(partial, groups)}, sketch BINARY"
    keeps = [(",".join(s), [g in s for g in groups]) for s in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = None
        for batch in batches:
            combiner = combiner or Combiner(k, ["grouping", *groups], [pa.string(), *(f.type for f in batch.schema)][:-1])
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(len(groups)))))
            sketches = [np.frombuffer(s, np.uint64) for s in batch.column(len(groups)).to_pylist()]
            for name, keep in keeps:
                together: dict[tuple, list[np.ndarray]] = {}
                for row, s in zip(rows, sketches):
                    together.setdefault((name, *(v if kept else None for v, kept in zip(row, keep))), []).append(s)
                for g, parts in together.items():
                    yield from combiner.add(g, merge(parts, k))
        if combiner:
            yield from combiner.rows()

    return partial.mapInArrow(run, schema)


ESTIMATE = "estimate DOUBLE, lower DOUBLE, upper DOUBLE, hashes INT"


def cube(partial: DataFrame, groups: list[str], near: list[str], sets: list[list[str]], k: int = K, salts: int = 1) -> DataFrame:
    """(grouping, groups, estimate, lower, upper, hashes): the counts for every set of columns; columns not in a set are null, `grouping` names it.

    The partial sketches of `groups` meet by `near`. The sets that hold all of `near` are complete there and go on as
    finished counts; only the sketches of the other sets meet in a second shuffle, merged before it in each task.
    """
    named, types = ["grouping", *groups], _schema(partial, groups)
    inner = [(",".join(s), [g in s for g in groups]) for s in sets if set(near) <= set(s)]
    outer = [(",".join(s), [g in s for g in groups]) for s in sets if not set(near) <= set(s)]
    places = [groups.index(c) for c in near]
    schema = f"grouping STRING, {types}, sketch BINARY, {ESTIMATE}"

    def finished(rows: list[tuple[tuple, np.ndarray]], kinds: list[pa.DataType]) -> pa.RecordBatch:
        e = [(*estimate(s, k), len(s)) for _, s in rows]
        columns = [pa.array([g[c] for g, _ in rows], t) for c, t in enumerate(kinds)] + [pa.nulls(len(rows), pa.binary())]
        columns += [pa.array([x[c] for x in e], pa.float64()) for c in range(3)] + [pa.array([x[3] for x in e], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*named, "sketch", "estimate", "lower", "upper", "hashes"])

    def open_(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(n, pa.float64()) for _ in range(3)), pa.nulls(n, pa.int32())], names=[*named, "sketch", "estimate", "lower", "upper", "hashes"])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = [pa.string(), *(f.type for f in first.schema)][:-1]
        out, now, held, done = Combiner(k, named, kinds), None, {}, []
        for g, sketch in _merged_groups(chain([first], batches), groups, k):
            here = tuple(g[i] for i in places)
            if here != now:
                done += [(key, merge(parts, k)) for key, parts in held.items()]
                now, held = here, {}
                if len(done) > 5_000:
                    yield finished(done, kinds)
                    done = []
            for name, kept in inner:
                parts = held.setdefault((name, *(v if x else None for v, x in zip(g, kept))), [])
                parts.append(sketch)
                if len(parts) > MERGE_AT:
                    parts[:] = [merge(parts, k)]
            for name, kept in outer:
                for batch in out.add((name, *(v if x else None for v, x in zip(g, kept))), sketch):
                    yield open_(batch)
        done += [(key, merge(parts, k)) for key, parts in held.items()]
        yield finished(done, kinds)
        for batch in out.rows():
            yield open_(batch)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows, kinds = None, [], [], []
        for batch in batches:
            kinds = kinds or [f.type for f in batch.schema][: len(named)]
            done = batch.filter(batch.column("sketch").is_null())
            if done.num_rows:
                yield done.drop_columns(["sketch"])
            left = batch.filter(batch.column("sketch").is_valid())
            for *g, b in zip(*(left.column(c).to_pylist() for c in range(len(named) + 1))):
                if tuple(g) != now:
                    if parts:
                        rows.append((now, merge(parts, k)))
                    now, parts = tuple(g), []
                parts.append(np.frombuffer(b, np.uint64))
                if len(parts) > MERGE_AT:
                    parts = [merge(parts, k)]
            if len(rows) > 1_000:
                yield finished(rows, kinds).drop_columns(["sketch"])
                rows = []
        if parts:
            rows.append((now, merge(parts, k)))
        if rows:
            yield finished(rows, kinds).drop_columns(["sketch"])

    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rolled = _together(partial, groups, near, k, salts).mapInArrow(roll, schema)
    return rolled.repartition(n, *named).sortWithinPartitions(*named).mapInArrow(finish, f"grouping STRING, {types}, {ESTIMATE}")


def estimated(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """(groups, estimate, lower, upper, hashes): the counts with their bounds at 95 %, and how many hashes they rest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [np.frombuffer(s, np.uint64) for s in batch.column(len(groups)).to_pylist()]
            e = np.array([estimate(s, k) for s in all_]).reshape(-1, 3)
            columns = [*(batch.column(c) for c in range(len(groups))), *(pa.array(e[:, c]) for c in range(3)), pa.array([len(s) for s in all_], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*groups, "estimate", "lower", "upper", "hashes"])

    return sketches.select(*groups, "sketch").mapInArrow(run, f"{_schema(sketches, groups)}, {ESTIMATE}")


PAIR = ", ".join(f"{name}{end} DOUBLE" for name in ("both", "either", "only_left") for end in ("", "_lower", "_upper"))


def compared(pairs: DataFrame, keep: list[str], left: str, right: str, k: int = K) -> DataFrame:
    """(keep, both, either, only_left, each with _lower and _upper): set sizes of the sketches in two columns. A null sketch is the empty set."""
    names = [c.split()[0] for c in PAIR.split(", ")]

    def sizes(a: bytes | None, b: bytes | None) -> list[float]:
        x, y = (np.frombuffer(s or b"", np.uint64) for s in (a, b))
        t = min(threshold(x, k), threshold(y, k))
        x, y = below(x, t), below(y, t)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [v for m in (both, len(x) + len(y) - both, len(x) - both) for v in bounds(m, t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            v = np.array([sizes(a, b) for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n)), *(pa.array(v[:, c]) for c in range(len(names)))], names=[*keep, *names])

    return pairs.select(*keep, left, right).mapInArrow(run, f"{_schema(pairs, keep)}, {PAIR}")


def hashed(values: str) -> Column:
    """The hashes of a list column of identifiers, for partial_sketches."""
    hash_: Callable[[Column], Column] = lambda x: F.when(x.isNotNull(), F.xxhash64(x))
    return F.transform(values, hash_)
