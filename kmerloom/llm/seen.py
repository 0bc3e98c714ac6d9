"""Has this key been seen before? Every later occurrence of a key, in order of arrival, without holding all earlier keys.

Keys are 64-bit hashes of (scope, value), spread over shards by hash. A first pass inside each task finds the repeats
within a generation, a range of arrival numbers; they need no further look, and a hot key leaves one row a batch and
generation at most. What is left goes to its shard in packets sorted by generation. A shard reads its generations in
order: the newest keys are held exactly until SEAL of them are there, and at least a GROW-th of all keys so far, then they
are sealed into a ribbon filter. So a shard has filters from SEAL keys on, and their number grows with the logarithm of
the keys. A key that neither the held keys nor any sealed filter knows is new.

Wrong answers: a key is never missed. A new key is taken for an old one with a chance of 2 ** -bits for each sealed
filter of its shard, and if its hash equals that of another key (`hash_clash_rate` of the audit: 63 bits count). Hashes of
real keys are even; odd ones are certainly absent, and the audit counts how many of them the filters claim to know.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.ribbon import Ribbon

BITS, SEAL, GROW, ASK, GENERATION_ROWS, MOST_GENERATIONS, AUDIT_KEYS = 32, 1 << 12, 4, 16, 512, 4096, 20_000
PACKET_ROWS = 200


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    shard, generation, keys, arrivals, places = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(generation, pa.int32()), _lists(keys, pa.int64()), _lists(arrivals, pa.int64()), _lists(places, pa.int32())],
        names=["shard", "generation", "keys", "arrivals", "places"],
    )


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key (stable), and whether each of that order is its key's first."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)


def _first_pass(batches: Iterator[pa.RecordBatch], lowest: int, width: int, shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrival = batch.column(0).to_numpy()
        lists = batch.column(1)
        size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        if lists.null_count:
            lists = lists.fill_null(pa.scalar([], lists.type))
            size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        rows = np.repeat(np.arange(len(size)), size)
        place = (np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        there = ~np.asarray(flat.is_null())
        keys = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) & ~np.uint64(1)
        keys, rows, place = keys[there], rows[there], place[there]
        by = np.argsort(arrival, kind="stable")
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by))
        if len(by) and (np.diff(by) < 0).any():
            o = np.argsort(turn[rows], kind="stable")
            keys, rows, place = keys[o], rows[o], place[o]
        made = (arrival[rows] - lowest) // width
        order = np.lexsort((made, keys))
        first = np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(made[order]) != 0)] if len(order) else np.zeros(0, bool)
        again, new = np.sort(order[~first]), np.sort(order[first])
        out = []
        if len(again):
            out.append((int(again[0]) % shards, -1, keys[:0].view(np.int64), arrival[rows[again]], place[again]))
        k, a, p, generation = keys[new], arrival[rows[new]], place[new], made[new]
        shard = (k >> np.uint64(33)) % np.uint64(shards)
        o = np.lexsort((generation, shard))
        k, a, p, shard, generation = k[o], a[o], p[o], shard[o].astype(np.int64), generation[o]
        cuts = np.nonzero(np.r_[True, (shard[1:] != shard[:-1]) | (generation[1:] != generation[:-1])])[0] if len(k) else []
        for i, j in zip(cuts, [*cuts[1:], len(k)]):
            out.append((int(shard[i]), int(generation[i]), k[i:j].view(np.int64), a[i:j], p[i:j]))
        for i in range(0, len(out), PACKET_ROWS):
            yield _packets(out[i : i + PACKET_ROWS])


class Shard:
    """The keys of one shard so far."""

    def __init__(self, bits: int, seal: int) -> None:
        self.seal = seal
        self.bits, self.sealed, self.held, self.keys = bits, [], np.zeros(0, np.uint64), 0
        self.by_held = self.by_filters = 0

    def new_among(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct keys, which were not seen; they are now."""
        new = np.ones(len(keys), bool)
        if len(self.held):
            i = np.minimum(np.searchsorted(self.held, keys), len(self.held) - 1)
            new = self.held[i] != keys
            self.by_held += int((~new).sum())
        asked = int(new.sum())
        for ribbon in self.sealed:
            left = np.nonzero(new)[0]
            new[left] = ~ribbon.has(keys[left])
        self.by_filters += asked - int(new.sum())
        self.held = np.union1d(self.held, keys[new])
        self.keys += int(new.sum())
        if len(self.held) >= max(self.seal, self.keys // GROW):
            self.sealed.append(Ribbon(self.held, self.bits))
            self.held = self.held[:0]
        return new

    def audit(self, seed: int, shards: int) -> tuple:
        """The row of AUDIT for this shard, of the filters that gave its answers."""
        absent = np.random.default_rng(seed).integers(0, 2**64, AUDIT_KEYS, dtype=np.uint64) | np.uint64(1)
        wrong = np.zeros(len(absent), bool)
        for ribbon in self.sealed:
            wrong |= ribbon.has(absent)
        size = sum(r.bytes() for r in self.sealed)
        return seed, self.keys, len(self.sealed), size, len(self.held), self.by_filters, self.by_held, AUDIT_KEYS, int(wrong.sum()), self.keys * shards / 2.0**63


def _generations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, generation, keys, arrivals, places), the packets of one generation of a shard put together."""
    at, held = None, []
    for batch in batches:
        shard, generation = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if (shard[i], generation[i]) != at or at[1] < 0:
                if held:
                    yield (*at, *(np.concatenate(x) for x in zip(*held)))
                at, held = (shard[i], generation[i]), []
            held.append(tuple(batch.column(c)[i].values.to_numpy() for c in (2, 3, 4)))
    if held:
        yield (*at, *(np.concatenate(x) for x in zip(*held)))


def _second_pass(batches: Iterator[pa.RecordBatch], bits: int, seal: int, shards: int, audit: bool) -> Iterator[pa.RecordBatch]:
    """Generations are asked about together until they hold SEAL keys, or an ASK-th of all so far: their own repeats are found by sorting."""
    now, state, waiting, size = None, None, [], 0

    def asked() -> Iterator[pa.RecordBatch]:
        if not waiting:
            return
        keys, arrivals, places = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        o = np.lexsort((places, arrivals))
        keys, arrivals, places = keys.view(np.uint64)[o], arrivals[o], places[o]
        order, first = _split(keys)
        firsts = order[first]
        old = np.r_[order[~first], firsts[~state.new_among(keys[firsts])]]
        yield from given(arrivals[old], places[old])

    def given(a: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not audit:
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000], pa.int64()), pa.array(p[i : i + 50_000], pa.int32())], names=["arrival_no", "pos"])

    for shard, generation, keys, arrivals, places in _generations(batches):
        if generation < 0:
            yield from given(arrivals, places)
            continue
        if shard != now:
            yield from asked()
            if audit and state:
                yield _audited(state.audit(now, shards))
            now, state, size = shard, Shard(bits, seal), 0
        waiting.append((keys, arrivals, places))
        size += len(keys)
        if size >= max(seal, state.keys // ASK):
            yield from asked()
            size = 0
    yield from asked()
    if audit and state:
        yield _audited(state.audit(now, shards))


AUDIT = "shard INT, keys BIGINT, filters INT, filter_bytes BIGINT, held BIGINT, seen_by_filters BIGINT, seen_by_held BIGINT, absent_probed BIGINT, absent_claimed BIGINT, hash_clash_rate DOUBLE"


def _audited(row: tuple) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in AUDIT.split(", ")])


def seen_before(df: DataFrame, arrival: str, scope: str, values: str, bits: int = BITS, audit: bool = False) -> DataFrame:
    """(arrival_no, pos): the elements of the list column `values` that occur earlier in the same `scope`.

    Earlier: in a row with a smaller `arrival`, or at a smaller position of the same row. `arrival` must be a unique
    whole number, not null (a row without it is left out). A null scope is a scope of its own; null elements, null and
    empty lists give nothing. With `audit`, one row per shard instead (AUDIT): its distinct keys, the filters, their size,
    the keys still held exactly, how many repeats of earlier generations the filters and the held keys told, how many
    certainly absent keys were probed and how many wrongly claimed, and the chance that a new key's hash is another's.
    """
    spark, seal = df.sparkSession, SEAL
    rows = df.where(F.col(arrival).isNotNull())
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    low, high = low or 0, high or 0
    width = max(GENERATION_ROWS, -(-(high - low + 1) // MOST_GENERATIONS))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = F.coalesce(F.concat(F.lit("s"), F.col(scope).cast("string")), F.lit("n"))
    hashed = F.transform(values, lambda x: F.when(x.isNotNull(), F.xxhash64(tag, x)))
    packets = rows.select(F.col(arrival).cast("long"), hashed).mapInArrow(
        lambda b: _first_pass(b, low, width, shards), "shard INT, generation INT, keys ARRAY<BIGINT>, arrivals ARRAY<BIGINT>, places ARRAY<INT>"
    )
    at_home = packets.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "generation")
    return at_home.mapInArrow(lambda b: _second_pass(b, bits, seal, shards, audit), AUDIT if audit else "arrival_no BIGINT, pos INT")
