"""Canonical k-mers counted in the tasks, as sorted numbers in packed runs, so that no window is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import lookup

HELD = 1 << 22
PARTS = 64
ROWS = 64
BLOCK = 1 << 17
MIX = 0x9E3779B97F4A7C15


def strands_of(d: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """As lookup.numbers_of, with two bits a letter."""
    for first in range(0, len(d) - k + 1, BLOCK):
        part = d[first : first + BLOCK + k - 1]
        one = ((part - 1) & 3).astype(np.uint64)
        other, size, have = 3 - one, 1, 0
        forward = backward = np.zeros(len(part) + 1, np.uint64)
        while size <= k:  # one and other hold stretches of `size` letters, forward and backward of `have`
            if k & size:
                n = len(part) - have - size + 1
                forward = forward[:n] << np.uint64(2 * size) | one[have : have + n]
                backward = backward[:n] | other[have : have + n] << np.uint64(2 * have)
                have += size
            one, other = one[:-size] << np.uint64(2 * size) | one[size:], other[:-size] | other[size:] << np.uint64(2 * size)
            size *= 2
        bad = np.r_[0, np.cumsum(part == 9)]
        yield first, forward, backward, bad[k:] == bad[:-k]


def codes_of(d: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The canonical k-mers of the digits `d`, two bits a letter, in blocks; without those that hold another letter."""
    for _, forward, backward, plain in strands_of(d, k):
        yield np.minimum(forward, backward)[plain]


class Trusted:
    """Trusted k-mers with two bits a letter, in the order of a hash that no two share; a table of bytes by hash passes over most others."""

    def __init__(self, spectrum: lookup.Spectrum, k: int) -> None:
        codes, rest = np.zeros(len(spectrum.keys), np.uint64), spectrum.keys.copy()
        for i in range(k):
            codes |= (rest % 10 - 1).astype(np.uint64) << np.uint64(2 * i)
            rest //= 10
        hashes = codes * np.uint64(MIX)
        order = np.argsort(hashes)
        self.hashes, self.multiplicity = np.r_[hashes[order], np.uint64(2**64 - 1)], np.r_[spectrum.multiplicity[order].astype(np.int64), 0]
        wide, bits = min(26, max(16, (len(codes) * 16).bit_length())), max(1, len(codes).bit_length())
        self.shift, self.low = np.uint64(64 - wide), np.uint64(64 - bits)
        self.told = np.zeros(1 << wide, bool)
        self.told[hashes >> self.shift] = True
        self.first = np.r_[0, np.cumsum(np.bincount((hashes >> self.low).astype(np.int64), minlength=1 << bits))].astype(np.int32)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ones are trusted, and their multiplicities."""
        hashes = codes * np.uint64(MIX)
        i = np.nonzero(self.told[hashes >> self.shift])[0]
        hashes = hashes[i]
        at = self.first[hashes >> self.low]
        on = np.nonzero(self.hashes[at] < hashes)[0]
        while len(on):
            at[on] += 1
            on = on[self.hashes[at[on]] < hashes[on]]
        hit = np.nonzero((self.hashes[at] == hashes) & (self.multiplicity[at] > 0))[0]
        return i[hit], self.multiplicity[at[hit]]

    def changes(self, d: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, at, digit, multiplicity, backward) of the changes of the untrusted windows of the digits `d`; all 3 x k changes of each are tried."""
        for first, forward, backward, weak in strands_of(d, k):
            plain = np.nonzero(weak)[0]
            weak[plain[self.hits(np.minimum(forward[plain], backward[plain]))[0]]] = False
            i = np.nonzero(weak)[0]
            f, b = forward[i], backward[i]
            for at in range(k):
                up, down = np.uint64(2 * (k - 1 - at)), np.uint64(2 * at)
                for turn in np.arange(1, 4, dtype=np.uint64):
                    hit, multiplicity = self.hits(np.minimum(f ^ turn << up, b ^ turn << down))
                    if len(hit):
                        yield first + i[hit], at, ((f[hit] >> up & np.uint64(3)) ^ turn).astype(np.int64) + 1, multiplicity, b[hit] <= f[hit]


def numbers_of_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The keys of k-mers of two bits a letter."""
    keys, rest = np.zeros(len(codes), np.int64), codes.astype(np.int64)
    for i in range(k):
        keys += ((rest & 3) + 1) * 10**i
        rest >>= 2
    return keys


def pack(held: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, width, gaps, counts) of the distinct ones of the mixed codes `held`: the bytes of their distances, all lowest ones first, and their numbers, no more than 255."""
    codes = np.concatenate(held)
    codes.sort()
    starts = np.nonzero(np.r_[True, codes[1:] != codes[:-1]])[0] if len(codes) else np.zeros(0, int)
    n = np.minimum(np.diff(np.r_[starts, len(codes)]), 255).astype(np.uint8)
    codes = codes[starts]
    cuts, rows = np.searchsorted(codes, edges), []
    for part in np.nonzero(np.diff(cuts))[0].tolist():
        own = slice(cuts[part], cuts[part + 1])
        gaps = np.diff(np.r_[edges[part], codes[own]])
        width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
        rows.append((part, width, np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), n[own].tobytes()))
        if len(rows) == ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "width": pa.int32(), "gaps": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())], names=list(kinds))


def unpack(width: int, gaps: bytes, counts: bytes, edge: np.uint64) -> np.ndarray:
    """The mixed codes of a row, each with its number in the lowest byte."""
    whole = np.zeros((len(counts), 8), np.uint8)
    whole[:, :width] = np.frombuffer(gaps, np.uint8).reshape(width, -1).T
    return (np.cumsum(whole.view("<u8").ravel(), dtype=np.uint64) + edge) << np.uint64(8) | np.frombuffer(counts, np.uint8)


def counted(reads: DataFrame, k: int = B.K, least: int = 1) -> DataFrame:
    """(key, multiplicity): the same as kmers.counted, for k up to 18.

    A task sorts HELD windows at a time. The distinct ones go on as packed runs, a few bytes each, cut into parts of the
    mixed codes: PARTS for each partition of the shuffle, and one part at a time is added up.
    """
    parts, room = PARTS * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4**k
    edges = np.array([-(-i * room // parts) for i in range(parts + 1)], np.uint64)
    mask, mix, back = np.uint64(room - 1), np.uint64(MIX % room), np.uint64(pow(MIX, -1, room))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for codes in codes_of(lookup.digits_of("\n".join(batch.column(0).to_pylist())), k):
                held.append(codes * mix & mask)
                size += len(codes)
                if size >= HELD:
                    yield from pack(held, edges)
                    held, size = [], 0
        if size:
            yield from pack(held, edges)

    def summed(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        runs = np.concatenate([unpack(*row, edges[part]) for row in rows])
        runs.sort()
        codes = runs >> np.uint64(8)
        starts = np.nonzero(np.r_[True, codes[1:] != codes[:-1]])[0]
        n = np.add.reduceat((runs & np.uint64(255)).astype(np.int64), starts)
        often = n >= least
        keys = numbers_of_codes(codes[starts[often]] * back & mask, k)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.minimum(n[often], 255).astype(np.int32))], names=["key", "multiplicity"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = -1, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at and rows:
                    yield summed(at, rows)
                    rows = []
                at = part
                rows.append(row)
        if rows:
            yield summed(at, rows)

    runs = reads.select("seq").where(F.length("seq") >= k).mapInArrow(packed, "part INT, width INT, gaps BINARY, counts BINARY")
    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "key LONG, multiplicity INT")
