"""The trusted spectrum as two sorted arrays in each task, for work that goes read by read in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.tables import stage

BROADCAST_KMERS = 20_000_000
NEAR_KMERS = 5_000_000
NEAR_TABLE_KMERS = 200_000
BLOCK = 1 << 20
MIXES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
DIGIT = {**dict.fromkeys(B.AMBIGUOUS, "1"), "A": "1", "C": "2", "G": "3", "T": "4"}
PAIR = str.maketrans("1234", "4321")
_DIGIT_OF_BYTE = np.full(256, 9, np.int64)
for _letter, _digit in DIGIT.items():
    _DIGIT_OF_BYTE[ord(_letter)] = int(_digit)


def key_of(kmer: str) -> int:
    """The canonical key of a k-mer of digits; one with a 9 (another letter) is in no spectrum."""
    return int(min(kmer, kmer.translate(PAIR)[::-1]))


def digits_of(seq: str) -> np.ndarray:
    """The letters of a read as digits, 9 for other letters."""
    return _DIGIT_OF_BYTE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


COMPLEMENT = np.array([0, 4, 3, 2, 1, 5, 6, 7, 8, 9])


def keys_of(windows: np.ndarray) -> np.ndarray:
    """The canonical keys of k-mers given as rows of digits."""
    power = 10 ** np.arange(windows.shape[1] - 1, -1, -1, dtype=np.int64)
    return np.minimum(windows @ power, COMPLEMENT[windows] @ power[::-1])


def numbers_of(d: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, forward, backward, plain) of all k-mers of the digits `d`, in blocks: as they stand and of the other strand, as numbers, and whether all their letters are A, C, G or T."""
    for first in range(0, len(d) - k + 1, BLOCK):
        part = d[first : first + BLOCK + k - 1]
        n, other = len(part) - k + 1, COMPLEMENT[part]
        forward, backward, bad = np.zeros(n, np.int64), np.zeros(n, np.int64), np.r_[0, np.cumsum(part == 9)]
        for i in range(k):
            forward = forward * 10 + part[i : i + n]
            backward += other[i : i + n] * 10**i
        yield first, forward, backward, bad[k:] == bad[:-k]


class Near:
    """K-mers, as numbers of digits, that differ from a trusted one in one place: a table of bytes by two hashes tells all of these, and some others."""

    def __init__(self, keys: np.ndarray, k: int) -> None:
        self.shift = np.uint64(64 - min(26, max(16, (len(keys) * k * 6 * 8).bit_length())))
        self.told = np.zeros(1 << (64 - int(self.shift)), bool)
        backward, rest = np.zeros(len(keys), np.int64), keys.copy()
        for _ in range(k):
            backward, rest = backward * 10 + COMPLEMENT[rest % 10], rest // 10
        for strand in (keys, backward):
            for changed, *_ in changed_ones(strand, k):
                for mix in MIXES:
                    self.told[self._hash(changed, mix)] = True

    def _hash(self, kmers: np.ndarray, mix: np.uint64) -> np.ndarray:
        return (kmers.astype(np.uint64) * mix) >> self.shift

    def changes(self, d: np.ndarray, k: int, trusted: Spectrum) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, at, digit, multiplicity, backward) of the changes of the untrusted windows of the digits `d`; only those told here are changed."""
        for first, forward, backward, plain in numbers_of(d, k):
            i = np.nonzero(plain)[0]
            i = i[self.many(forward[i])]
            i = i[trusted.many(np.minimum(forward[i], backward[i])) == 0]
            for changed, at, digit, step in changed_ones(forward[i], k):
                multiplicity = trusted.many(np.minimum(changed, backward[i] - step * 10**at))
                hit = np.nonzero(multiplicity)[0]
                if len(hit):
                    yield first + i[hit], at, digit[hit], multiplicity[hit], (backward[i] <= forward[i])[hit]

    def many(self, kmers: np.ndarray) -> np.ndarray:
        told = self.told[self._hash(kmers, MIXES[0])]
        first = np.nonzero(told)[0]
        told[first] = self.told[self._hash(kmers[first], MIXES[1])]
        return told


def changed_ones(kmers: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(changed, at, digit, step): k-mers given as numbers with another digit at `at`, `step` more than the one there; all 3 x k changes."""
    for at in range(k):
        power = 10 ** (k - 1 - at)
        own = kmers // power % 10
        for turn in (1, 2, 3):
            digit = (own - 1 + turn) % 4 + 1
            yield kmers + (digit - own) * power, at, digit, digit - own


class Spectrum:
    """Trusted k-mers as sorted keys with their multiplicities."""

    asks = False

    def __init__(self, keys: np.ndarray, multiplicity: np.ndarray, in_order: bool = False) -> None:
        if not in_order:
            order = np.argsort(keys)
            keys, multiplicity = keys[order], multiplicity[order]
        self.keys, self.multiplicity = keys, multiplicity

    def many(self, keys: np.ndarray, guess: int = 0) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.multiplicity[i].astype(np.int64), 0)

    def settle(self) -> None:
        """Whether all that was asked is known: here always."""


def covered(hit: np.ndarray, k: int) -> np.ndarray:
    """Which bases of a read a trusted k-mer covers, by the starts of these."""
    ends = np.cumsum(np.r_[hit, np.zeros(k - 1, int)])
    return ends - np.r_[np.zeros(k, int), np.cumsum(hit)[:-1]][: len(ends)] > 0


def schema_of(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def shared_spectrum(spectrum: DataFrame) -> Broadcast:
    """The spectrum as two arrays for the tasks, sorted here once."""
    table = spectrum.toArrow()
    keys, multiplicity = table["key"].to_numpy(), table["multiplicity"].to_numpy()
    order = np.argsort(keys)
    return spectrum.sparkSession.sparkContext.broadcast((keys[order], multiplicity[order].astype(np.uint8)))


def small_spectrum(spectrum: DataFrame, most: int | None = None) -> tuple[DataFrame, Broadcast | None]:
    """The spectrum (key, multiplicity), staged, and its arrays for the tasks if it has no more than `most` k-mers (BROADCAST_KMERS; 9 bytes each)."""
    held = stage(spectrum.select("key", F.col("multiplicity").cast("int").alias("multiplicity")), "spectrum")
    return held, shared_spectrum(held) if held.count() <= (BROADCAST_KMERS if most is None else most) else None
