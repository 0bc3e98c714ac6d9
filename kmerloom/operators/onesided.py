"""One-sided correction: from each trusted region outward, base by base, with voting in between.

The walk of a read looks at k-mers that depend on its own changes, so it can't be a join. It runs in Arrow batches
against the trusted spectrum, which a task has as two sorted arrays (`Spectrum`). A spectrum that is too large for that is
asked by joins instead (`corrected_by_joins`): each distinct read first gets the multiplicities of its windows and of all
trusted k-mers one change away from an untrusted one, which is all that most walks look at. A walk that needs another
k-mer notes it, guesses and goes on to the end of its pass, noting what else it would need; the noted k-mers of all reads
are looked up at once, and the walks start over, until none is open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import kmers, lookup, mutations
from kmerloom.operators.lookup import DIGIT as _DIGIT
from kmerloom.operators.lookup import PAIR as _PAIR
from kmerloom.operators.lookup import Spectrum, digits_of, key_of, schema_of, shared_spectrum
from kmerloom.tables import stage

ROUNDS, LEAST_VOTES, BROADCAST_KMERS = 4, 3, lookup.BROADCAST_KMERS
_LETTER = dict(zip(B.DIGITS, B.LETTERS))


class Unknown(Exception):
    """The multiplicities of these keys are needed."""

    def __init__(self, keys: list[int]) -> None:
        super().__init__()
        self.keys = keys


class Asked(Spectrum):
    """Multiplicities known from joins: those of `keys`, and 0 for all others among `told`. Keys that are neither are noted in `wanted` and guessed."""

    asks = True

    def __init__(self, keys: np.ndarray, multiplicity: np.ndarray, told: np.ndarray) -> None:
        super().__init__(keys, multiplicity)
        self.told, self.wanted = told, set()

    def many(self, keys: np.ndarray, guess: int = 0) -> np.ndarray:
        found = super().many(keys)
        unknown = found == 0
        if len(self.told) and unknown.any():
            i = np.minimum(np.searchsorted(self.told, keys), len(self.told) - 1)
            unknown &= self.told[i] != keys
        if unknown.any():
            self.wanted.update(keys[unknown].tolist())
            found = np.where(unknown, guess, found)
        return found

    def settle(self) -> None:
        if self.wanted:
            raise Unknown(sorted(self.wanted))


class Read:
    """A read under correction; `digits` holds its letters as digits (9: other letters), for lookups only."""

    def __init__(self, seq: str, k: int, spectrum: Spectrum) -> None:
        self.seq, self.k, self.spectrum = list(seq), k, spectrum

    def digits(self) -> str:
        return "".join(_DIGIT.get(c, "9") for c in self.seq)

    def multiplicities(self, kmers: list[str], guess: int = 0) -> np.ndarray:
        return self.spectrum.many(np.array([key_of(x) for x in kmers], np.int64), guess)

    def corrected(self) -> str:
        k = self.k
        if len(self.seq) < k:
            return "".join(self.seq)
        for allowed in range(1, ROUNDS + 1):
            for longest_first in (True, False):
                found = self.one_sided(allowed, ROUNDS + 1 - allowed, longest_first)
                self.spectrum.settle()
                if found is None:
                    return "".join(self.seq)
                if not found:
                    break
                for at, digit in found:
                    self.seq[at] = _LETTER[digit]
            most, changes = self.vote()
            self.spectrum.settle()
            if most == 0:
                break
            if most >= LEAST_VOTES:
                for at, digit in changes:
                    self.seq[at] = _LETTER[digit]
        return "".join(self.seq)

    def one_sided(self, allowed: int, ahead: int, longest_first: bool) -> list[tuple[int, str]] | None:
        """Changes (place, digit) in the order they are made; None if every base is solid."""
        text, k = self.digits(), self.k
        n = len(text) - k + 1
        hit = self.multiplicities([text[i : i + k] for i in range(n)]) > 0
        covered = np.cumsum(np.r_[hit, np.zeros(k - 1, int)]) - np.r_[np.zeros(k, int), np.cumsum(hit)[:-1]][: len(text)]
        solid = covered > 0
        if solid.all():
            return None
        change = np.diff(np.r_[0, hit.astype(int), 0])
        regions = list(zip(np.nonzero(change == 1)[0].tolist(), (np.nonzero(change == -1)[0] - 1).tolist()))
        regions.sort(key=lambda r: (r[0] - r[1]) if longest_first else (r[1] - r[0]))
        log: list[tuple[int, str]] = []
        for low, high in regions:
            work = list(text)
            right = self.walk(work, range(high + 1, n), k - 1, solid, allowed, ahead, -1)
            # The left walk counts its changes from the right one's first, however that one ended.
            left = self.walk(work, range(low - 1, -1, -1), 0, solid, allowed, ahead, right[1])
            log += right[0] + left[0]
        return log

    def walk(self, work: list[str], starts: range, end: int, solid: np.ndarray, allowed: int, ahead: int, anchor: int) -> tuple[list, int]:
        """The changes of one walk over k-mer starts, each at place `end` of its k-mer, and the place of the first ever made."""
        k, made, first, count = self.k, [], -1, 0
        for s in starts:
            at = s + end
            if solid[at]:
                break
            kmer = "".join(work[s : s + k])
            if self.multiplicities([kmer], guess=1)[0]:
                if self.spectrum.asks and key_of(kmer) in self.spectrum.wanted:
                    self.choice(work, kmer, s, at, end, ahead)  # in case that it isn't trusted
                continue
            digit = self.choice(work, kmer, s, at, end, ahead)
            if digit is None:
                break
            work[at] = digit
            made.append((at, digit))
            first = at if first < 0 else first
            anchor = at if anchor < 0 else anchor
            if abs(at - anchor) < k:
                count += 1
                if count > allowed:
                    del made[len(made) - count :]
                    break
            else:
                anchor, count = at, 0
        return made, first

    def choice(self, work: list[str], kmer: str, s: int, at: int, end: int, ahead: int) -> str | None:
        """The digit that makes the k-mer trusted; of several that the k-mers around confirm, the most frequent."""
        others = [d for d in "1234" if d != kmer[end]]
        if kmer.translate(_PAIR)[::-1] <= kmer:  # ties go by the order on the canonical strand
            others.reverse()
        found = self.multiplicities([kmer[:end] + d + kmer[end + 1 :] for d in others])
        options = [(d, int(m)) for d, m in zip(others, found) if m > 0]
        if self.spectrum.asks and self.spectrum.wanted:
            for d in others:
                self.confirmed(work, s, at, d, end, ahead)
        if len(options) <= 1:
            return options[0][0] if options else None
        best, most = None, 0
        for d, m in options:
            if m > most and self.confirmed(work, s, at, d, end, ahead):
                best, most = d, m
        return best

    def confirmed(self, work: list[str], s: int, at: int, digit: str, end: int, ahead: int) -> bool:
        k = self.k
        if end:  # to the right
            rest = len(work) - s - 1
            if rest < k or ahead <= 0:
                return True
            near = range(s + 1, s + 2 + min(rest - k, ahead - 1))
        else:  # to the left; the k-mer next to it is left out
            if at - 1 <= 0 or ahead <= 0:
                return True
            near = range(at - 2, max(0, at - 1 - ahead) - 1, -1)
        kmers = []
        for i in near:
            window = work[i : i + k]
            if at - i < k:
                window[at - i] = digit
            kmers.append("".join(window))
        return bool((self.multiplicities(kmers) > 0).all()) if kmers else True

    def vote(self) -> tuple[int, list[tuple[int, str]]]:
        """The most votes that one change gets, and the changes to make."""
        text, k = self.digits(), self.k
        n = len(text) - k + 1
        d = np.lib.stride_tricks.sliding_window_view(np.array(list(map(int, text)), np.int64), k)
        comp = np.array([0, 4, 3, 2, 1, 5, 6, 7, 8, 9])
        power = 10 ** np.arange(k - 1, -1, -1, dtype=np.int64)
        forward, backward = d @ power, comp[d] @ power[::-1]
        weak = np.nonzero(self.spectrum.many(np.minimum(forward, backward)) == 0)[0]
        d = d[weak][:, :, None]
        base = np.array([1, 2, 3, 4])
        f = forward[weak][:, None, None] + (base - d) * power[None, :, None]
        b = backward[weak][:, None, None] + (comp[base] - comp[d]) * power[::-1][None, :, None]
        tried = np.broadcast_to(base, f.shape) != d
        i, j, c = np.nonzero(tried)
        hit = self.spectrum.many(np.minimum(f[i, j, c], b[i, j, c])) > 0
        votes = np.zeros((len(text), 4), np.int64)
        np.add.at(votes, (weak[i[hit]] + j[hit], c[hit]), 1)
        most = int(votes.max()) if n > 0 else 0
        changes = []
        for at in np.nonzero((votes == most).any(1))[0] if most else []:
            tied = np.nonzero(votes[at] == most)[0]
            if len(tied) != 2:  # two tied bases cancel out, of three the last stays
                changes.append((int(at), str(tied[-1] + 1)))
        return most, changes


def _weak_reads(seqs: list[str | None], k: int, spectrum: Spectrum) -> np.ndarray:
    """Which reads have to be walked; all k-mers of the batch are looked up at once.

    Not those whose every base is covered by a trusted k-mer, nor those without a trusted k-mer of which no single change
    would make one: there a walk has no start and a vote no result.
    """
    out = np.zeros(len(seqs), bool)
    table = np.full(256, 9, np.int64)
    for c, d in _DIGIT.items():
        table[ord(c)] = int(d)
    comp = np.array([0, 4, 3, 2, 1, 5, 6, 7, 8, 9])
    raw = [(s or "").encode("ascii", "replace") for s in seqs]
    size = np.array([len(r) for r in raw])
    d = table[np.frombuffer(b"".join(raw) + b"." * k, np.uint8)]
    power = 10 ** np.arange(k - 1, -1, -1, dtype=np.int64)
    n = len(d) - k
    forward = sum(d[i : i + n] * power[i] for i in range(k))
    backward = sum(comp[d[i : i + n]] * power[k - 1 - i] for i in range(k))
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(seqs)), size)
    whole = np.arange(n) + k <= np.repeat(begin + size, size)
    hit = (spectrum.many(np.minimum(forward, backward)) > 0) & whole
    c = np.r_[0, np.cumsum(hit)]
    at = np.arange(n)
    first = np.maximum(at - k + 1, np.repeat(begin, size))
    weak = c[at + 1] - c[first] == 0
    out[row[weak]] = True
    out &= size >= k
    anchored = np.zeros(len(seqs), bool)
    anchored[row[hit]] = True
    lone = np.nonzero(whole & (out & ~anchored)[row])[0]
    f, b, mates = forward[lone], backward[lone], np.zeros(len(seqs), bool)
    for i in range(k):
        was = d[lone + i]
        for base in range(1, 5):
            near = np.minimum(f + (base - was) * power[i], b + (comp[base] - comp[was]) * power[k - 1 - i])
            mates[row[lone[(spectrum.many(near) > 0) & (was != base)]]] = True
    return out & (anchored | mates)


def _correct(batches: Iterator[pa.RecordBatch], k: int, get: Callable[[], Spectrum]) -> Iterator[pa.RecordBatch]:
    spectrum = get()
    for batch in batches:
        seqs = batch.column(batch.num_columns - 1).to_pylist()
        if batch.num_rows:
            for i in np.nonzero(_weak_reads(seqs, k, spectrum))[0]:
                seqs[i] = Read(seqs[i], k, spectrum).corrected()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seqs, pa.string())], names=[*batch.schema.names[:-1], "corrected"])


def corrected(reads: DataFrame, trusted: DataFrame, keep: list[str], k: int = B.K) -> DataFrame:
    """(keep, corrected): reads after the correction; no shuffle of the reads.

    Null reads stay null, reads shorter than k and reads whose every base is solid stay as they are, so do all letters
    that need no change. `trusted` (key, multiplicity) is sent to the tasks if it has no more than BROADCAST_KMERS rows
    (9 bytes each); a larger one is asked by joins.
    """
    spectrum = stage(trusted.select("key", F.col("multiplicity").cast("int").alias("multiplicity")), "spectrum")
    if spectrum.count() > BROADCAST_KMERS:
        return corrected_by_joins(reads, spectrum, keep, k)
    shared = shared_spectrum(spectrum)
    return reads.select(*keep, "seq").mapInArrow(lambda b: _correct(b, k, lambda: Spectrum(*shared.value, in_order=True)), f"{schema_of(reads, keep)}, corrected STRING")


def pass_codes(reads: DataFrame, trusted: DataFrame, keep: list[str], k: int = B.K) -> DataFrame:
    """(keep, code) of the first pass over reads of k letters or more: -1 if every base is solid, else the number of changes it logs."""
    shared = shared_spectrum(stage(trusted.select("key", F.col("multiplicity").cast("int").alias("multiplicity")), "spectrum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(*shared.value, in_order=True)
        for batch in batches:
            logs = [Read(s, k, spectrum).one_sided(1, ROUNDS, True) for s in batch.column(batch.num_columns - 1).to_pylist()]
            codes = pa.array([-1 if log is None else len(log) for log in logs], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=[*batch.schema.names[:-1], "code"])

    return reads.where(F.length("seq") >= k).select(*keep, "seq").mapInArrow(run, f"{schema_of(reads, keep)}, code INT")


def _told(seq: str, k: int, trusted: np.ndarray) -> np.ndarray:
    """The keys of a read's windows and of all k-mers one change away from those that aren't among the `trusted`, sorted."""
    d = digits_of(seq)
    windows = np.lib.stride_tricks.sliding_window_view(d, k)
    comp = np.array([0, 4, 3, 2, 1, 5, 6, 7, 8, 9])
    power = 10 ** np.arange(k - 1, -1, -1, dtype=np.int64)
    base = np.array([1, 2, 3, 4])
    own = np.minimum(windows @ power, comp[windows] @ power[::-1])
    weak = windows[~np.isin(own, trusted)]
    f = (weak @ power)[:, None, None] + (base - weak[:, :, None]) * power[None, :, None]
    b = (comp[weak] @ power[::-1])[:, None, None] + (comp[base] - comp[weak][:, :, None]) * power[::-1][None, :, None]
    return np.unique(np.r_[np.minimum(f, b).ravel(), own])


_STATE = "id BIGINT, seq STRING, keys ARRAY<BIGINT>, counts ARRAY<INT>, told ARRAY<BIGINT>"


def _attempt(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, ask = [], []
        for _, seq, keys, counts, told in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                known = np.array(keys, np.int64)
                near = np.union1d(_told(seq, k, known), np.array(told, np.int64))
                done.append(Read(seq, k, Asked(known, np.array(counts, np.int64), near)).corrected())
                ask.append([])
            except Unknown as e:
                done.append(None)
                ask.append(e.keys)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string()), pa.array(ask, pa.list_(pa.int64()))], names=[*batch.schema.names, "corrected", "ask"])


def _gathered(found: DataFrame) -> DataFrame:
    """(id, keys, counts) of rows (id, key, multiplicity)."""
    pairs = F.sort_array(F.collect_set(F.struct("key", F.col("multiplicity").cast("int").alias("m"))))
    return found.groupBy("id").agg(pairs.alias("p")).select("id", F.col("p.key").alias("keys"), F.col("p.m").alias("counts"))


def corrected_by_joins(reads: DataFrame, spectrum: DataFrame, keep: list[str], k: int = B.K) -> DataFrame:
    """As `corrected`, for a spectrum of any size: distinct reads are walked, what they ask for is joined, until all are done.

    A round answers everything that the open passes of all reads ask for. A pass of a read takes one round more for each
    of its changes within k bases of another, and each vote after a change one; there are at most 2 * ROUNDS passes and
    ROUNDS votes, so the number of rounds doesn't grow with the number of reads.
    """
    texts = stage(reads.where(F.length("seq") >= k).select("seq").distinct().withColumn("id", F.monotonically_increasing_id()), "correction-reads")
    windows = kmers.windows(texts, k, ["id"]).where("key is not null")
    hit = windows.join(spectrum, "key").select("id", "key", "multiplicity")
    weak = windows.join(spectrum.select("key"), "key", "left_anti").select("id", "forward")
    near = weak.join(mutations.neighbours(spectrum, k), "forward").select("id", F.col("near_key").alias("key"), "multiplicity")
    # A read that nothing trusted is near to stays as it is.
    known = _gathered(hit.unionByName(near))
    todo = texts.join(known, "id").select("id", "seq", "keys", "counts", F.array().cast("array<bigint>").alias("told"))
    finished: list[DataFrame] = []
    while True:
        tried = stage(todo.mapInArrow(lambda b: _attempt(b, k), f"{_STATE}, corrected STRING, ask ARRAY<BIGINT>"), "correction-round")
        finished.append(tried.where("corrected is not null").select("seq", "corrected"))
        still = tried.where("corrected is null")
        if still.isEmpty():
            break
        new = _gathered(still.select("id", F.explode("ask").alias("key")).join(spectrum, "key").select("id", "key", "multiplicity"))
        answered = still.drop("corrected").join(new.select("id", F.col("keys").alias("k2"), F.col("counts").alias("c2")), "id", "left")
        more = lambda a, b, kind: F.concat(a, F.coalesce(b, F.array().cast(f"array<{kind}>")))
        todo = answered.select("id", "seq", more("keys", F.col("k2"), "bigint").alias("keys"), more("counts", F.col("c2"), "int").alias("counts"), F.concat("told", "ask").alias("told"))
    every = finished[0]
    for part in finished[1:]:
        every = every.unionByName(part)
    named = every.withColumnRenamed("corrected", "_corrected")
    return reads.join(named, "seq", "left").select(*keep, F.coalesce("_corrected", "seq").alias("corrected"))
