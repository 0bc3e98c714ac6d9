"""Single-base alternatives of untrusted k-mers: candidates, votes, and the two-sided check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import kmers, lookup, solidity, tally


def untrusted(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """Plain windows that are not in the spectrum."""
    rows = kmers.windows(reads, k).where("key is not null")
    return rows.join(spectrum.select("key"), "key", "left_anti")


def neighbours(spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """(forward, at, base, multiplicity, near_key): every k-mer, as a number of digits, that differs from a trusted one, of key near_key, only at `at`, where that has `base`.

    Both strands of the trusted k-mers are mutated; a palindromic one has only one.
    """
    kmer = B.key_kmer(F.col("key"))
    strands = spectrum.select(F.col("key").alias("near_key"), "multiplicity", F.explode(F.array_distinct(F.array("key", B.kmer_key(B.reverse_complement(kmer))))).alias("trusted"))
    powers = F.array(*(F.lit(10**i) for i in range(k - 1, -1, -1)))
    each = strands.select("near_key", "multiplicity", "trusted", F.posexplode(powers).alias("at", "power"))
    digit = each.withColumn("digit", F.expr("trusted div power % 10"))
    other = digit.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("other")).where("other <> digit")
    return other.select(F.expr("trusted + (other - digit) * power").alias("forward"), "at", B.decode_digits(F.col("digit").cast("string")).alias("base"), "multiplicity", "near_key")


def changes_of_windows(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, pos, base, start, multiplicity, backward): changes of one base that turn the untrusted k-mer at `start` into a trusted one; backward: its other strand is the smaller one, or the same.

    Up to NEAR_KMERS trusted k-mers are looked up read by read, without a shuffle; more of them are joined. Up to
    NEAR_TABLE_KMERS tell which windows are near one; of more, all changes of all untrusted windows are looked up.
    """
    held, shared = lookup.small_spectrum(spectrum, lookup.NEAR_KMERS)
    if shared is None:
        return changes_of_windows_by_joins(reads, held, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted = lookup.Spectrum(*shared.value, in_order=True)
        few = len(trusted.keys) <= lookup.NEAR_TABLE_KMERS
        near = lookup.Near(trusted.keys, k) if few else tally.Trusted(trusted, k)
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            ends, d = np.cumsum([len(s) + 1 for s in seqs]), lookup.digits_of("\n".join(seqs))
            for window, at, digit, multiplicity, backward in near.changes(d, k, trusted) if few else near.changes(d, k):
                row = np.searchsorted(ends, window, side="right")
                start, letters = (window - np.r_[0, ends][row]).astype(np.int32), pa.array(list(B.LETTERS[:4])).take(pa.array(digit - 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(start + np.int32(at)), letters, pa.array(start), pa.array(multiplicity.astype(np.int32)), pa.array(backward)],
                    names=["read_id", "pos", "base", "start", "multiplicity", "backward"],
                )

    return reads.select("read_id", "seq").where(F.length("seq") >= k).mapInArrow(run, f"{lookup.schema_of(reads, ['read_id'])}, pos INT, base STRING, start INT, multiplicity INT, backward BOOLEAN")


def changes_of_windows_by_joins(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """As changes_of_windows, for a spectrum of any size.

    The trusted k-mers are mutated, not the untrusted ones: there are far fewer of them, and the windows of the reads join
    as they are. Spark doesn't count the rows that `explode` adds, so by its sizes it would send all windows to the driver
    to be broadcast; hence the hint.
    """
    kmer = F.col("kmer")
    weak = untrusted(reads, spectrum, k).select("read_id", F.col("pos").alias("start"), "forward", (B.reverse_complement(kmer) <= kmer).alias("backward"))
    found = weak.hint("merge").join(neighbours(spectrum, k), "forward")
    return found.select("read_id", (F.col("start") + F.col("at")).alias("pos"), "base", "start", "multiplicity", "backward")


def candidates(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, pos, base, start, multiplicity): changes of one base that turn the untrusted k-mer at `start` into a trusted one."""
    return changes_of_windows(reads, spectrum, k).drop("backward")


def best_of_kmer(reads: DataFrame, spectrum: DataFrame, last_wins: bool = False, k: int = B.K) -> DataFrame:
    """(read_id, start, pos, base, multiplicity): for each place of an untrusted k-mer the change to the most frequent trusted one.

    Of equal ones the first in the order of the k-mer's canonical strand, so the last letter where the other strand is
    the smaller one (or the same); with `last_wins` the last letter of the alphabet.
    """
    letter = F.ascii("base")
    rank = letter if last_wins else F.when(F.col("backward"), letter).otherwise(-letter)
    best = F.max(F.struct("multiplicity", rank.alias("rank"), "base")).alias("best")
    return changes_of_windows(reads, spectrum, k).groupBy("read_id", "start", "pos").agg(best).select("read_id", "start", "pos", "best.base", "best.multiplicity")


def votes(found: DataFrame) -> DataFrame:
    """(read_id, pos, base, votes): how many untrusted k-mers a change would make trusted."""
    return found.groupBy("read_id", "pos", "base").agg(F.count("*").alias("votes"))


def winners(voted: DataFrame) -> DataFrame:
    """(read_id, pos, base, votes): the changes with the most votes of their read.

    Of two tied bases at one place neither wins; of three the last in the alphabet does.
    """
    best = F.max("votes").over(Window.partitionBy("read_id"))
    tied = voted.withColumn("best", best).where("votes = best").groupBy("read_id", "pos").agg(F.count("*").alias("n"), F.max("base").alias("base"), F.max("votes").alias("votes"))
    return tied.where("n <> 2").select("read_id", "pos", "base", "votes")


def place_winners(voted: DataFrame) -> DataFrame:
    """(read_id, pos, base, votes): each place's change with the most votes; of tied ones the first in the alphabet."""
    best = F.max(F.struct("votes", (-F.ascii("base")).alias("early"), "base")).alias("best")
    return voted.groupBy("read_id", "pos").agg(best).select("read_id", "pos", "best.base", "best.votes")


def two_sided(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, pos, base): changes of an unsolid base that make both of its k-mers trusted.

    The right k-mer starts at the base (or is the read's last), the left one ends there (or is the first). A spectrum
    that fits the tasks is looked up read by read, without a shuffle; a larger one is joined.
    """
    held, shared = lookup.small_spectrum(spectrum)
    if shared is None:
        return two_sided_by_joins(reads, held, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted = lookup.Spectrum(*shared.value, in_order=True)
        for batch in batches:
            found = [_two_sided(lookup.digits_of(s), k, trusted) for s in batch.column(1).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
            at, base = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1))
            letters = pa.array(list(B.LETTERS[:4])).take(pa.array(base))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(at.astype(np.int32)), letters], names=["read_id", "pos", "base"])

    return reads.select("read_id", "seq").where(F.length("seq") >= k).mapInArrow(run, f"{lookup.schema_of(reads, ['read_id'])}, pos INT, base STRING")


def _two_sided(d: np.ndarray, k: int, trusted: lookup.Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """The places and bases (0 to 3) of the two-sided changes of a read given as digits."""
    windows = np.lib.stride_tricks.sliding_window_view(d, k)
    at = np.nonzero(~lookup.covered(trusted.many(lookup.keys_of(windows)) > 0, k))[0]
    right, left = np.minimum(at, len(d) - k), np.maximum(at - (k - 1), 0)
    rescued = np.zeros((len(at), 4), bool)
    for base in range(4) if len(at) else ():
        behind, before = windows[right], windows[left]
        behind[np.arange(len(at)), at - right] = before[np.arange(len(at)), at - left] = base + 1
        rescued[:, base] = (d[at] != base + 1) & (trusted.many(lookup.keys_of(behind)) > 0) & (trusted.many(lookup.keys_of(before)) > 0)
    i, base = np.nonzero(rescued)
    return at[i], base


def two_sided_by_joins(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """As two_sided, for a spectrum of any size. Both lookups are one join: two rows a change, and both must be found."""
    solid = solidity.solid_bases_by_joins(reads, spectrum, k)
    coded = reads.where(F.length("seq") >= k).select("read_id", B.read_digits(F.col("seq")).alias("d"), F.length("seq").alias("n")).withColumn("r", B.opposite_digits(F.col("d")))
    weak = solid.where("not solid").select("read_id", "pos").join(coded, "read_id")
    right, left = F.least(F.col("pos"), F.col("n") - k), F.greatest(F.col("pos") - (k - 1), F.lit(0))
    sides = weak.withColumn("start", F.explode(F.array(right, left)))
    at = F.col("pos") - F.col("start")
    each = sides.select(
        "read_id", "pos", at.alias("at"), F.substring("d", F.col("start") + 1, F.lit(k)).alias("f"), F.substring("r", F.col("n") - F.col("start") - (k - 1), F.lit(k)).alias("b"),
        F.explode(F.array(*map(F.lit, "1234"))).alias("digit"),
    ).where(F.substring("f", F.col("at") + 1, F.lit(1)) != F.col("digit"))
    forward = B.number(F.overlay("f", "digit", F.col("at") + 1, F.lit(1)))
    backward = B.number(F.overlay("b", F.translate("digit", "1234", "4321"), k - F.col("at"), F.lit(1)))
    tried = each.select("read_id", "pos", "digit", forward.alias("f"), backward.alias("b")).where("f is not null").select("read_id", "pos", "digit", F.least("f", "b").alias("key"))
    hit = tried.join(spectrum.select("key"), "key")
    paired = hit.groupBy("read_id", "pos", "digit").agg(F.count("*").alias("sides")).where("sides = 2")
    return paired.select("read_id", "pos", B.decode_digits(F.col("digit")).alias("base"))


def interior_fixes(both: DataFrame, reads: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, pos, base): of the two-sided changes, those with k - 1 bases on either side that are the only one of their place.

    Each place is judged on the read as it stands, without the other fixes.
    """
    single = both.groupBy("read_id", "pos").agg(F.count("*").alias("n"), F.min("base").alias("base")).where("n = 1").drop("n")
    sizes = reads.select("read_id", F.length("seq").alias("size"))
    return single.where(F.col("pos") >= k - 1).join(sizes, "read_id").where(F.col("pos") <= F.col("size") - k).drop("size")


def first_fix(both: DataFrame) -> DataFrame:
    """(read_id, pos, base): each read's first place with exactly one two-sided change."""
    single = both.groupBy("read_id", "pos").agg(F.count("*").alias("n"), F.min("base").alias("base")).where("n = 1")
    return single.groupBy("read_id").agg(F.min(F.struct("pos", "base")).alias("f")).select("read_id", "f.pos", "f.base")


def within_limit(fixes: DataFrame, reads: DataFrame, most: int, k: int = B.K) -> DataFrame:
    """The fixes (read_id, pos, base) without those in a k-mer that has more than `most` of them."""
    sizes = reads.select("read_id", F.length("seq").alias("n"))
    over = fixes.select("read_id", "pos").join(sizes.where(F.col("n") >= k), "read_id")
    starts = over.select("read_id", "pos", F.explode(F.sequence(F.greatest(F.col("pos") - (k - 1), F.lit(0)), F.least(F.col("pos"), F.col("n") - k))).alias("start"))
    crowded = starts.withColumn("fixes", F.count("*").over(Window.partitionBy("read_id", "start"))).where(F.col("fixes") > most)
    return fixes.join(crowded.select("read_id", "pos").distinct(), ["read_id", "pos"], "left_anti")


def applied(reads: DataFrame, fixes: DataFrame) -> DataFrame:
    """Reads with the fixes (read_id, pos, base; one a place) written into seq."""
    lists = fixes.groupBy("read_id").agg(F.collect_list(F.struct("pos", "base")).alias("fixes"))
    fixed = F.aggregate("fixes", F.col("seq"), lambda s, f: F.overlay(s, f["base"], f["pos"] + 1, F.lit(1)))
    return reads.hint("merge").join(lists, "read_id", "left").withColumn("seq", F.when(F.col("fixes").isNull(), F.col("seq")).otherwise(fixed)).drop("fixes")


def two_sided_corrected(reads: DataFrame, spectrum: DataFrame, rounds: int = 2, k: int = B.K) -> DataFrame:
    """Reads after some rounds of the two-sided fix, an optional stage before the one-sided one."""
    for _ in range(rounds):
        reads = applied(reads, first_fix(two_sided(reads, spectrum, k)))
    return reads
