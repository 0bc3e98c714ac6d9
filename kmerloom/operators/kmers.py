"""From reads to k-mers and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import bases as B


def windows(reads: DataFrame, k: int = B.K, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """(read_id or `keep`, pos, kmer, forward, key): every stretch of k letters, ambiguity codes as A, other letters as they are.

    forward is the stretch as a number of digits, key that of its canonical k-mer; both are null where there is a letter
    but A, C, G and T. Letters are turned into digits once a read, for both strands, not once a window. Reads that are
    null or shorter than k have no windows. With `whole`, every place of a read is a row, also the last k - 1, which have
    nulls, and those of short reads.
    """
    names = keep if keep is not None else ["read_id"]
    seq, n = B.rewrite_ambiguous(F.col("seq")), F.length("seq")
    digits = B.read_digits(F.col("seq"))
    some = reads.where(n >= (1 if whole else k)).select(*names, seq.alias("_s"), digits.alias("_d"), n.alias("_n")).withColumn("_r", B.opposite_digits(F.col("_d")))
    places = some.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - (1 if whole else k))).alias("pos"))
    size, at = F.lit(k), F.col("pos") + 1
    fits = F.col("pos") <= F.col("_n") - k
    cut = {"kmer": F.substring("_s", at, size), "forward": B.number(F.substring("_d", at, size)), "_b": B.number(F.substring("_r", F.col("_n") - F.col("pos") - (k - 1), size))}
    rows = places.select(*names, "pos", *((F.when(fits, c) if whole else c).alias(a) for a, c in cut.items()))
    return rows.select(*names, "pos", "kmer", "forward", F.least("forward", "_b").alias("key"))


def counted_forward(reads: DataFrame, k: int = B.K) -> DataFrame:
    """(kmer, n): plain windows as they stand on the read's strand."""
    n = windows(reads, k, []).where("forward is not null").groupBy("forward").agg(F.count("*").alias("n"))
    return n.select(B.key_kmer(F.col("forward")).alias("kmer"), "n")


def counted(reads: DataFrame, k: int = B.K, least: int = 1) -> DataFrame:
    """(key, multiplicity): canonical k-mers with their number, no more than 255; those seen fewer than `least` times left out.

    One shuffle of partial counts by key. A palindromic k-mer counts once a window.
    """
    n = windows(reads, k, []).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).select("key", F.least("n", F.lit(255)).cast("int").alias("multiplicity"))


def merged(partial: DataFrame) -> DataFrame:
    """(key, multiplicity): partial counts added up, no more than 255. Null multiplicities add nothing, null keys are left out."""
    sums = partial.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum(F.coalesce(F.col("multiplicity").cast("long"), F.lit(0))).alias("n"))
    return sums.select("key", F.least("n", F.lit(255)).cast("int").alias("multiplicity"))
