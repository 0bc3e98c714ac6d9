"""Column functions on DNA letters and k-mers. All of them give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ambiguity codes counted as A, and the digits of the letters.
AMBIGUOUS = "NWKSYMR"
LETTERS, DIGITS = "ACGTN", "12345"
K = 16


def rewrite_ambiguous(seq: Column) -> Column:
    """The ambiguity codes as A; other letters stay."""
    return F.translate(seq, AMBIGUOUS, "A" * len(AMBIGUOUS))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTN", "TGCAN")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_plain(kmer: Column) -> Column:
    """Whether there is no letter but A, C, G and T."""
    return F.length(F.translate(kmer, "ACGT", "")) == 0


def encode_digits(seq: Column) -> Column:
    """Letters as digits: A1 C2 G3 T4 N5."""
    return F.translate(seq, LETTERS, DIGITS)


def decode_digits(digits: Column) -> Column:
    return F.translate(digits, DIGITS, LETTERS)


def kmer_key(kmer: Column) -> Column:
    """The digits of a k-mer of up to 18 letters as a number."""
    return encode_digits(kmer).cast("bigint")


def key_kmer(key: Column) -> Column:
    return decode_digits(key.cast("string"))


def forward_base(kmer: Column, base: Column) -> Column:
    """The k-mer one base on: without its first, with `base` at the end."""
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer)), base)


def backward_base(kmer: Column, base: Column) -> Column:
    """The k-mer one base back: `base` in front, without its last."""
    return F.concat(base, F.substring(kmer, F.lit(1), F.length(kmer) - 1))


def replaced(kmer: Column, at: Column, base: Column) -> Column:
    """The k-mer with `base` at the 0-based place `at`."""
    return F.overlay(kmer, base, at + 1, F.lit(1))


def read_digits(seq: Column) -> Column:
    """A read as digits for lookups: ambiguity codes count as A, any other letter is an x."""
    return F.translate(F.regexp_replace(seq, f"[^ACGT{AMBIGUOUS}]", "x"), "ACGT" + AMBIGUOUS, "1234" + "1" * len(AMBIGUOUS))


def opposite_digits(digits: Column) -> Column:
    """The digits of the other strand."""
    return F.translate(F.reverse(digits), "1234", "4321")


def number(digits: Column) -> Column:
    """Digits as a number; null where there is an x."""
    return digits.try_cast("bigint")


def id_suffix(header: Column) -> Column:
    """The number behind the last `-` or `.` of the header's first word, less one; null if it is no number."""
    last = F.regexp_extract(F.substring_index(header, " ", 1), r"([^.\-]*)$", 1)
    return F.when(F.rlike(last, F.lit("^[0-9]{1,18}$")), last.cast("bigint") - 1)


def file_stem(path: Column) -> Column:
    """What stands before the first `.fastq` or `.fq`; empty if there is neither."""
    return F.regexp_extract(path, r"^(.*?)\.(?:fastq|fq)", 1)
