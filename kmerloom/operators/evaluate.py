"""Comparing reads with each other and with a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(read_id, status): `differs` or `missing` for the reads of `left` that `right` has otherwise or not at all. Two null reads are equal."""
    other = right.select("read_id", F.col("seq").alias("other"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(~F.col("seq").eqNullSafe(F.col("other")), "differs")
    return left.select("read_id", "seq").join(other, "read_id", "left").select("read_id", status.alias("status")).where("status is not null")


def shared_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(read_id, positions): over how many places both versions of a read reach, and (matches) where they agree."""
    both = left.select("read_id", F.col("seq").alias("a")).join(right.select("read_id", F.col("seq").alias("b")), "read_id").where("a is not null and b is not null")
    n = F.least(F.length("a"), F.length("b"))
    same = F.size(F.filter(F.arrays_zip(F.split(F.substring("a", F.lit(1), n), "").alias("x"), F.split(F.substring("b", F.lit(1), n), "").alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != "")))
    return both.select("read_id", n.alias("positions"), same.alias("matches"))


def confusion(triples: DataFrame) -> DataFrame:
    """One row (tp, fp, fn) over all places that reference, original and corrected have: an error corrected, a right base spoilt, an error left."""
    n = F.least(F.length("reference"), F.length("original"), F.length("corrected"))
    rows = triples.where(n > 0).select("reference", "original", "corrected", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    at: list[Column] = [F.substring(c, F.col("i"), F.lit(1)) for c in ("reference", "original", "corrected")]
    r, o, c = rows.select(*(x.alias(a) for x, a in zip(at, "roc"))), F.col("o"), F.col("c")
    ref = F.col("r")
    return r.agg(F.count_if((o != ref) & (c == ref)).alias("tp"), F.count_if((o == ref) & (c != ref)).alias("fp"), F.count_if((o != ref) & (c != ref)).alias("fn"))


def unique_rate(alignments: DataFrame) -> DataFrame:
    """One row (total, uniquely, percent): alignments, those with a mapping quality of 1 or more, and their share, cut to whole percents."""
    sums = alignments.agg(F.count("*").alias("total"), F.count_if(F.col("mapq") >= 1).alias("uniquely"))
    return sums.select("total", "uniquely", F.when(F.col("total") > 0, F.expr("uniquely * 100 div total")).alias("percent"))


def mapped_with_errors(alignments: DataFrame) -> DataFrame:
    """One row (n): mapped alignments whose edit distance is over 0."""
    return alignments.agg(F.count_if(((F.col("flag").bitwiseAND(4)) == 0) & (F.col("nm") > 0)).alias("n"))


def aligned_confusion(pairs: DataFrame) -> DataFrame:
    """One row (tp, fp, fn) over the places of the reference that both alignments of a read cover.

    `pairs` has the arrays of places `original_at` and `corrected_at`, the starts and seqs of both (original_start, ...),
    and `reference`, the stretch that the original covers. A base lies as far into its seq as its place is behind the
    start, so gaps and clipped ends shift it; what falls outside a seq or the stretch doesn't count.
    """
    each = pairs.select("*", F.explode(F.array_intersect("original_at", "corrected_at")).alias("place"))
    i, j = F.col("place") - F.col("original_start"), F.col("place") - F.col("corrected_start")
    size = F.length("reference")
    inside = (i >= 0) & (i < F.length("original")) & (i < size) & (j >= 0) & (j < F.length("corrected")) & (j < size)
    at = lambda c, k: F.substring(c, k + 1, F.lit(1))
    rows = each.where(inside).select(at("reference", i).alias("r"), at("original", i).alias("o"), at("corrected", j).alias("c"))
    wrong, right = F.col("o") != F.col("r"), F.col("c") == F.col("r")
    return rows.agg(F.count_if(wrong & right).alias("tp"), F.count_if(~wrong & ~right).alias("fp"), F.count_if(wrong & ~right).alias("fn"))
