"""The whole correction: count, prune, cut off, correct, and put the corrected bases back into the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import evaluate, onesided, spectrum, tally
from kmerloom.tables import stage


def trusted_spectrum(reads: DataFrame, k: int = B.K) -> DataFrame:
    """(key, multiplicity), staged: the counts are made once, the cutoff is read from their histogram. Empty if nothing is seen twice."""
    often = stage(tally.counted(reads, k, least=2), "kmer-counts")
    found = spectrum.cutoff_of(dict(spectrum.histogram(often).collect()))  # multiplicities are 2 to 255
    return often if found is None else often.where(f"multiplicity >= {found}")


def correct(reads: DataFrame, keep: list[str], k: int = B.K) -> DataFrame:
    """(keep, corrected) of reads with a column seq."""
    return onesided.corrected(reads, trusted_spectrum(reads, k), keep, k)


def confusion(reads: DataFrame, reference: DataFrame, k: int = B.K) -> DataFrame:
    """One row (tp, fp, fn): the whole correction of `reads` (read_id, seq) judged by the seq of `reference`."""
    done = correct(reads.select("read_id", "seq"), ["read_id", "seq"], k).withColumnRenamed("seq", "original")
    return evaluate.confusion(done.join(reference.select("read_id", F.col("seq").alias("reference")), "read_id"))
