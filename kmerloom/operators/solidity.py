"""Which bases of a read trusted k-mers cover, and the regions they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import kmers, lookup


def _places() -> WindowSpec:
    return Window.partitionBy("read_id").orderBy("pos")


def multiplicities(rows: DataFrame, spectrum: DataFrame) -> DataFrame:
    """Windows with the multiplicity of their k-mer in the spectrum, 0 if it isn't there. Spark broadcasts a small spectrum.

    Windows without a key (other letters, the ends of reads) are spread over negative keys, which no k-mer has, so that
    they don't meet in one partition.
    """
    known = spectrum.select(F.col("key").alias("_known"), F.col("multiplicity").alias("in_spectrum"))
    nowhere = -1 - F.pmod(F.xxhash64(*(c for c in rows.columns if c != "key")), F.lit(1 << 20))
    spread = rows.withColumn("_key", F.coalesce("key", nowhere))
    return spread.join(known, F.col("_key") == F.col("_known"), "left").withColumn("multiplicity", F.coalesce("in_spectrum", F.lit(0))).drop("in_spectrum", "_key", "_known")


def solid_bases(reads: DataFrame, spectrum: DataFrame, k: int = B.K, both_strands: bool = True) -> DataFrame:
    """(read_id, pos, solid): for every base, whether a trusted k-mer covers it. Empty and null reads have no bases.

    Without `both_strands` a window is looked up as it stands, not by its canonical k-mer. A spectrum that fits the tasks
    is looked up read by read, without a shuffle; a larger one is joined.
    """
    held, shared = lookup.small_spectrum(spectrum)
    if shared is None:
        return solid_bases_by_joins(reads, held, k, both_strands)
    power = 10 ** np.arange(k - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted = lookup.Spectrum(*shared.value, in_order=True)

        def solid(seq: str) -> np.ndarray:
            if len(seq) < k:
                return np.zeros(len(seq), bool)
            windows = np.lib.stride_tricks.sliding_window_view(lookup.digits_of(seq), k)
            return lookup.covered(trusted.many(lookup.keys_of(windows) if both_strands else windows @ power) > 0, k)

        for batch in batches:
            told = [solid(s) for s in batch.column(1).to_pylist()]
            size = [len(t) for t in told]
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in size]) if size else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(at), pa.array(np.concatenate(told) if told else np.zeros(0, bool))], names=["read_id", "pos", "solid"])

    return reads.select("read_id", "seq").where("seq <> ''").mapInArrow(run, f"{lookup.schema_of(reads, ['read_id'])}, pos INT, solid BOOLEAN")


def solid_bases_by_joins(reads: DataFrame, spectrum: DataFrame, k: int = B.K, both_strands: bool = True) -> DataFrame:
    """As solid_bases, for a spectrum of any size."""
    key = F.col("key" if both_strands else "forward").alias("key")
    hit = multiplicities(kmers.windows(reads, k, whole=True).select("read_id", "pos", key), spectrum).select("read_id", "pos", (F.col("multiplicity") > 0).alias("hit"))
    return hit.select("read_id", "pos", F.max("hit").over(_places().rowsBetween(-(k - 1), 0)).alias("solid"))


def _islands(rows: DataFrame, least: int = 1) -> DataFrame:
    """Runs of consecutive places: (read_id, lo, hi, n)."""
    runs = rows.select("read_id", "pos", (F.col("pos") - F.row_number().over(_places())).alias("run")).groupBy("read_id", "run")
    found = runs.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("run")


def trusted_regions(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, lo, hi, span): runs of consecutive starts of trusted k-mers; span = hi - lo."""
    hit = kmers.windows(reads, k).join(spectrum.select("key"), "key", "left_semi")
    return _islands(hit.select("read_id", "pos")).select("read_id", "lo", "hi", (F.col("hi") - F.col("lo")).alias("span"))


def trusted_base_regions(solids: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, lo, hi): runs of at least k solid bases."""
    return _islands(solids.where("solid"), k).select("read_id", "lo", "hi")


def ranked_regions(regions: DataFrame, longest_first: bool) -> DataFrame:
    """Regions with `turn`, their order by span (longest or shortest first), equal ones from left to right."""
    span: Column = F.col("span").desc() if longest_first else F.col("span").asc()
    return regions.withColumn("turn", F.row_number().over(Window.partitionBy("read_id").orderBy(span, "lo")))


def all_solid(solids: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """(read_id, all_solid). Empty reads have no base that isn't solid; they are among `solids` only by `reads`. Null reads have no row."""
    told = solids.groupBy("read_id").agg(F.bool_and("solid").alias("all_solid"))
    return told if reads is None else told.unionByName(reads.where("seq = ''").select("read_id", F.lit(True).alias("all_solid")))


def diagnostics(solids: DataFrame) -> DataFrame:
    """One row of counts over all reads: reads, bases, solid bases, reads with an unsolid base, bases in those."""
    per_read = solids.groupBy("read_id").agg(F.count("*").alias("n"), F.count_if("solid").alias("s"))
    return per_read.agg(
        F.count("*").alias("reads"), F.coalesce(F.sum("n"), F.lit(0)).alias("bases"), F.coalesce(F.sum("s"), F.lit(0)).alias("solid_bases"),
        F.count_if(F.col("s") < F.col("n")).alias("error_reads"), F.coalesce(F.sum(F.when(F.col("s") < F.col("n"), F.col("n") - F.col("s"))), F.lit(0)).alias("unsolid_bases"),
    )


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (gained, lost, same) over the bases that both have: solid only after, only before, or alike.

    Spark takes the bases for as few as the reads and would send them to the driver to be broadcast; hence the hint.
    """
    both = before.withColumnRenamed("solid", "b").hint("merge").join(after.withColumnRenamed("solid", "a"), ["read_id", "pos"])
    return both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("gained"), F.count_if(F.col("b") & ~F.col("a")).alias("lost"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def changes_in_reads(reads: DataFrame, spectrum: DataFrame, k: int = B.K) -> DataFrame:
    """As `changes`, of the bases of the reads (read_id, before, seq) whose letters were `before` and are `seq`, of the same length.

    A spectrum that fits the tasks is looked up read by read, and only counts leave a task; a larger one is joined.
    """
    held, shared = lookup.small_spectrum(spectrum)
    if shared is None:
        return changes(*(solid_bases_by_joins(reads.select("read_id", F.col(c).alias("seq")), held, k) for c in ("before", "seq")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted = lookup.Spectrum(*shared.value, in_order=True)

        def solid(seqs: list[str]) -> np.ndarray:
            d = lookup.digits_of("\n".join(seqs))
            hit = [trusted.many(np.minimum(forward, backward)) > 0 for _, forward, backward, _ in lookup.numbers_of(d, k)]
            return lookup.covered(np.concatenate(hit), k) if hit else np.zeros(len(d), bool)

        for batch in batches:
            b, a = (solid(batch.column(i).to_pylist()) for i in (0, 1))
            between = max(0, batch.num_rows - 1)  # no base, so solid in neither
            yield pa.RecordBatch.from_arrays([pa.array([int(n)]) for n in ((a & ~b).sum(), (b & ~a).sum(), (a == b).sum() - between)], names=["gained", "lost", "same"])

    told = reads.where("before <> ''").select("before", "seq").mapInArrow(run, "gained LONG, lost LONG, same LONG")
    return told.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gained", "lost", "same")))
