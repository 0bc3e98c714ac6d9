"""The trusted spectrum: which k-mers are counted often enough to be no errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _all() -> WindowSpec:
    """All rows; only ever used on the 256 rows of a histogram."""
    return Window.partitionBy()


def histogram(counts: DataFrame) -> DataFrame:
    """(multiplicity, kmers): how many k-mers have each multiplicity."""
    return counts.groupBy("multiplicity").agg(F.count("*").alias("kmers"))


def density(hist: DataFrame) -> DataFrame:
    """(bin, kmers, low, high): as many equal bins as the largest multiplicity, from the smallest on; empty ones too.

    In whole numbers: the bin of v is (v - low) * high div (high - low), the last bin closed.
    """
    ends = hist.select("multiplicity", "kmers", F.min("multiplicity").over(_all()).alias("low"), F.max("multiplicity").over(_all()).alias("high"))
    place = F.when(F.col("low") == F.col("high"), F.lit(0)).otherwise(F.least(F.col("high") - 1, F.expr("(multiplicity - low) * high div greatest(high - low, 1)"))).cast("int")
    filled = ends.groupBy(place.alias("bin")).agg(F.sum("kmers").alias("kmers"), F.first("low").alias("low"), F.first("high").alias("high"))
    empty = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).where("high is not null").select(F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("bin"), F.lit(0).cast("long").alias("kmers"), "low", "high")
    return filled.unionByName(empty).groupBy("bin").agg(F.sum("kmers").alias("kmers"), F.first("low").alias("low"), F.first("high").alias("high"))


def cutoff(hist: DataFrame) -> DataFrame:
    """(cutoff): the multiplicity at the thinnest place between the first valley and the peak behind it.

    The valley is the bin before the first rise (the last bin if there is none), the peak the first of the fullest bins
    from there, the thinnest place the last of the emptiest between. If all multiplicities are equal, the cutoff is that
    one. No row for an empty histogram.
    """
    d = density(hist)
    rise = d.withColumn("rise", F.col("kmers") > F.lag("kmers").over(Window.orderBy("bin")))
    valley = rise.withColumn("valley", F.coalesce(F.min(F.when(F.col("rise"), F.col("bin"))).over(_all()) - 1, F.col("high") - 1))
    peak = valley.withColumn("peak", F.max_by("bin", F.when(F.col("bin") >= F.col("valley"), F.struct("kmers", -F.col("bin")))).over(_all()))
    between = peak.where("bin between valley and peak")
    thin = between.agg(F.min_by("bin", F.struct("kmers", -F.col("bin"))).alias("i"), F.first("low").alias("low"), F.first("high").alias("high")).where("i is not null")
    middle = F.expr("(2 * low * high + (2 * i + 1) * (high - low) + 2 * high - 1) div (2 * high)")
    return thin.select(F.when(F.col("low") == F.col("high"), F.col("high").cast("bigint")).otherwise(middle).alias("cutoff"))


def cutoff_of(hist: dict[int, int]) -> int | None:
    """The cutoff for a histogram at hand, {multiplicity: k-mers} of no more than 255 entries; the same as `cutoff`, without jobs for so few rows."""
    if not hist:
        return None
    low, high = min(hist), max(hist)
    if low == high:
        return high
    bins = [0] * high
    for v, n in hist.items():
        bins[min(high - 1, (v - low) * high // (high - low))] += n
    valley = next((i for i in range(high - 1) if bins[i + 1] > bins[i]), high - 1)
    peak = max(range(valley, high), key=lambda i: (bins[i], -i))
    thin = min(range(valley, peak + 1), key=lambda i: (bins[i], -i))
    return (2 * low * high + (2 * thin + 1) * (high - low) + 2 * high - 1) // (2 * high)


def trusted(counts: DataFrame, at: int | None = None) -> DataFrame:
    """(key, multiplicity) of the k-mers with at least the cutoff `at`; without one it is found from the k-mers seen twice or more."""
    often = counts.where("multiplicity > 1")
    limit = F.lit(at) if at is not None else cutoff(histogram(often)).scalar()
    return often.where(F.col("multiplicity") >= limit)
