"""The first step of the one-sided walks as joins: which base would be changed next to each trusted region, and to what.

The whole walk looks at its own changes and runs in Arrow batches (`onesided`); its first step depends on the read alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import solidity

STEP = ["read_id", "lo", "to_right"]


def first_steps(reads: DataFrame, spectrum: DataFrame, ahead: int, k: int = B.K) -> DataFrame:
    """(read_id, lo, to_right, pos, base, multiplicity, confirmed, turn): the bases that make the first untrusted k-mer behind or before a region trusted.

    `lo` names the region, `pos` is the place of the base. A base is confirmed if up to `ahead` k-mers that follow (to
    the left: that come before, without the next one) are trusted with it; if there are none, it is. No row where the
    place is solid or the read ends. `turn` is the order of the bases on the k-mer's canonical strand. One join: a row for
    each k-mer that must be trusted.
    """
    by = Window.partitionBy("read_id").orderBy("lo")
    regions = solidity.trusted_regions(reads, spectrum, k).select("read_id", "lo", "hi", F.lag("hi").over(by).alias("before"), F.lead("lo").over(by).alias("behind"))
    coded = reads.where(F.length("seq") >= k).select("read_id", B.read_digits(F.col("seq")).alias("d"), F.length("seq").alias("n"))
    both = regions.join(coded, "read_id").withColumn("to_right", F.explode(F.array(F.lit(True), F.lit(False))))
    s, at = F.col("s"), F.col("pos")
    placed = both.withColumn("s", F.when(F.col("to_right"), F.col("hi") + 1).otherwise(F.col("lo") - 1)).withColumn("pos", F.when(F.col("to_right"), s + k - 1).otherwise(s))
    right = F.col("to_right") & (s <= F.col("n") - k) & (F.col("behind").isNull() | (at < F.col("behind")))
    left = ~F.col("to_right") & (s >= 0) & (F.col("before").isNull() | (at > F.col("before") + k - 1))
    rest, none = F.col("n") - s - 1, F.array().cast("array<int>")
    later = F.when(rest < k, none).otherwise(F.sequence(s + 1, s + 1 + F.least(rest - k, F.lit(ahead - 1))))
    earlier = F.when(s <= 1, none).otherwise(F.sequence(F.greatest(s - 1 - ahead, F.lit(0)), s - 2))
    near = F.when(F.lit(ahead <= 0), none).when(F.col("to_right"), later).otherwise(earlier)
    begin = F.greatest(s - ahead - 1, F.lit(0))
    cut = placed.where(right | left).select(*STEP, "pos", "s", near.alias("near"), begin.alias("begin"), F.substring("d", begin + 1, F.lit(k + 2 * ahead + 2)).alias("around"), F.substring("d", s + 1, F.lit(k)).alias("own"))
    here = at - F.col("begin") + 1
    tried = cut.select("*", F.explode(F.array(*map(F.lit, "1234"))).alias("digit")).where(F.substring("around", here, F.lit(1)) != F.col("digit"))
    changed = tried.withColumn("around", F.overlay("around", "digit", here, F.lit(1)))
    each = changed.select(*STEP, "pos", "s", "digit", "own", F.size("near").alias("asked"), "around", "begin", F.explode(F.concat(F.array("s"), "near")).alias("q"))
    kmer = F.substring("around", F.col("q") - F.col("begin") + 1, F.lit(k))
    keyed = each.withColumn("key", F.least(B.number(kmer), B.number(B.opposite_digits(kmer)))).where("key is not null")
    hit = keyed.join(spectrum.select("key", F.col("multiplicity").alias("m")), "key")
    told = hit.groupBy(*STEP, "pos", "digit", "own", "asked").agg(F.max(F.when(F.col("q") == s, F.col("m"))).alias("multiplicity"), F.count("*").alias("met")).where("multiplicity is not null")
    backward = B.opposite_digits(F.col("own")) <= F.col("own")
    turn = F.when(backward, 5 - F.col("digit").cast("int")).otherwise(F.col("digit").cast("int"))
    return told.select(*STEP, "pos", B.decode_digits(F.col("digit")).alias("base"), "multiplicity", (F.col("met") > F.col("asked")).alias("confirmed"), turn.alias("turn"))


def chosen(steps: DataFrame) -> DataFrame:
    """(read_id, lo, to_right, pos, base): the change of each step; a single base needs no confirmation, of several confirmed ones the most frequent is taken, the first of equal ones."""
    best = F.max_by("base", F.when(F.col("confirmed"), F.struct(F.col("multiplicity"), (-F.col("turn")).alias("early"))))
    picked = steps.groupBy(*STEP, "pos").agg(F.when(F.count("*") == 1, F.max("base")).otherwise(best).alias("base"))
    return picked.where("base is not null")
