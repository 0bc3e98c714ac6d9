"""Reads: the latest version of each, and operators on their order (ordinals, prefix sums, even ranges, zips)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = ["loaded_at", "seq", "qual", "header", "sequenced_at", "run_id", "sample_id", "lane"]
BLOCK, FAN, LEVELS = 1 << 16, 1 << 16, 2


def latest(seq_reads: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per read_id, that of the latest load, with `columns` (all of VERSION by default).

    Nulls count as earliest, equal loads go by the other columns in the order of VERSION, of which only those up to the
    last one asked for are read. Rows with a null read_id are left out. Partial aggregation: repeated loads of one read
    meet before the shuffle.
    """
    named = VERSION if columns is None else columns
    needed = VERSION[: max(map(VERSION.index, named), default=0) + 1]
    best = F.max(F.struct(*needed)).alias("r")
    return seq_reads.where(F.col("read_id").isNotNull()).groupBy("read_id").agg(best).select("read_id", *(f"r.{c}" for c in named))


def _before_blocks(sums: DataFrame) -> DataFrame:
    """(_block, _before): what all blocks before a block sum up to. Blocks of blocks of FAN each, so no window holds more than FAN rows, however sparse the keys."""
    levels, upto = [sums], Window.partitionBy("_up").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(LEVELS):
        up = levels[-1].groupBy(F.floor(F.col("_block") / FAN).alias("_block")).agg(F.sum("_sum").alias("_sum"))
        levels.append(up)
    before = None
    for level in reversed(levels):
        placed = level.withColumn("_up", F.floor(F.col("_block") / FAN))
        if before is None:  # the topmost level: 2 ** 63 keys are fewer than FAN blocks there
            placed = placed.withColumn("_up", F.lit(0).cast("long"))
        inside = placed.select("_block", "_up", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_inside"))
        if before is None:
            before = inside.select("_block", F.col("_inside").alias("_before"))
        else:
            outer = before.select(F.col("_block").alias("_up"), F.col("_before").alias("_outer"))
            before = inside.join(outer, "_up").select("_block", (F.col("_inside") + F.col("_outer")).alias("_before"))
    return before


def with_running(df: DataFrame, key: str, value: str | None = None, into: str = "before", block: int = BLOCK) -> DataFrame:
    """Add the number of rows (or the sum of `value`, nulls as 0) before each row, in the order of the whole-number `key`.

    In steps, so that no task sees more than the rows of one block of keys: sums of the blocks, added up over blocks of
    blocks, and the order within each block. Rows with equal keys come in the order of `value`. `key` must not be null.
    """
    rows = df.withColumn("_block", F.floor(F.col(key) / block))
    v = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(1).cast("long")
    offsets = _before_blocks(rows.groupBy("_block").agg(F.sum(v).alias("_sum")))
    order = [key, value] if value else [key]
    inside = F.coalesce(F.sum(v).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(offsets, "_block").withColumn(into, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def offsets(reads: DataFrame) -> DataFrame:
    """(read_id, start, end): where each read's bases lie when all are laid end to end by read_id. Null reads are empty."""
    sized = reads.select("read_id", F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("size"))
    return with_running(sized, "read_id", "size", "start").select("read_id", "start", (F.col("start") + F.col("size")).alias("end"))


def even_ranges(reads: DataFrame, parts: int) -> DataFrame:
    """(part, first_read, last_read, n_reads): near-equal ranges by read_id, the first ones larger by one. Empty parts are left out."""
    placed = with_running(reads.select("read_id"), "read_id", into="place")
    total = reads.agg(F.count("*").alias("n")).scalar()
    small, larger = F.floor(total / parts), total % parts
    edge = larger * (small + 1)
    part = F.when(F.col("place") < edge, F.floor(F.col("place") / (small + 1))).otherwise(larger + F.floor((F.col("place") - edge) / F.greatest(small, F.lit(1)))) + 1
    return placed.groupBy(part.cast("int").alias("part")).agg(F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"), F.count("*").alias("n_reads"))


def zipped(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """The i-th row of `left` beside the i-th of `right`, each in the order of its key; the longer side is cut. Adds `ordinal`.

    The sides must have no other column names in common.
    """
    a, b = with_running(left, left_key, into="ordinal"), with_running(right, right_key, into="ordinal")
    return a.join(b, "ordinal")
