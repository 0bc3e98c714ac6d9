"""SAM and FASTA text as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sam(lines: DataFrame) -> DataFrame:
    """(qname, flag, rname, start, end, mapq, seq, nm, cigar) of SAM lines (column `value`); header and short lines are left out.

    start is 0-based, end exclusive: the places that M, D, N, = and X of the CIGAR string take up.
    """
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).select(c.alias("c"), "value").where(F.size("c") >= 11)
    at = lambda i: F.element_at("c", i)
    taken = F.aggregate(F.regexp_extract_all(at(6), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda a, n: a + n.cast("int"))
    nm = F.try_to_number(F.nullif(F.regexp_extract("value", r"\tNM:i:(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")
    start = at(4).cast("int") - 1
    seq = F.nullif(at(10), F.lit("*"))
    return rows.select(at(1).alias("qname"), at(2).cast("int").alias("flag"), at(3).alias("rname"), start.alias("start"), (start + taken).alias("end"), at(5).cast("int").alias("mapq"), seq.alias("seq"), nm.alias("nm"), at(6).alias("cigar"))


def aligned_positions(start: Column, cigar: Column) -> Column:
    """The 0-based places of the reference that M, = and X of the CIGAR string cover, as an array."""
    parts = F.arrays_zip(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)).alias("n"), F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)).alias("op"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def add(state: Column, part: Column) -> Column:
        n = part["n"].cast("int")
        block = F.array(F.struct(state["at"].alias("lo"), (state["at"] + n - 1).alias("hi")))
        moves = part["op"].isin("M", "D", "N", "=", "X") & (n > 0)
        return F.struct((state["at"] + F.when(moves, n).otherwise(0)).alias("at"), F.when(part["op"].isin("M", "=", "X") & (n > 0), F.concat(state["held"], block)).otherwise(state["held"]).alias("held"))

    held = F.aggregate(parts, F.struct(start.alias("at"), none.alias("held")), add, lambda state: state["held"])
    return F.flatten(F.transform(held, lambda b: F.sequence(b["lo"], b["hi"])))


def sam_lines(rows: DataFrame) -> DataFrame:
    """SAM lines (column `value`) of rows with qname, flag, rname, start (0-based), mapq, cigar, seq and nm. A null or empty seq is `*`."""
    text = lambda c, empty: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(empty))
    at = (F.col("start") + 1).cast("string")
    fields = [text("qname", "*"), text("flag", "0"), text("rname", "*"), F.coalesce(at, F.lit("0")), text("mapq", "0"), text("cigar", "*"), F.lit("*"), F.lit("0"), F.lit("0"), text("seq", "*"), F.lit("*")]
    return rows.select(F.concat(F.concat_ws("\t", *fields), F.coalesce(F.concat(F.lit("\tNM:i:"), F.col("nm").cast("string")), F.lit(""))).alias("value"))


def reference_stretch(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """Alignments with `reference`, the stretch of their reference (rname, sequence) that they cover."""
    stretch = F.substring("sequence", F.col("start") + 1, F.col("end") - F.col("start"))
    return alignments.join(references.select("rname", "sequence"), "rname").withColumn("reference", stretch).drop("sequence")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(rname, sequence) of a FASTA file: what stands between two `>` is one row of the text reader."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    name = F.split(F.regexp_replace(head, r"\s.*$", ""), " ")[0]
    return records.select(name.alias("rname"), F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "").alias("sequence"))
