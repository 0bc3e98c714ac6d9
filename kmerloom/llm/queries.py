"""The queries of this subpackage; ORACLE has SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm import encoding, heavy, packing, seen, sketches, spans, truncation
from kmerloom.tables import stage, table

CAPACITY, SHARE_PER_MILLE, TOP = 1024, 2, 100


GROUPS = ["day", "run_id", "sample_id", "lane"]
#: Every subset of GROUPS; the finest is GROUPS itself.
NEAR_SETS = [["run_id", "sample_id"], ["run_id", "sample_id", "lane"], ["day", "run_id", "sample_id"], GROUPS]
FAR_SETS = [[], ["day"], ["run_id"], ["sample_id"], ["lane"], ["day", "run_id"], ["day", "sample_id"], ["day", "lane"], ["run_id", "lane"], ["sample_id", "lane"],
            ["day", "run_id", "lane"], ["day", "sample_id", "lane"]]


def _counted(rows: DataFrame, hashes: Column) -> DataFrame:
    """Distinct counts of every set: the finest sketches meet by run and sample, so that their sets need no more shuffle."""
    partial = sketches.partial_sketches(rows, GROUPS, hashes)
    return sketches.cube(partial, GROUPS, ["run_id", "sample_id"], [*NEAR_SETS, *FAR_SETS], salts=sketches.salts_for(rows))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct k-mers of parse_results per day, group and combination of groups."""
    rows = table(spark, d, "parse_results").withColumn("day", F.to_date("parsed_at"))
    return _counted(rows, sketches.hashed("kmers"))


def p1_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of p1_counts, the groups with fewer k-mers than a sketch holds: there the count is exact."""
    n = F.col("estimate").cast("long")
    return p1_counts(spark, d).where(F.col("hashes") < sketches.K).select("grouping", *GROUPS, n.alias("n"), F.col("lower").cast("long").alias("lower"), F.col("upper").cast("long").alias("upper"))


def p1_canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct canonical k-mers of kmers, by day and groups of their read's latest load."""
    newest = F.max(F.struct("loaded_at", "sequenced_at", "run_id", "sample_id", "lane")).alias("r")
    reads = table(spark, d, "seq_reads").groupBy("read_id").agg(newest).select("read_id", F.to_date("r.sequenced_at").alias("day"), "r.run_id", "r.sample_id", "r.lane")
    kmers = table(spark, d, "kmers").where("canonical is not null").select("read_id", F.xxhash64("canonical").alias("h"))
    return _counted(kmers.join(reads, "read_id"), F.array("h"))


def p1_day_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For each run and day, the k-mers shared with the run's day before, in either of them, and new on that day."""
    rows = table(spark, d, "parse_results").withColumn("day", F.to_date("parsed_at"))
    days = sketches.merged_sketches(sketches.partial_sketches(rows, ["run_id", "day"], sketches.hashed("kmers")), ["run_id", "day"], ["run_id", "day"])
    before = F.lag("sketch").over(Window.partitionBy("run_id").orderBy("day"))
    return sketches.compared(days.withColumn("before", before), ["run_id", "day"], "sketch", "before")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "parse_results"), "read_id", "reads")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each read, how many of its bases are shared."""
    return spans.shared_shares(table(spark, d, "parse_results"), "read_id", "reads")


def p2_spans_40(spark: SparkSession, d: str) -> DataFrame:
    """Shared spans of at least 40 bases."""
    return spans.shared_spans(table(spark, d, "parse_results"), "read_id", "reads", 40)


def p2_spans_100(spark: SparkSession, d: str) -> DataFrame:
    """Shared spans of at least 100 bases."""
    return spans.shared_spans(table(spark, d, "parse_results"), "read_id", "reads", 100)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "parse_results"), "arrival_no", "run_id", "kmers")


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """The rate of wrong answers: of certainly absent keys, how many the filters claim to know."""
    return seen.seen_before(table(spark, d, "parse_results"), "arrival_no", "run_id", "kmers", audit=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.at_least_share(table(spark, d, "kmer_counts"), "canonical", "multiplicity", SHARE_PER_MILLE).select(F.col("value").alias("canonical"))


def p4_counts_top(spark: SparkSession, d: str) -> DataFrame:
    """The report of the most frequent canonical k-mers by summed multiplicity."""
    return heavy.most_frequent(table(spark, d, "kmer_counts"), "canonical", "multiplicity", TOP)


def p4_counts_top_exact(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent canonical k-mers with their exact sums."""
    return heavy.exact_top(table(spark, d, "kmer_counts"), "canonical", "multiplicity", TOP)


def p4_rows_top_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same by rows of kmers."""
    return heavy.exact_top(table(spark, d, "kmers"), "canonical", None, TOP)


def p4_rows_top(spark: SparkSession, d: str) -> DataFrame:
    """The same by rows of kmers."""
    return heavy.most_frequent(table(spark, d, "kmers"), "canonical", None, TOP)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "text", ["doc_id"])


def _containers(spark: SparkSession, d: str) -> DataFrame:
    sized = p6_ids(spark, d).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.pack(sized, "doc_id", "n_tokens", CAPACITY)


def p7_assigned(spark: SparkSession, d: str) -> DataFrame:
    return _containers(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled, beside the containers and the lower bound of the linear program and the room that all tokens take."""
    placed = stage(_containers(spark, d).select("container", "piece_length"), "pack-fill")
    histogram = {r[0]: r[1] for r in placed.groupBy("piece_length").count().collect()}  # at most CAPACITY + 1 rows
    _, value, bound = packing.program(histogram, CAPACITY)
    used = placed.groupBy("container").agg(F.sum("piece_length").alias("used")).where("used > 0")
    total = used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"), F.lit(value).cast("long").alias("program_containers"), F.lit(float(bound)).alias("program_bound"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"), "doc_id", "source", "text").select(F.col("key").alias("doc_id"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts off."""
    return truncation.shares(table(spark, d, "documents"), "doc_id", "source", "text")


QUERIES = {
    "p1_counts": p1_counts, "p1_exact_groups": p1_exact_groups, "p1_canonical_counts": p1_canonical_counts, "p1_day_overlap": p1_day_overlap,
    "p2_found": p2_found, "p2_shares": p2_shares, "p2_spans_40": p2_spans_40, "p2_spans_100": p2_spans_100,
    "p3_found": p3_found, "p3_audit": p3_audit,
    "p4_found": p4_found, "p4_counts_top": p4_counts_top, "p4_rows_top": p4_rows_top,
    "p4_counts_top_exact": p4_counts_top_exact, "p4_rows_top_exact": p4_rows_top_exact,
    "p6_ids": p6_ids,
    "p7_assigned": p7_assigned, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_shares": p8_shares,
}


def _spans(least: int) -> str:
    return f"""
    WITH r AS (SELECT DISTINCT read_id, reads FROM parse_results WHERE reads IS NOT NULL AND read_id IS NOT NULL),
    w AS (SELECT DISTINCT read_id, i, substring(reads, i, {least}) AS s FROM (SELECT read_id, reads, unnest(range(1, length(reads) - {least - 2})) AS i FROM r)),
    v AS (SELECT * FROM w WHERE regexp_full_match(s, '[ACGT]+')),
    two AS (SELECT s FROM v GROUP BY s HAVING min(read_id) <> max(read_id)),
    hit AS (SELECT DISTINCT read_id, i - 1 AS a FROM v SEMI JOIN two USING (s)),
    o AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY read_id ORDER BY a) + {least} THEN 0 ELSE 1 END AS opens FROM hit),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY read_id ORDER BY a) AS run FROM o),
    f AS (SELECT read_id, CAST(min(a) AS INTEGER) AS span_start, CAST(max(a) + {least} AS INTEGER) AS span_end FROM g GROUP BY read_id, run)"""


_CUBE = ", ".join(f"({', '.join(s)})" for s in [*NEAR_SETS, *FAR_SETS])
_SET = "concat_ws(',', " + ", ".join(f"CASE WHEN GROUPING({g}) = 0 THEN '{g}' END" for g in GROUPS) + ")"

ORACLE = {
    "p1_exact_groups": f"""
        WITH k AS (SELECT CAST(parsed_at AS DATE) AS day, run_id, sample_id, lane, unnest(kmers) AS kmer FROM parse_results)
        SELECT {_SET} AS "grouping", day, run_id, sample_id, lane, count(DISTINCT kmer) AS n, count(DISTINCT kmer) AS lower, count(DISTINCT kmer) AS upper
        FROM k GROUP BY GROUPING SETS ({_CUBE}) HAVING count(DISTINCT kmer) BETWEEN 1 AND 1023""",
    "p2_found": f"{_spans(64)} SELECT read_id, span_start, span_end FROM f",
    "p2_spans_40": f"{_spans(40)} SELECT read_id, span_start, span_end FROM f",
    "p2_spans_100": f"{_spans(100)} SELECT read_id, span_start, span_end FROM f",
    "p2_shares": f"""{_spans(64)}, n AS (SELECT read_id, sum(span_end - span_start) AS shared FROM f GROUP BY read_id)
        SELECT read_id, CAST(coalesce(max(length(reads)), 0) AS INTEGER) AS bases, CAST(coalesce(any_value(shared), 0) AS BIGINT) AS shared_bases
        FROM parse_results LEFT JOIN n USING (read_id) WHERE read_id IS NOT NULL GROUP BY read_id""",
    "p3_found": """
        SELECT arrival_no, pos FROM (
            SELECT arrival_no, pos, kmer, row_number() OVER (PARTITION BY run_id, kmer ORDER BY arrival_no, pos) AS turn
            FROM (SELECT arrival_no, run_id, unnest(kmers) AS kmer, CAST(generate_subscripts(kmers, 1) - 1 AS INTEGER) AS pos FROM parse_results))
        WHERE turn > 1 AND kmer IS NOT NULL""",
    "p4_counts_top_exact": f"""
        SELECT canonical AS value, CAST(sum(coalesce(multiplicity, 0)) AS BIGINT) AS n FROM kmer_counts WHERE canonical IS NOT NULL GROUP BY canonical HAVING n > 0 ORDER BY n DESC, canonical LIMIT {TOP}""",
    "p4_rows_top_exact": f"SELECT canonical AS value, count(*) AS n FROM kmers WHERE canonical IS NOT NULL GROUP BY canonical ORDER BY n DESC, canonical LIMIT {TOP}",
    "p4_found": """
        SELECT canonical FROM kmer_counts WHERE canonical IS NOT NULL GROUP BY canonical
        HAVING coalesce(sum(multiplicity), 0) * 1000 >= 2 * (SELECT coalesce(sum(multiplicity), 0) FROM kmer_counts) AND sum(multiplicity) > 0""",
}
