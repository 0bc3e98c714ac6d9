"""The core queries: each takes (spark, sf_dir) and returns a DataFrame. kmerloom.oracle has SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators import evaluate, interior, kmers, mutations, onesided, reads, records, solidity, spectrum, steps
from kmerloom.oracle import ORACLE as ORACLE
from kmerloom.plans import correction
from kmerloom.sources import alignments, fastq
from kmerloom.streaming import counts as stream
from kmerloom.tables import remove_at_end, shared_folder, stage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _reads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return reads.latest(table(spark, d, "seq_reads"), list(columns) if columns else None)


def _read_and_spectrum(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _reads(spark, d, "seq")
    return rows, correction.trusted_spectrum(rows)


# Reads


@query
def reads_latest(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d)


@query
def read_lengths_offsets(spark: SparkSession, d: str) -> DataFrame:
    return reads.offsets(_reads(spark, d, "seq"))


@query
def read_length_max(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "seq").agg(F.max(F.length("seq")).alias("longest"))


@query
def read_partition_ntile(spark: SparkSession, d: str) -> DataFrame:
    return reads.even_ranges(_reads(spark, d, "loaded_at"), 12)


@query
def read_range(spark: SparkSession, d: str) -> DataFrame:
    """The 500 records from number 250 on."""
    placed = reads.with_running(_reads(spark, d, "header", "seq"), "read_id", into="ordinal")
    return placed.where("ordinal >= 250 and ordinal < 750")


@query
def read_count(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "loaded_at").agg(F.count("*").alias("n_reads"))


@query
def id_suffix_parse(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "header").select("read_id", B.id_suffix(F.col("header")).alias("row_index"))


@query
def id_suffix_join(spark: SparkSession, d: str) -> DataFrame:
    """Parsed reads looked up by the number in a read's header."""
    rows = _reads(spark, d, "header").select("read_id", B.id_suffix(F.col("header")).alias("row_index"))
    other = table(spark, d, "parse_results").groupBy(F.col("read_id").alias("row_index")).agg(F.max("reads").alias("reads"))
    return rows.join(other, "row_index").select("read_id", "row_index", "reads")


@query
def fastq_file_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("run_id", B.file_stem(F.col("fastq_file")).alias("stem"))


@query
def seq_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    digits = B.encode_digits(F.col("seq"))
    return _reads(spark, d, "seq").where("seq is not null").select("read_id", digits.alias("digits"), B.decode_digits(digits).alias("decoded"))


@query
def read_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d, "seq").where("seq is not null").select("read_id", B.reverse_complement(F.col("seq")).alias("rc"))


@query
def replace_quality(spark: SparkSession, d: str) -> DataFrame:
    """The i-th read with the i-th valid quality of raw_records; the longer side is cut."""
    good, _ = records.load_records(table(spark, d, "raw_records").select("record_id", "raw_line"))
    quality = good.select("record_id", F.col("parsed.quality").alias("new_qual"))
    return reads.zipped(_reads(spark, d, "header", "seq"), "read_id", quality, "record_id").select("read_id", "header", "seq", "new_qual")


@query
def fastq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as FASTQ and read again."""
    spark.dataSource.register(fastq.FastqDataSource)
    rows = _reads(spark, d, "seq", "qual", "header").where("length(seq) = length(qual) and length(seq) > 0 and header is not null")
    path = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    rows.select(F.col("read_id").cast("string").alias("header"), "seq", "qual").write.format("fastq").mode("append").save(path)
    return spark.read.format("fastq").option("split", 1 << 20).load(path).select(F.col("header").cast("bigint").alias("read_id"), "seq", "qual")


# K-mers


@query
def kmer_windows(spark: SparkSession, d: str) -> DataFrame:
    return kmers.windows(_reads(spark, d, "seq")).select("read_id", "pos", "kmer", B.key_kmer(F.col("key")).alias("canonical"), "key")


@query
def kmer_counts_forward(spark: SparkSession, d: str) -> DataFrame:
    return kmers.counted_forward(_reads(spark, d, "seq"))


@query
def kmer_counts_canonical(spark: SparkSession, d: str) -> DataFrame:
    return kmers.counted(_reads(spark, d, "seq"))


@query
def kmer_counts_merged(spark: SparkSession, d: str) -> DataFrame:
    """Partial counts of whole runs, merged."""
    return kmers.merged(table(spark, d, "kmer_counts"))


@query
def kmer_nonunique(spark: SparkSession, d: str) -> DataFrame:
    return kmers.counted(_reads(spark, d, "seq"), least=2)


@query
def repeated_kmers(spark: SparkSession, d: str) -> DataFrame:
    """Forward k-mers seen again, with the number of repetitions."""
    return kmers.counted_forward(_reads(spark, d, "seq")).where("n >= 2").select("kmer", (F.col("n") - 1).alias("repeats"))


@query
def kmer_decoded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kmers").where("key is not null").select("key", "canonical").distinct()
    return rows.select("key", B.key_kmer(F.col("key")).alias("decoded"), (B.kmer_key(F.col("canonical")) == F.col("key")).alias("same"))


@query
def kmer_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The distinct k-mers, one base on and one base back."""
    km = F.col("kmer")
    return table(spark, d, "kmers").where("canonical is not null").select("kmer").distinct().select("kmer", B.forward_base(km, F.lit("A")).alias("on"), B.backward_base(km, F.lit("T")).alias("back"))


@query
def kmer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.histogram(kmers.counted(_reads(spark, d, "seq"), least=2))


@query
def kmer_density(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.density(spectrum.histogram(kmers.counted(_reads(spark, d, "seq"), least=2))).select("bin", "kmers")


@query
def kmer_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.cutoff(spectrum.histogram(kmers.counted(_reads(spark, d, "seq"), least=2)))


@query
def spectrum_trusted(spark: SparkSession, d: str) -> DataFrame:
    return correction.trusted_spectrum(_reads(spark, d, "seq"))


@query
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """parse_results as a stream of one file after the other; the counts after all of it."""
    rows = table(spark, d, "parse_results")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(d, pathGlobFilter="parse_results*") if rows.inputFiles()[0].endswith("parse_results.parquet") else spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/parse_results.parquet")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.count_stream(source.select(F.col("reads").alias("seq")), f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return stream.counts_so_far(spark, f"{base}/counts")


# Lookups in the spectrum


@query
def kmer_membership_semi(spark: SparkSession, d: str) -> DataFrame:
    rows, trusted = _read_and_spectrum(spark, d)
    return kmers.windows(rows).join(trusted.select("key"), "key", "left_semi").select("read_id", "pos")


@query
def kmer_membership_anti(spark: SparkSession, d: str) -> DataFrame:
    rows, trusted = _read_and_spectrum(spark, d)
    return mutations.untrusted(rows, trusted).select("read_id", "pos")


@query
def kmer_multiplicity_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows, trusted = _read_and_spectrum(spark, d)
    return solidity.multiplicities(kmers.windows(rows), trusted).select("read_id", "pos", "multiplicity")


@query
def solid_bases(spark: SparkSession, d: str) -> DataFrame:
    return solidity.solid_bases(*_read_and_spectrum(spark, d))


@query
def solid_bases_forward(spark: SparkSession, d: str) -> DataFrame:
    """Bases that a trusted k-mer covers as it stands, not by its reverse complement."""
    return solidity.solid_bases(*_read_and_spectrum(spark, d), both_strands=False)


@query
def trusted_regions(spark: SparkSession, d: str) -> DataFrame:
    return solidity.trusted_regions(*_read_and_spectrum(spark, d))


@query
def trusted_base_regions(spark: SparkSession, d: str) -> DataFrame:
    return solidity.trusted_base_regions(solid_bases(spark, d))


@query
def regions_ping_order(spark: SparkSession, d: str) -> DataFrame:
    return solidity.ranked_regions(trusted_regions(spark, d), True)


@query
def regions_pong_order(spark: SparkSession, d: str) -> DataFrame:
    return solidity.ranked_regions(trusted_regions(spark, d), False)


@query
def all_solid_reads(spark: SparkSession, d: str) -> DataFrame:
    """Empty reads too: they have no base that isn't solid."""
    rows, trusted = _read_and_spectrum(spark, d)
    return solidity.all_solid(solidity.solid_bases(rows, trusted), rows)


@query
def solid_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return solidity.diagnostics(solid_bases(spark, d))


# Alternatives and corrections


@query
def mutation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mutations.candidates(*_read_and_spectrum(spark, d))


@query
def best_alternative(spark: SparkSession, d: str) -> DataFrame:
    """Of each place's candidates the one with the largest multiplicity; of equal ones the first in the alphabet."""
    found = mutation_candidates(spark, d).groupBy("read_id", "pos", "base").agg(F.max("multiplicity").alias("multiplicity"))
    by = Window.partitionBy("read_id", "pos").orderBy(F.desc("multiplicity"), "base")
    return found.withColumn("turn", F.row_number().over(by)).where("turn = 1").drop("turn")


@query
def best_alternative_strand(spark: SparkSession, d: str) -> DataFrame:
    """For each place of an untrusted k-mer, the most frequent of its changes; of equal ones the first on the canonical strand."""
    return mutations.best_of_kmer(*_read_and_spectrum(spark, d))


@query
def best_alternative_last(spark: SparkSession, d: str) -> DataFrame:
    """The same, of equal ones the last in the alphabet."""
    return mutations.best_of_kmer(*_read_and_spectrum(spark, d), last_wins=True)


@query
def lookahead_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """The bases that make the k-mer behind a trusted region trusted, and whether the k-mers that follow confirm them."""
    found = steps.first_steps(*_read_and_spectrum(spark, d), ahead=4)
    return found.where("to_right").select("read_id", "lo", "pos", "base", "multiplicity", "confirmed")


@query
def lookbehind_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """The same for the k-mer before a trusted region, confirmed by those that come before."""
    found = steps.first_steps(*_read_and_spectrum(spark, d), ahead=4)
    return found.where("not to_right").select("read_id", "lo", "pos", "base", "multiplicity", "confirmed")


@query
def one_sided_first_step(spark: SparkSession, d: str) -> DataFrame:
    """The first change of each one-sided walk of the first pass."""
    return steps.chosen(steps.first_steps(*_read_and_spectrum(spark, d), ahead=4))


@query
def one_sided_codes(spark: SparkSession, d: str) -> DataFrame:
    """What the first one-sided pass returns for each read of 16 letters or more: -1 if all is solid, else how many changes it logs."""
    return onesided.pass_codes(*_read_and_spectrum(spark, d), ["read_id"])


@query
def one_sided_report(spark: SparkSession, d: str) -> DataFrame:
    """The return codes of the first pass: reads that are all solid, without a change, with changes, and all changes."""
    code = F.col("code")
    return one_sided_codes(spark, d).agg(F.count_if(code == -1).alias("all_solid"), F.count_if(code == 0).alias("unchanged"), F.count_if(code > 0).alias("changed"), F.coalesce(F.sum(F.when(code > 0, code)), F.lit(0)).alias("changes"))


@query
def vote_matrix(spark: SparkSession, d: str) -> DataFrame:
    return mutations.votes(mutation_candidates(spark, d))


@query
def vote_winners(spark: SparkSession, d: str) -> DataFrame:
    return mutations.winners(vote_matrix(spark, d))


@query
def vote_place_winners(spark: SparkSession, d: str) -> DataFrame:
    return mutations.place_winners(vote_matrix(spark, d))


@query
def vote_winners_limited(spark: SparkSession, d: str) -> DataFrame:
    """The winners without those in a k-mer that has more than 2 of them."""
    return mutations.within_limit(vote_winners(spark, d).select("read_id", "pos", "base"), _reads(spark, d, "seq"), 2)


@query
def vote_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Reads with votes, the most votes of one change, and all votes."""
    v = vote_matrix(spark, d)
    return v.agg(F.countDistinct("read_id").alias("reads"), F.max("votes").alias("most"), F.sum("votes").alias("votes"))


@query
def two_sided_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mutations.two_sided(*_read_and_spectrum(spark, d))


@query
def two_sided_fix_first(spark: SparkSession, d: str) -> DataFrame:
    return mutations.first_fix(two_sided_candidates(spark, d))


@query
def two_sided_interior(spark: SparkSession, d: str) -> DataFrame:
    rows, trusted = _read_and_spectrum(spark, d)
    return mutations.interior_fixes(mutations.two_sided(rows, trusted), rows)


@query
def two_sided_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The same from left to right, each place judged on the read with the fixes before it."""
    return interior.interior_in_order(*_read_and_spectrum(spark, d))


@query
def two_sided_applied(spark: SparkSession, d: str) -> DataFrame:
    """Reads after one round of the two-sided fix."""
    rows, trusted = _read_and_spectrum(spark, d)
    return mutations.two_sided_corrected(rows, trusted, rounds=1)


@query
def two_sided_applied_twice(spark: SparkSession, d: str) -> DataFrame:
    """Reads after both rounds of the two-sided fix."""
    rows, trusted = _read_and_spectrum(spark, d)
    return mutations.two_sided_corrected(rows, trusted)


@query
def correct_reads_full(spark: SparkSession, d: str) -> DataFrame:
    return correction.correct(_reads(spark, d, "seq", "header", "qual"), ["read_id", "header", "qual"])


@query
def corrections_made(spark: SparkSession, d: str) -> DataFrame:
    """How many bases the correction changed, by run."""
    done = correction.correct(_reads(spark, d, "seq", "run_id"), ["read_id", "run_id", "seq"])
    changed = F.size(F.filter(F.arrays_zip(F.split("seq", "").alias("a"), F.split("corrected", "").alias("b")), lambda p: p["a"] != p["b"]))
    return done.where("seq is not null").groupBy("run_id").agg(F.count("*").alias("n_reads"), F.count_if(changed > 0).alias("reads_changed"), F.sum(changed.cast("long")).alias("bases_changed"))


@query
def solid_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many bases the two-sided fix makes solid."""
    rows, trusted = _read_and_spectrum(spark, d)
    return solidity.changes_in_reads(mutations.two_sided_corrected(rows.withColumn("before", F.col("seq")), trusted, rounds=1), trusted)


# Evaluation


def _two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reads as sequenced, and as parsed."""
    parsed = table(spark, d, "parse_results").where("read_id is not null").groupBy("read_id").agg(F.max("reads").alias("seq"))
    return _reads(spark, d, "seq"), parsed


@query
def read_diff_left_join(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.read_diff(*_two_versions(spark, d))


@query
def position_intersection(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.shared_positions(*_two_versions(spark, d))


@query
def tp_fp_fn(spark: SparkSession, d: str) -> DataFrame:
    """One round of two-sided fixes judged with the parsed reads as reference; tp_fp_fn_full judges the whole correction."""
    rows, trusted = _read_and_spectrum(spark, d)
    fixed = mutations.two_sided_corrected(rows, trusted, rounds=1).select("read_id", F.col("seq").alias("corrected"))
    _, parsed = _two_versions(spark, d)
    triples = rows.withColumnRenamed("seq", "original").join(fixed, "read_id").join(parsed.withColumnRenamed("seq", "reference"), "read_id")
    return evaluate.confusion(triples)


@query
def tp_fp_fn_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole correction judged with the parsed reads as reference."""
    return correction.confusion(*_two_versions(spark, d))


@query
def tp_fp_fn_twice(spark: SparkSession, d: str) -> DataFrame:
    """Both rounds of two-sided fixes judged with the parsed reads as reference."""
    rows, trusted = _read_and_spectrum(spark, d)
    fixed = mutations.two_sided_corrected(rows, trusted).select("read_id", F.col("seq").alias("corrected"))
    _, parsed = _two_versions(spark, d)
    return evaluate.confusion(rows.withColumnRenamed("seq", "original").join(fixed, "read_id").join(parsed.withColumnRenamed("seq", "reference"), "read_id"))


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    """Reads in the form of alignments: flag 4 without a sequence, the first quality as mapping quality, the number of N as edit distance."""
    flag = F.when(F.col("seq").isNull(), 4).otherwise(0)
    return _reads(spark, d, "seq", "qual").select(flag.alias("flag"), (F.ascii("qual") - 33).alias("mapq"), F.length(F.translate("seq", "ACGTRYKMSWacgtn", "")).alias("nm"))


@query
def unique_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.unique_rate(_alignments(spark, d))


@query
def mapped_with_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mapped_with_errors(_alignments(spark, d))


# FASTQ, SAM and FASTA text: written to the shared folder from the tables, and read


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    """All reads with their headers as FASTQ, in the order of read_id, and read again with their numbers. Records of unequal lengths are malformed."""
    spark.dataSource.register(fastq.FastqDataSource)
    path = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    fastq.write_fastq(_reads(spark, d, "seq", "qual", "header"), path, order="read_id")
    remove_at_end(spark, path)
    return fastq.with_ordinals(spark.read.format("fastq").option("split", 1 << 20).load(path)).drop("file", "byte_offset")


def _rewritten(spark: SparkSession, records: DataFrame, seq: str, order: str) -> DataFrame:
    path = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    fastq.write_fastq(records, path, seq=seq, order=order)
    remove_at_end(spark, path)
    return fastq.with_ordinals(spark.read.format("fastq").option("split", 1 << 20).load(path)).select(F.col("read_id").alias("ordinal"), "header", "seq", "qual")


@query
def fastq_range(spark: SparkSession, d: str) -> DataFrame:
    """500 records of the file from number 250 on."""
    return _fastq(spark, d).where("read_id >= 250 and read_id < 750").select(F.col("read_id").alias("ordinal"), "header", "seq", "qual")


@query
def correct_fastq(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ in, the whole correction, FASTQ out in the same order with the same headers and qualities, read again."""
    records = stage(_fastq(spark, d), "fastq-records")
    done = correction.correct(records, ["read_id", "header", "qual"])
    return _rewritten(spark, done, "corrected", "read_id")


@query
def fastq_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ records with the parsed read that the number in their header names, written under the old header and quality, read again."""
    records = _fastq(spark, d).withColumn("row_index", B.id_suffix(F.col("header")))
    other = table(spark, d, "parse_results").where("reads is not null").groupBy(F.col("read_id").alias("row_index")).agg(F.max("reads").alias("other"))
    return _rewritten(spark, records.join(other, "row_index"), "other", "read_id")


def _sam(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/sam-{uuid.uuid4().hex}"
    head = spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value"))
    head.unionByName(alignments.sam_lines(rows)).write.text(path)
    remove_at_end(spark, path)
    return alignments.sam(spark.read.text(path))


FLANK = "ACGTACG"


def _aligned(rows: DataFrame) -> DataFrame:
    """Reads (read_id, seq, mapq, gap, clipped) as alignments, each to a sequence of its own behind FLANK: some with a gap, some with their ends clipped."""
    n, there = F.length("seq"), F.length("seq") > 10
    plain = F.concat(n.cast("string"), F.lit("M"))
    gap = F.concat(F.lit("4M2D"), (n - 4).cast("string"), F.lit("M"))
    clip = F.concat(F.lit("2S"), (n - 2).cast("string"), F.lit("M"))
    mapped = F.coalesce(n, F.lit(0)) > 0
    cigar = F.when(there & F.col("gap"), gap).when(there & F.col("clipped"), clip).otherwise(plain)
    start = F.when(there & F.col("clipped") & ~F.col("gap"), len(FLANK) + 2).otherwise(len(FLANK))
    return rows.select(F.col("read_id").alias("qname"), F.when(mapped, 0).otherwise(4).alias("flag"), F.when(mapped, F.concat(F.lit("r"), "read_id")).alias("rname"), F.when(mapped, start).alias("start"),
                       "mapq", F.when(mapped, cigar).alias("cigar"), "seq", F.when(mapped, F.length(F.translate("seq", "ACGTRYKMSWacgtn", ""))).alias("nm"))


def _originals(spark: SparkSession, d: str) -> DataFrame:
    mapq = F.greatest(F.ascii("qual") - 33, F.lit(0))
    return _aligned(_reads(spark, d, "seq", "qual").select("read_id", "seq", F.coalesce(mapq, F.lit(0)).alias("mapq"), (F.pmod("read_id", F.lit(3)) == 1).alias("gap"), F.lit(False).alias("clipped")))


@query
def sam_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of unique mappings, and mapped reads with errors, of alignments read from SAM text."""
    found = _sam(spark, _originals(spark, d))
    return evaluate.unique_rate(found).crossJoin(evaluate.mapped_with_errors(found).withColumnRenamed("n", "with_errors"))  # one row each


@query
def sam_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The whole correction judged by alignments of the reads before and after it (SAM text) to reference sequences (FASTA text)."""
    rows, parsed = _two_versions(spark, d)
    fixed = correction.correct(rows, ["read_id"]).select("read_id", F.col("corrected").alias("seq"), F.lit(60).alias("mapq"), F.lit(False).alias("gap"), (F.pmod("read_id", F.lit(5)) == 2).alias("clipped"))
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    parsed.where("seq is not null").select(F.concat(F.lit(">r"), "read_id", F.lit(" parsed\n" + FLANK), "seq").alias("value")).write.text(path)
    remove_at_end(spark, path)
    before = alignments.reference_stretch(_sam(spark, _originals(spark, d)).where("flag & 4 = 0"), alignments.fasta(spark, path))
    after = _sam(spark, _aligned(fixed)).where("flag & 4 = 0")
    first = before.select("qname", "reference", F.col("seq").alias("original"), F.col("start").alias("original_start"), alignments.aligned_positions(F.col("start"), F.col("cigar")).alias("original_at"))
    second = after.select("qname", F.col("seq").alias("corrected"), F.col("start").alias("corrected_start"), alignments.aligned_positions(F.col("start"), F.col("cigar")).alias("corrected_at"))
    return evaluate.aligned_confusion(first.join(second, "qname"))


# Rows that fail to parse


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_records(table(spark, d, "raw_records").select("record_id", "raw_line"))
    return parsed.where("parsed.reason is not null").select("record_id", F.col("parsed.reason").alias("reason"))


@query
def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows, typed."""
    good, _ = records.load_records(table(spark, d, "raw_records").select("record_id", "raw_line"))
    return good.select("record_id", "parsed.header", "parsed.seq", "parsed.quality")


@query
def p5_streams(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each file as texts of up to 64 lines, parsed as they stand: every record, every fault, and where reading went on after a broken quote."""
    texts = records.as_streams(table(spark, d, "raw_records"), "raw_file", "line_no", "record_id", "raw_line")
    parsed = records.parse_streams(texts, "body", ["raw_file", "block"])
    return parsed.select("raw_file", "block", "record_start", "header", "seq", "quality", "reason", "resumed_at")
