import random

from brute import counts
from pyspark.sql import functions as F

from kmerloom.operators import evaluate, reads
from kmerloom.sources import alignments, fastq
from kmerloom.streaming import counts as stream


def test_latest_takes_the_newest_and_keeps_nulls_last(spark):
    rows = [(1, None, "A", "x"), (1, "2024-01-02", "C", "y"), (1, "2024-01-01", "G", "z"), (2, None, None, None), (2, None, None, None), (None, None, "T", "t")]
    df = spark.createDataFrame(rows, "read_id LONG, loaded_at STRING, seq STRING, extra STRING")
    for c in ("sequenced_at", "header", "qual", "run_id", "sample_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = {r.read_id: r.seq for r in reads.latest(df.withColumn("lane", F.lit(1))).collect()}
    assert got == {1: "C", 2: None}


def test_running_order_over_many_blocks(spark):
    r = random.Random(1)
    keys = sorted(r.sample(range(-5000, 100_000), 300)) + [100_001] * 3
    df = spark.createDataFrame([(k, None if i % 7 == 0 else i) for i, k in enumerate(keys)], "k LONG, v INT")
    got = reads.with_running(df, "k", "v", block=1000).collect()
    total = 0
    for row in sorted(got, key=lambda x: (x.k, x.v is not None, x.v)):
        assert row.before == total
        total += row.v or 0
    ranks = sorted(x.before for x in reads.with_running(df, "k", block=1000).collect())
    assert ranks == list(range(len(keys)))
    assert reads.with_running(df.limit(0), "k").count() == 0


def test_running_order_of_sparse_keys(spark):
    r = random.Random(4)
    keys = sorted({r.randrange(-(2**63), 2**63) for _ in range(400)} | {0, 1, 2, 2**63 - 1, -(2**63)})
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k LONG, v INT")
    assert {x.k: x.before for x in reads.with_running(df, "k", block=1 << 16).collect()} == {k: i for i, k in enumerate(keys)}


def test_even_ranges_and_zip(spark):
    df = spark.range(10).withColumnRenamed("id", "read_id")
    assert [tuple(r) for r in reads.even_ranges(df, 3).orderBy("part").collect()] == [(1, 0, 3, 4), (2, 4, 6, 3), (3, 7, 9, 3)]
    assert [r.n_reads for r in reads.even_ranges(df.limit(2), 3).orderBy("part").collect()] == [1, 1]
    other = spark.createDataFrame([(50, "a"), (7, "b")], "o LONG, v STRING")
    assert [(r.read_id, r.v) for r in reads.zipped(df, "read_id", other, "o").orderBy("ordinal").collect()] == [(0, "b"), (1, "a")]


def test_fastq_splits_agree_and_bad_records_are_dropped(spark, tmp_path):
    r = random.Random(2)
    spark.dataSource.register(fastq.FastqDataSource)
    rows = [(f"r-{i}", s, "".join(r.choice("@+#F:,!") for _ in s)) for i in range(300) for s in ["".join(r.choice("ACGTN") for _ in range(r.randint(1, 90)))]]
    path = str(tmp_path / "one.fastq")
    with open(path, "w") as f:
        for h, s, q in rows:
            f.write(f"@{h}\n{s}\n+\n{q}\n")
        f.write("@short\nACGT\n+\nFF\n@last\nAC\n+\nFF")
    for split in (97, 1000, 1 << 20):
        df = spark.read.format("fastq").option("split", split).load(path)
        got = fastq.with_ordinals(df).orderBy("read_id").collect()
        assert [(g.header, g.seq, g.qual) for g in got] == [*rows, ("last", "AC", "FF")]
    assert [g.header for g in fastq.record_range(df, 5, 3).orderBy("read_id").collect()] == ["r-5", "r-6", "r-7"]
    out = str(tmp_path / "out")
    df.select("header", "seq", "qual").write.format("fastq").mode("append").save(out)
    df.limit(2).select("header", "seq", "qual").write.format("fastq").mode("append").save(out)
    assert spark.read.format("fastq").load(out).count() == 303
    df.limit(4).select("header", "seq", "qual").write.format("fastq").mode("overwrite").save(out)
    assert spark.read.format("fastq").load(out).count() == 4
    several = fastq.with_ordinals(spark.read.format("fastq").load(out)).orderBy("read_id").collect()
    assert [x.read_id for x in several] == list(range(len(several)))
    odd = spark.createDataFrame([("a\nb", "AC", "FF"), (None, None, None)], "header STRING, seq STRING, qual STRING")
    fastq.write_fastq(odd, str(tmp_path / "odd"))
    assert {(x.header, x.seq) for x in spark.read.format("fastq").load(str(tmp_path / "odd")).collect()} == {("a b", "AC"), ("", "")}
    open(tmp_path / "empty.fastq", "w").close()
    assert spark.read.format("fastq").load(str(tmp_path / "empty.fastq")).count() == 0


def test_sam_and_rates(spark):
    lines = ["@HD\tVN:1", "q1\t0\tc\t3\t60\t2M1D2M\t*\t0\t0\tACGT\tFFFF\tNM:i:2", "q2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tFF", "broken"]
    df = alignments.sam(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    assert [(r.qname, r.start, r.end, r.nm) for r in df.orderBy("qname").collect()] == [("q1", 2, 7, 2), ("q2", -1, -1, None)]
    assert tuple(evaluate.unique_rate(df).first()) == (2, 1, 50)
    assert evaluate.mapped_with_errors(df).first().n == 1
    assert alignments.reference_stretch(df, spark.createDataFrame([("c", "AACCGGTT")], "rname STRING, sequence STRING")).first().reference == "CCGGT"
    assert tuple(evaluate.unique_rate(df.limit(0)).first()) == (0, 0, None)


def test_confusion_on_aligned_places(spark):
    from pyspark.sql import functions as F

    places = lambda start, cigar: spark.range(1).select(alignments.aligned_positions(F.lit(start), F.lit(cigar)).alias("p")).first().p
    assert places(5, "2S3M1I2D2=1X4N1M") == [5, 6, 7, 10, 11, 12, 17] and places(3, "*") == [] and places(0, "4H") == []
    rows = [([2, 3, 4, 5], [3, 4, 5, 9], 2, 3, "ACGT", "CGTA", "ACCTT"), ([7], [8], 7, 8, "A", "C", "A"), ([1, 2], [1, 2], 1, 1, "AG", "AC", "AG")]
    df = spark.createDataFrame(rows, "original_at ARRAY<INT>, corrected_at ARRAY<INT>, original_start INT, corrected_start INT, original STRING, corrected STRING, reference STRING")
    assert tuple(evaluate.aligned_confusion(df).first()) == (0, 1, 1) and tuple(evaluate.aligned_confusion(df.limit(0)).first()) == (0, 0, 0)


def test_diff_and_confusion(spark):
    a = spark.createDataFrame([(1, "ACG"), (2, "A"), (3, None), (4, None)], "read_id INT, seq STRING")
    b = spark.createDataFrame([(1, "ACT"), (3, None), (4, "A"), (9, "A")], "read_id INT, seq STRING")
    assert {tuple(r) for r in evaluate.read_diff(a, b).collect()} == {(1, "differs"), (2, "missing"), (4, "differs")}
    assert {tuple(r) for r in evaluate.shared_positions(a, b).collect()} == {(1, 3, 2)}
    t = spark.createDataFrame([("ACGT", "AGGA", "ACTAAA"), (None, "A", "A"), ("", "A", "A")], "reference STRING, original STRING, corrected STRING")
    assert tuple(evaluate.confusion(t).first()) == (1, 1, 1)


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGT") for _ in range(40)) for _ in range(30)]
    for i in range(3):
        spark.createDataFrame([(s,) for s in [*seqs[i::3], seqs[0]]], "seq STRING").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq STRING").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream.count_stream(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.key: r.multiplicity for r in stream.counts_so_far(spark, str(tmp_path / "out")).collect()}
    want = counts([*seqs, *[seqs[0]] * 3], 16)
    assert got == {int("".join(str("ACGT".index(c) + 1) for c in g)): n for g, n in want.items()}


def test_fasta_and_ordered_fastq(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 first\nACGT\nAC\n>c2\nGG\n")
    assert sorted(tuple(r) for r in alignments.fasta(spark, str(tmp_path / "r.fa")).collect()) == [("c1", "ACGTAC"), ("c2", "GG")]
    spark.dataSource.register(fastq.FastqDataSource)
    df = spark.createDataFrame([(i, f"h{i}", "A" * (i + 1), "F" * (i + 1)) for i in range(50)], "read_id INT, header STRING, fixed STRING, qual STRING").repartition(7)
    fastq.write_fastq(df, str(tmp_path / "o"), seq="fixed", order="read_id")
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").iterdir()))
    assert text == "".join(f"@h{i}\n{'A' * (i + 1)}\n+\n{'F' * (i + 1)}\n" for i in range(50))
