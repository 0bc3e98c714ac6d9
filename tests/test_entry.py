import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"


def test_names():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["kmer_counts_canonical", "kmer_cutoff", "solid_bases", "regions_ping_order", "vote_winners", "two_sided_candidates", "read_lengths_offsets", "read_partition_ntile", "p5_found", "p5_loaded", "p5_streams", "tp_fp_fn", "lookahead_confirmed", "lookbehind_confirmed", "one_sided_first_step", "one_sided_codes", "correct_reads_full", "best_alternative_strand", "all_solid_reads", "two_sided_applied_twice", "correct_fastq", "fastq_by_suffix", "sam_rates", "sam_confusion"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("seq_reads", "parse_results", "raw_records"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    sql = db.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(sql.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*sql.columns).collect()))) == sorted(map(str, sql.fetchall()))
