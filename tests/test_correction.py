import os
import random
import re

import numpy as np
import pytest
from brute import canon, correct, counts, enc, grams, rc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom import queries
from kmerloom.functions import bases as B
from kmerloom.operators import interior, kmers, lookup, mutations, onesided, solidity, spectrum, steps, tally
from kmerloom.plans import correction


def key(g):
    return int("".join(str("ACGT".index(c) + 1) for c in g))


def held(spec):
    return onesided.Spectrum(np.array([key(g) for g in spec], np.int64), np.array(list(spec.values()), np.int64))


def noisy(seed, k, genome=200, reads=30, size=60, errors=0.03, letters="ACGT"):
    r = random.Random(seed)
    g = "".join(r.choice("ACGT") for _ in range(genome))
    out = []
    for _ in range(reads):
        i = r.randrange(genome - size)
        s = [r.choice(letters) if r.random() < errors else c for c in g[i : i + size]]
        out.append("".join(s) if r.random() < 0.5 else enc("".join(s)) if "N" in s else rc("".join(s)))
    return out


@pytest.mark.parametrize("k", [5, 8, 13, 16])
@pytest.mark.parametrize("seed", range(6))
def test_correction_equals_brute_force(k, seed):
    seqs = noisy(seed, k, letters="ACGTN" if seed % 2 else "ACGT", errors=0.02 + 0.01 * (seed % 3))
    spec = {g: n for g, n in counts(seqs, k).items() if n >= 2 + seed % 2}
    spec = {g: n % 7 + 1 for g, n in spec.items()}  # ties
    s = held(spec)
    for x in [*seqs, "", "ACG", "N" * 40, "G" * 40, "acgt" * 10, "ACGT" * 150]:
        assert onesided.Read(x, k, s).corrected() == correct(x, spec, k)


@pytest.mark.parametrize("read,k,edits", [("TTACGACTCAACGCAGCACGTACGTTACGTCCAGCA", 13, {2: "C"}), ("ACCACAGCACGAACGTACTT", 13, {3: "T"})])
def test_planted_edits_are_restored(read, k, edits):
    s = list(read)
    for i, c in edits.items():
        s[i] = c
    spec = {canon(g): 5 for g in grams(read, k)}
    assert onesided.Read("".join(s), k, held(spec)).corrected() == read


def test_solid_reads_and_short_ones_stay():
    read = "TTACGACTCAACGCAGCACGTACGTTACGTCCAGCA"
    spec = held({canon(g): 5 for g in grams(read, 16)})
    weak = onesided._weak_reads([read, read[:-1] + "T", None, "", "ACG", rc(read), "G" * 40, read[:8] + "T" + read[9:17], "N" * 20], 16, spec)
    assert weak.tolist() == [False, True, False, False, False, False, False, True, False]


@pytest.mark.parametrize("seed", range(4))
def test_only_reads_that_nothing_changes_are_passed_over(seed):
    seqs = noisy(seed, 11, genome=150, reads=40, size=40, errors=0.08, letters="ACGTN")
    spec = {g: n for g, n in counts(seqs, 11).items() if n >= 3}
    walked = onesided._weak_reads(seqs, 11, held(spec))
    assert all(w or correct(s, spec, 11) == s for s, w in zip(seqs, walked))


def test_three_tied_votes_take_the_largest_and_two_none(spark):
    rows = [(1, 4, "A", 5), (1, 4, "C", 5), (1, 4, "G", 5), (2, 4, "A", 5), (2, 4, "C", 5), (2, 9, "T", 5), (2, 8, "T", 4)]
    got = mutations.winners(spark.createDataFrame(rows, "read_id INT, pos INT, base STRING, votes INT")).collect()
    assert sorted((r.read_id, r.pos, r.base) for r in got) == [(1, 4, "G"), (2, 9, "T")]


def test_place_winners_and_interior_fixes(spark):
    rows = [(1, 4, "C", 5), (1, 4, "A", 5), (1, 4, "G", 2), (1, 5, "T", 1), (None, 4, "A", 3)]
    voted = spark.createDataFrame(rows, "read_id INT, pos INT, base STRING, votes INT")
    assert {tuple(r) for r in mutations.place_winners(voted).collect()} == {(1, 4, "A", 5), (1, 5, "T", 1), (None, 4, "A", 3)}
    assert mutations.place_winners(voted.limit(0)).count() == 0
    both = spark.createDataFrame([(1, p, "C") for p in (0, 3, 4, 5, 6, 7)] + [(1, 5, "G"), (9, 4, "A")], "read_id INT, pos INT, base STRING")
    reads = spark.createDataFrame([(1, "A" * 11, "x"), (2, None, "x")], "read_id INT, seq STRING, size STRING")
    assert {tuple(r) for r in mutations.interior_fixes(both, reads, 5).collect()} == {(1, 4, "C"), (1, 6, "C")}
    assert mutations.interior_fixes(both.limit(0), reads, 5).count() == 0


def test_solid_bases_on_one_strand(spark):
    read = "TTACGACTCAACGCAGCACGTACGTT"
    trusted = spark.createDataFrame([(key(canon(read[3:11])), 5)], "key LONG, multiplicity INT")
    df = spark.createDataFrame([(1, read), (2, rc(read)), (3, None), (4, "")], "read_id INT, seq STRING")
    solid = lambda **how: {(r.read_id, r.pos) for r in solidity.solid_bases(df, trusted, 8, **how).where("solid").collect()}
    first, second = {(1, p) for p in range(3, 11)}, {(2, len(read) - 1 - p) for p in range(3, 11)}
    assert solid() == first | second
    assert solid(both_strands=False) == (first if canon(read[3:11]) == read[3:11] else second)


def test_lookups_by_read_and_by_joins_agree(spark):
    k = 7
    seqs = [*noisy(6, k, genome=300, reads=80, size=40, errors=0.07, letters="ACGTN"), "acgt" * 8, "ACG", "", "AC-GTAC" * 4]
    spec = {g: n for g, n in counts(seqs, k).items() if n >= 3}
    df = spark.createDataFrame([*enumerate(seqs), (900, None)], "read_id INT, seq STRING").withColumn("key", F.lit("x"))
    trusted = spark.createDataFrame([(key(g), n) for g, n in spec.items()], "key LONG, multiplicity INT")
    rows = lambda x: sorted(map(tuple, x.collect()))
    for both in (True, False):
        assert rows(solidity.solid_bases(df, trusted, k, both)) == rows(solidity.solid_bases_by_joins(df.drop("key"), trusted, k, both))
    found = rows(mutations.two_sided(df, trusted, k))
    assert found == rows(mutations.two_sided_by_joins(df.drop("key"), trusted, k)) and len(found) > 10
    assert mutations.two_sided(df.limit(0), trusted, k).count() == 0 and mutations.two_sided(df, trusted.limit(0), k).count() == 0


def test_pipeline_joins_and_broadcast_agree(spark):
    seqs = noisy(3, 16, genome=400, reads=120, size=80, errors=0.01)
    rows = [(i, s, "k") for i, s in enumerate([*seqs, None, "", "ACG", seqs[0]])]
    df = spark.createDataFrame(rows, "read_id INT, seq STRING, key STRING")
    trusted = correction.trusted_spectrum(df)
    spec = {r.key: r.multiplicity for r in trusted.collect()}
    by_kmer = {g: spec[key(g)] for g in counts(seqs, 16) if key(g) in spec}
    want = {i: s and correct(s, by_kmer, 16) for i, s, _ in rows}
    assert {r.read_id: r.corrected for r in onesided.corrected(df, trusted, ["read_id", "key"]).collect()} == want
    assert {r.read_id: r.corrected for r in onesided.corrected_by_joins(df, trusted, ["read_id"]).collect()} == want
    assert sum(want[i] != s for i, s, _ in rows) > 5


@pytest.mark.parametrize("k", [8, 13])
def test_first_steps_and_codes_equal_the_walk(spark, k):
    seqs = [*noisy(k, k, letters="ACGTN", errors=0.04), "ACG", "", "acgt" * 9, "A" * 30]
    spec = {g: n % 5 + 1 for g, n in counts(seqs, k).items() if n >= 2}
    trusted = spark.createDataFrame([(key(g), n) for g, n in spec.items()], "key LONG, multiplicity INT")
    df = spark.createDataFrame([*enumerate(seqs), (900, None)], "read_id INT, seq STRING").withColumn("lo", F.lit("x"))
    want, codes = set(), {}
    for i, s in enumerate(seqs):
        if len(s) < k:
            continue
        read = onesided.Read(s, k, held(spec))
        log = read.one_sided(1, 4, True)
        codes[i] = -1 if log is None else len(log)
        text = read.digits()
        hit = read.multiplicities([text[j : j + k] for j in range(len(text) - k + 1)]) > 0
        solid = np.array([hit[max(0, t - k + 1) : t + 1].any() for t in range(len(text))])
        for lo in np.nonzero(hit & ~np.r_[False, hit[:-1]])[0].tolist():
            hi = lo + int(np.argmin(np.r_[hit[lo:], False])) - 1
            for right, start, end in ((True, hi + 1, k - 1), (False, lo - 1, 0)):
                if 0 <= start <= len(text) - k and not solid[start + end]:
                    digit = read.choice(list(text), text[start : start + k], start, start + end, end, 4)
                    want |= {(i, lo, right, start + end, onesided._LETTER[digit])} if digit else set()
    found = steps.first_steps(df.drop("lo"), trusted, 4, k)
    assert {(r.read_id, r.lo, r.to_right, r.pos, r.base) for r in steps.chosen(found).collect()} == want and len(want) > 5
    assert {r.read_id: r.code for r in onesided.pass_codes(df, trusted, ["read_id"], k).collect()} == codes
    assert steps.chosen(steps.first_steps(df.drop("lo").limit(0), trusted, 4, k)).count() == 0


def in_order(seq, spec, k):
    """Brute force: interior bases from left to right, solid ones by the read as it came."""
    ok = lambda g: canon(g) is not None and canon(g) in spec
    text, out = list(enc(seq)), []
    hit = [ok("".join(text[i : i + k])) for i in range(len(text) - k + 1)]
    for p in range(k - 1, len(text) - k + 1):
        if any(hit[p - k + 1 : p + 1]):
            continue
        found = [b for b in "ACGT" if b != text[p] and ok("".join(text[p - k + 1 : p]) + b) and ok(b + "".join(text[p + 1 : p + k]))]
        if len(found) == 1:
            text[p] = found[0]
            out.append((p, found[0]))
    return out


def test_interior_fixes_in_order(spark):
    k = 6
    seqs = [*noisy(5, k, genome=300, reads=60, size=50, errors=0.08, letters="ACGTN"), "acgt" * 10, "ACG", "", "-" * 30]
    spec = {g: n for g, n in counts(seqs, k).items() if n >= 3}
    df = spark.createDataFrame([*enumerate(seqs), (900, None)], "read_id INT, seq STRING").withColumn("pos", F.lit(1))
    trusted = spark.createDataFrame([(key(g), n) for g, n in spec.items()], "key LONG, multiplicity INT")
    want = {(i, p, b) for i, s in enumerate(seqs) for p, b in in_order(s, spec, k)}
    assert {tuple(r) for r in interior.interior_in_order(df, trusted, k).collect()} == want and len(want) > 3
    assert interior.interior_in_order(df.limit(0), trusted, k).count() == 0 and interior.interior_in_order(df, trusted.limit(0), k).count() == 0


def test_the_best_change_of_a_kmer(spark):
    rows = spark.createDataFrame([(1, "ACGTACGTT"), (2, None), (3, "AC")], "read_id INT, seq STRING")
    near = ["ACGTACGTC", "ACGTACGTG", "ACGAACGTT", "ACGGACGTT"]
    trusted = spark.createDataFrame([(key(canon(g)), 4 if g != "ACGAACGTT" else 3) for g in near], "key LONG, multiplicity INT")
    forward = canon("ACGTACGTT") == "ACGTACGTT"
    got = {(r.pos, r.base, r.multiplicity) for r in mutations.best_of_kmer(rows, trusted, k=9).collect()}
    assert got == {(8, "C" if forward else "G", 4), (3, "G", 4)}
    assert (8, "G", 4) in {(r.pos, r.base, r.multiplicity) for r in mutations.best_of_kmer(rows, trusted, last_wins=True, k=9).collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_reads_and_trusted(spark, k):
    seqs = [*noisy(4, k, reads=60, errors=0.05, letters="ACGTN"), "", "ACG", "acgt" * 9, "\n" * 30, "é" * 30]
    seqs += [s[:40] + "x" + s[41:] for s in seqs[:9]]
    spec = {g: n % 5 + 1 for g, n in counts(seqs, k).items() if n >= 4}
    df = spark.createDataFrame([*enumerate(seqs), (900, None)], "read_id INT, seq STRING")
    return seqs, spec, df, spark.createDataFrame([(key(g), n) for g, n in spec.items()], "key LONG, multiplicity INT")


@pytest.mark.parametrize("most", [lookup.NEAR_KMERS, 0])
@pytest.mark.parametrize("k", [8, 16])
def test_candidates_equal_brute_force(spark, monkeypatch, k, most):
    monkeypatch.setattr(lookup, "NEAR_KMERS", most)
    seqs, spec, df, trusted = some_reads_and_trusted(spark, k)
    want = []
    for i, s in enumerate(seqs):
        for start, g in enumerate(grams(enc(s), k)):
            if set(g) <= set("ACGT") and canon(g) not in spec:
                tried = [(at, b, canon(g[:at] + b + g[at + 1 :])) for at in range(k) for b in "ACGT" if b != g[at]]
                want += [(i, start + at, b, start, spec[m]) for at, b, m in tried if m in spec]
    found = mutations.candidates(df, trusted, k)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    assert mutations.candidates(df.limit(0), trusted, k).count() == 0 and mutations.candidates(df, trusted.limit(0), k).count() == 0


@pytest.mark.parametrize("k", [5, 8, 16, 18])
def test_both_lookups_of_changes_agree(monkeypatch, k):
    monkeypatch.setattr(tally, "BLOCK", 70)
    seqs = [*noisy(4, k, reads=60, errors=0.05, letters="ACGTN"), "", "ACG", "ACGT" * 9, "A" * 30]
    spec = held({g: n for g, n in counts(seqs, k).items() if n >= 4})
    d = lookup.digits_of("\n".join(seqs))
    rows = lambda found: sorted((w, at, c, m, b) for ws, at, *x in found for w, c, m, b in zip(*(y.tolist() for y in (ws, *x))))
    want = rows(lookup.Near(spec.keys, k).changes(d, k, spec))
    assert rows(tally.Trusted(spec, k).changes(d, k)) == want and len(want) > 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_a_larger_spectrum_is_not_joined_either(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    query = lambda: queries.QUERIES["best_alternative_strand"](spark, "/root/testdata/sf0.001")
    want = rows(query())
    monkeypatch.setattr(lookup, "NEAR_TABLE_KMERS", 0)
    assert lookup.NEAR_KMERS > 2_110_028 and "MapInArrow" in plan_of(query()) and rows(query()) == want and want


def test_few_others_are_told_as_near():
    r = np.random.default_rng(3)
    numbers = lambda n: r.integers(1, 5, (n, 16)) @ 10 ** np.arange(15, -1, -1)
    keys = np.unique(numbers(50_000))
    near = lookup.Near(keys, 16)
    assert all(near.many(x).all() for x, *_ in lookup.changed_ones(keys, 16))
    assert near.many(numbers(200_000)).mean() < 0.04


def test_kmers_of_digits_in_blocks(monkeypatch):
    monkeypatch.setattr(lookup, "BLOCK", 7)
    s = "ACGTTGCANNxACCGTAGGGTACCATTTxGCATGCAAT"
    got = [(first + i, f, b) for first, *parts in lookup.numbers_of(lookup.digits_of(s), 5) for i, (f, b, plain) in enumerate(zip(*parts)) if plain]
    assert got == [(i, key(g), key(rc(g))) for i, g in enumerate(grams(enc(s), 5)) if "x" not in g]
    assert not list(lookup.numbers_of(lookup.digits_of("ACGT"), 5)) and not list(lookup.numbers_of(lookup.digits_of(""), 5))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["best_alternative", "mutation_candidates", "best_alternative_strand", "vote_diagnostics", "best_alternative_last", "vote_matrix", "vote_winners"])
@pytest.mark.parametrize("most", [lookup.NEAR_KMERS, 0])
def test_no_windows_are_broadcast(spark, monkeypatch, most, name):
    monkeypatch.setattr(lookup, "NEAR_KMERS", most)
    plan = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin [forward" not in plan and ("MapInArrow" in plan) == (most > 0)


@pytest.mark.parametrize("k", [5, 8, 16, 18])
def test_counts_in_tasks_equal_brute_force(spark, monkeypatch, k):
    for name, small in (("HELD", 90), ("ROWS", 3), ("BLOCK", 40)):
        monkeypatch.setattr(tally, name, small)
    seqs, *_ = some_reads_and_trusted(spark, k)
    seqs += ["A" * 150, "T" * 150, "ACGT" * 30, "-123456789012345678", "acgtacgtacgtacgtacgt", "NNWKSYMRNNWKSYMRNNWKSYMR"]
    df = spark.createDataFrame([*enumerate(seqs), (900, None)], "read_id INT, seq STRING")
    want = {key(g): n for g, n in counts(seqs, k).items()}
    for least in (1, 2):
        rows = tally.counted(df, k, least).collect()
        assert {r.key: r.multiplicity for r in rows} == {g: n for g, n in want.items() if n >= least} and len({r.key for r in rows}) == len(rows)
    assert max(want.values()) == 255 and tally.counted(df.limit(0), k).count() == 0
    assert tally.counted(df, k).dtypes == kmers.counted(df, k).dtypes


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["best_alternative_strand", "mutation_candidates", "vote_diagnostics", "best_alternative_last", "vote_matrix", "vote_winners"])
def test_no_window_is_a_row(spark, monkeypatch, name):
    def rows(*_, **__):
        raise AssertionError("the windows of the reads are made rows")

    monkeypatch.setattr(kmers, "windows", rows)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("most", [lookup.BROADCAST_KMERS, 0])
def test_changes_of_solid_bases(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "BROADCAST_KMERS", most)
    k = 8
    seqs, spec, _, trusted = some_reads_and_trusted(spark, k)
    after = [s[:20] + "ACGT"[i % 4] + s[21:] if len(s) > 20 else s for i, s in enumerate(seqs)]
    seqs, after = zip(*((b, a) if i % 2 else (a, b) for i, (b, a) in enumerate(zip(seqs, after))))
    df = spark.createDataFrame([*((i, *x) for i, x in enumerate(zip(seqs, after))), (900, None, None)], "read_id INT, before STRING, seq STRING")

    def solid(s):
        hit = {i for i, g in enumerate(grams(enc(s), k)) if canon(g) in spec}
        return [any(p - j in hit for j in range(k)) for p in range(len(s))]

    pairs = [x for b, a in zip(seqs, after) for x in zip(solid(b), solid(a))]
    want = tuple(sum(x) for x in zip(*((a and not b, b and not a, a == b) for b, a in pairs)))
    found = solidity.changes_in_reads(df, trusted, k)
    assert tuple(found.first()) == want and min(want) > 0
    assert tuple(solidity.changes_in_reads(df.limit(0), trusted, k).first()) == (0, 0, 0)
    assert "BroadcastHashJoin [read_id" not in plan_of(found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("most", [lookup.BROADCAST_KMERS, 0])
def test_solid_changes_broadcasts_no_bases(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "BROADCAST_KMERS", most)
    assert not re.search(r"BroadcastHashJoin \[read_id#\d+L, pos", plan_of(queries.solid_changes(spark, "/root/testdata/sf0.001")))


def test_the_whole_correction_is_judged(spark):
    seqs = noisy(3, 16, genome=400, reads=120, size=80, errors=0.01)
    df = spark.createDataFrame([*enumerate(seqs), (500, None), (501, "ACG")], "read_id INT, seq STRING")
    spec = {x.key: x.multiplicity for x in correction.trusted_spectrum(df).collect()}
    by_kmer = {g: spec[key(g)] for g in counts(seqs, 16) if key(g) in spec}
    fixed = [correct(s, by_kmer, 16) for s in seqs]
    right = [f if i % 3 == 0 else s if i % 3 == 1 else "T" + s[1:70] for i, (s, f) in enumerate(zip(seqs, fixed))]
    reference = spark.createDataFrame([*enumerate(right), (500, "A"), (502, "C")], "read_id INT, seq STRING")
    at = [x for s, t, f in zip(seqs, right, fixed) for x in zip(t, s, f)]
    want = (sum(o != t == c for t, o, c in at), sum(o == t != c for t, o, c in at), sum(o != t != c for t, o, c in at))
    assert tuple(correction.confusion(df, reference).first()) == want and min(want) > 0


@pytest.mark.parametrize("values,want", [([7, 7, 7], 7), ([2] * 9 + [3] * 4 + [4] + [5] * 6, 4), ([], None)])
def test_cutoff(spark, values, want):
    hist = spectrum.histogram(spark.createDataFrame([(v,) for v in values], "multiplicity INT"))
    row = spectrum.cutoff(hist).first()
    assert (row and row.cutoff) == want == spectrum.cutoff_of(dict(hist.collect()))


def test_both_cutoffs_agree(spark):
    r = random.Random(6)
    for _ in range(12):
        held = {r.randrange(2, r.choice([6, 40, 256])): r.randrange(1, 30) for _ in range(r.randrange(1, 60))}
        assert spectrum.cutoff(spark.createDataFrame(list(held.items()), "multiplicity INT, kmers LONG")).first().cutoff == spectrum.cutoff_of(held)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(2, 255), min_size=1, max_size=60))
def test_density_bins_equal_numpy(values):
    low, high = min(values), max(values)
    mine = np.zeros(high, int)
    for v in values:
        mine[0 if low == high else min(high - 1, (v - low) * high // (high - low))] += 1
    if low < high:
        assert (mine == np.histogram(values, bins=high)[0]).all()


def test_empty_and_odd_reads(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ACG"), (4, "acgt" * 6), (5, "-123456789012345678"), (6, " " * 20)], "read_id INT, seq STRING")
    assert kmers.counted(df).count() == 0
    assert kmers.windows(df).where("key is not null").count() == 0
    trusted = correction.trusted_spectrum(df)
    assert trusted.count() == 0
    assert {r.read_id: r.corrected for r in onesided.corrected(df, trusted, ["read_id"]).collect()} == dict(df.collect())
    assert solidity.solid_bases(df, trusted).where("solid").count() == 0
    assert mutations.votes(mutations.candidates(df, trusted)).count() == 0
    assert kmers.counted(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=18))
def test_keys(s):
    assert rc(rc(s)) == s and onesided.key_of("".join(str("ACGT".index(c) + 1) for c in s)) == key(canon(s))


def test_column_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("AACGCCTTATCCGGCCTA", "@r-1.12 x", "p/a.fastq.gz")], "s STRING, h STRING, f STRING").select(
        B.reverse_complement(F.col("s")), B.canonical(F.col("s")), B.kmer_key(F.col("s")), B.key_kmer(B.kmer_key(F.col("s"))), B.id_suffix(F.col("h")), B.file_stem(F.col("f")),
        B.reverse_complement(F.translate(F.lit("ACGTACCATACCNN"), "N", "A")), B.forward_base(F.lit("ACG"), F.lit("T")), B.backward_base(F.lit("ACG"), F.lit("T")), B.file_stem(F.lit("x.txt")),
    ).first()
    assert tuple(row) == ("TAGGCCGGATAAGGCGTT", "AACGCCTTATCCGGCCTA", 112322441422332241, "AACGCCTTATCCGGCCTA", 11, "p/a", "TTGGTATGGTACGT", "CGT", "TAC", "")
