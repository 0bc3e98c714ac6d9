import collections
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.llm import encoding, heavy, logistic, packing, seen, sketches, spans, truncation
from kmerloom.llm.ribbon import Ribbon


# 1


def test_counts_within_bounds_and_merge_in_any_order(spark):
    r = random.Random(1)
    rows = [(d, g, [f"x{r.randrange(30_000)}" for _ in range(200)] + [None]) for d in (1, 2) for g in ("a", "b", None) for _ in range(40)]
    rows += [(1, "a", None), (1, "a", []), (3, "z", ["y"] * 50)]
    df = spark.createDataFrame(rows, "day INT, g STRING, ids ARRAY<STRING>").repartition(5)
    partial = sketches.partial_sketches(df, ["day", "g"], sketches.hashed("ids"))
    fine = sketches.merged_sketches(partial, ["day", "g"], ["g"])
    sets = [[], ["day"], ["g"], ["day", "g"]]
    named = ["grouping", "day", "g"]
    out = sketches.estimated(sketches.merged_sketches(sketches.rolled_up(fine, ["day", "g"], sets), named, named), named).collect()
    exact = collections.defaultdict(set)
    for d, g, ids in rows:
        for s in sets:
            exact[(",".join(s), d if "day" in s else None, g if "g" in s else None)] |= {i for i in ids or [] if i is not None}
    assert {(x.grouping, x.day, x.g) for x in out} == set(exact)
    inside = [x.lower <= len(exact[x.grouping, x.day, x.g]) <= x.upper for x in out]
    assert sum(inside) >= len(out) - 1
    assert next(x for x in out if x.day == 3 and x.g == "z").estimate == 1.0


def test_merging_many_parts_keeps_only_the_smallest():
    r = np.random.default_rng(3)
    parts = [np.unique(r.integers(0, 2**64, sketches.K + 50, dtype=np.uint64))[: sketches.K] for _ in range(5_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["g"] * 500), pa.array([p.tobytes() for p in parts[i : i + 500]], pa.binary())], names=["g", "sketch"]) for i in range(0, 5_000, 500)]
    began = time.time()
    ((group, sketch),) = sketches._merged_groups(iter(batches), ["g"], sketches.K)
    assert time.time() - began < 2 and group == ("g",)
    assert (sketch == np.unique(np.concatenate(parts))[: sketches.K]).all()


@pytest.mark.parametrize("salts", [1, 3])
def test_cube_equals_exact_counts_of_small_groups(spark, salts):
    r = random.Random(5)
    rows = [(r.choice([1, 2, None]), r.choice(["a", "b", None]), r.choice(["x", "y"]), [f"k{r.randrange(900)}" for _ in range(30)]) for _ in range(300)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "day INT, run STRING, grouping STRING, ids ARRAY<STRING>, sketch STRING").withColumnRenamed("grouping", "lane").repartition(7)
    groups, sets = ["day", "run", "lane"], [[], ["day"], ["lane"], ["run"], ["day", "lane"], ["run", "lane"], ["day", "run"], ["day", "run", "lane"]]
    got = sketches.cube(sketches.partial_sketches(df, groups, sketches.hashed("ids")), groups, ["run"], sets, salts=salts).collect()
    want = collections.defaultdict(set)
    for *g, ids in rows:
        for s in sets:
            want[(",".join(s), *(v if c in s else None for v, c in zip(g, groups)))] |= set(ids)
    assert {(x.grouping, x.day, x.run, x.lane): (x.estimate, x.lower, x.upper, x.hashes) for x in got} == {g: (n, n, n, n) for g, v in want.items() for n in [len(v)]} and len(got) == len(want)
    partial = sketches.partial_sketches(df, groups, sketches.hashed("ids"))
    assert sketches.merged_sketches(partial, groups, ["run"], salts=salts).count() == len({g for g in want if g[0] == "day,run,lane"})
    assert sketches.cube(partial.limit(0), groups, ["run"], sets).count() == 0


def test_every_subset_of_the_groups_is_counted():
    from kmerloom.llm import queries

    sets = [frozenset(x) for x in queries.NEAR_SETS + queries.FAR_SETS]
    assert len(sets) == len(set(sets)) == 2 ** len(queries.GROUPS) and set().union(*sets) == set(queries.GROUPS)
    assert all({"run_id", "sample_id"} <= set(x) for x in queries.NEAR_SETS)


def test_set_operations(spark):
    a, b = np.arange(50_000), np.arange(30_000, 90_000)
    mixed = lambda x: np.sort((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x1234567))[: sketches.K]
    rows = [("p", bytearray(mixed(a).tobytes()), bytearray(mixed(b).tobytes())), ("q", bytearray(mixed(a[:10]).tobytes()), None)]
    out = {x.n: x for x in sketches.compared(spark.createDataFrame(rows, "n STRING, l BINARY, r BINARY"), ["n"], "l", "r").collect()}
    assert out["p"].both_lower <= 20_000 <= out["p"].both_upper and out["p"].either_lower <= 90_000 <= out["p"].either_upper
    assert (out["q"].both, out["q"].either, out["q"].only_left) == (0, 10, 10)


# 2


def brute_spans(rows, w=64):
    where = collections.defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - w + 1):
            if i is not None and set(t[p : p + w]) <= set("ACGT"):
                where[t[p : p + w]].add(i)
    hit = collections.defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - w + 1):
            if i is not None and len(where.get(t[p : p + w], ())) > 1 and set(t[p : p + w]) <= set("ACGT"):
                hit[i] |= set(range(p, p + w))
    out = set()
    for i, places in hit.items():
        for p in sorted(places):
            if p - 1 not in places:
                q = p
                while q + 1 in places:
                    q += 1
                out.add((i, p, q + 1))
    return out


def some_reads(seed, n=60):
    r = random.Random(seed)
    base = "".join(r.choice("ACGT") for _ in range(600))
    rows = []
    for i in range(n):
        a = r.randrange(500)
        t = base[a : a + r.randrange(40, 200)]
        if r.random() < 0.4:
            k = r.randrange(len(t))
            t = t[:k] + r.choice("ACGTNa ") + t[k + 1 :]
        if r.random() < 0.3:
            t = "".join(r.choice("ACGT") for _ in range(r.randrange(50))) + "G" * r.randrange(20, 150)
        rows.append((i // 2 if r.random() < 0.1 else i, t))
    return [*rows, rows[0], (None, rows[1][1]), (900, None), (901, ""), (902, "ü" + rows[2][1]), (903, "ACGT" * 40), (904, "ACGT" * 30)]


@pytest.mark.parametrize("seed,letters,least,window", [(1, 300_000, 64, 64), (2, 300_000, 2, 64), (3, 500, 64, 64), (4, 100, 2, 64), (5, 400, 2, 40), (6, 60, 1, 100), (7, 300_000, 3, 20)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, letters, least, window):
    monkeypatch.setattr(spans, "SHARD_LETTERS", letters)
    monkeypatch.setattr(spans, "HOT_LEAST", least)
    rows = some_reads(seed)
    df = spark.createDataFrame([(*x, "s") for x in rows], "read_id LONG, reads STRING, seed STRING").repartition(3)
    got = spans.shared_spans(df, "read_id", "reads", window).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == brute_spans(rows, window)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "read_id LONG, reads STRING")
    assert spans.shared_spans(df, "read_id", "reads").count() == 0
    assert spans.shared_shares(df, "read_id", "reads").count() == 0


# 3


@pytest.mark.parametrize("n,bits", [(0, 8), (1, 8), (600, 32), (20_000, 16)])
def test_ribbon(n, bits):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    ribbon = Ribbon(keys, bits)
    assert ribbon.has(keys).all()
    assert ribbon.has(r.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() <= 3 * 2.0**-bits + 1e-4


def test_seen_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(seen, "SEAL", 200)
    monkeypatch.setattr(seen, "GENERATION_ROWS", 40)
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)] + ["hot"] * 1500
    rows = [(a, r.choice(["r1", "r1", "r2", None]), [r.choice(words) for _ in range(r.randrange(20))] + ([None] if a % 5 == 0 else [])) for a in range(800)]
    rows += [(900, "r1", None), (901, "r1", [])]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1) for x in rows], "arrival_no LONG, run_id STRING, kmers ARRAY<STRING>, shard INT").repartition(4)
    had, want = set(), set()
    for a, run, ks in sorted(rows, key=lambda x: x[0]):
        for p, k in enumerate(ks or []):
            if k is not None:
                if (run, k) in had:
                    want.add((a, p))
                had.add((run, k))
    got = [tuple(x) for x in seen.seen_before(df, "arrival_no", "run_id", "kmers").collect()]
    assert len(got) == len(want) and set(got) == want
    audit = seen.seen_before(df, "arrival_no", "run_id", "kmers", audit=True).agg(F.sum("keys"), F.max("filters"), F.sum("absent_claimed")).first()
    assert audit[0] == len(had) and audit[1] > 1 and audit[2] == 0
    assert seen.seen_before(df.limit(0), "arrival_no", "run_id", "kmers").count() == 0


# 4


def test_heavy_values(spark, monkeypatch):
    monkeypatch.setattr(heavy, "BUCKETS", 16)
    monkeypatch.setattr(heavy, "CELLS", 512)
    r = random.Random(3)
    rows = [(f"h{i}", 40) for i in range(12) for _ in range(50 + i)] + [(f"v{r.randrange(4000)}", r.choice([1, 2, None])) for _ in range(9000)] + [(None, 700), ("h3", None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 0) for x in rows], "c STRING, m INT, value INT").repartition(6)
    n = collections.Counter()
    for c, m in rows:
        n[c] += m or 0
    total = sum(n.values())
    assert {x.value: x.n for x in heavy.at_least_share(df, "c", "m", 20).collect()} == {c: v for c, v in n.items() if c is not None and v * 1000 >= 20 * total}
    top = heavy.most_frequent(df, "c", "m", 12).collect()
    assert {x.value for x in top} == {f"h{i}" for i in range(12)}
    assert all(x.lower <= n[x.value] <= x.upper for x in top)
    assert heavy.most_frequent(df.limit(0), "c", "m", 5).count() == 0 and heavy.at_least_share(df.limit(0), "c", "m", 5).count() == 0


def test_no_value_is_missed_at_a_small_share(spark):
    total = 20_000 * 14 + 20_000_000
    df = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("c"), F.lit(14).alias("m")).unionByName(spark.range(1_000_000).select(F.concat(F.lit("x"), F.col("id") % 400_000).alias("c"), F.lit(1).alias("m"))).repartition(4)
    rest = spark.createDataFrame([(None, total - 20_000 * 14 - 1_000_000)], "c STRING, m INT")
    all_ = df.unionByName(rest)
    n = all_.agg(F.sum("m")).first()[0]
    share = 14 * 1000 / n
    sketch = heavy.heavy_light(all_, "c", "m")
    assert heavy.merged(sketch).where("value like 'v%'").count() < 20_000  # some own no slot
    assert heavy.at_least_share(all_, "c", "m", share).where("value like 'v%' and n = 14").count() == 20_000
    assert heavy.most_frequent(all_, "c", "m", 5).where("certain").count() == 0


def test_the_exact_top(spark, monkeypatch):
    monkeypatch.setattr(heavy, "BUCKETS", 4)
    monkeypatch.setattr(heavy, "CELLS", 32)
    r = random.Random(13)
    rows = [(f"v{min(int(r.paretovariate(0.6)), 900)}", r.choice([1, 2, 3, None])) for _ in range(6000)] + [(None, 900), ("zero", 0)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "c STRING, m INT, n INT").repartition(5)
    n = collections.Counter()
    for c, m in rows:
        n[c] += m or 0
    want = sorted(((v, c) for c, v in n.items() if c is not None and v > 0), key=lambda x: (-x[0], x[1]))
    assert [(x.n, x.value) for x in heavy.exact_top(df, "c", "m", 40).collect()] == want[:40]
    assert heavy.exact_top(df, "c", "m", 5000).count() == len(want) and heavy.exact_top(df.limit(0), "c", "m", 5).count() == 0


def test_the_certain_of_the_most_frequent(spark):
    df = spark.createDataFrame([("a", 500), ("b", 300), (None, 9), ("c", None)] + [(f"x{i}", 1) for i in range(50)], "c STRING, m INT")
    top = heavy.most_frequent(df, "c", "m", 2).collect()
    assert [(x.value, x.estimate, x.certain) for x in top] == [("a", 500, True), ("b", 300, True)]


# 6


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_library(reference, text):
    assert next(encoding.vocabulary(encoding.default_vocabulary()).encode_all([text])) == reference(text)


def test_odd_texts(reference, spark):
    texts = [None, "", " ", "\n\n  x", "<|endoftext|> a", "a" * 5000, "ab" * 3000 + "é" * 400, "日本語" * 900, "it's  I'LL\tgo…​\x00", "🧬🇪🇺" * 30, "1234567890" * 40]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, *texts])], "doc_id LONG, text STRING, __t STRING")
    got = {r.doc_id: r.ids for r in encoding.encode(df, "text", ["doc_id", "__t"]).collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate([*texts, *texts])}
    assert encoding.encode(df.limit(0), "text", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        encoding.encode(df.withColumnRenamed("doc_id", "ids"), "text", ["ids"])


# 7


@pytest.mark.parametrize("name", ["mixed", "third", "empty", "zeros", "single"])
def test_packing(spark, name):
    r = random.Random(4)
    sizes = {
        "mixed": [r.randrange(0, 120) for _ in range(900)] + [100, 101, 250, 1000, None, -3],
        "third": [34] * 400 + [r.randrange(1, 100) for _ in range(400)],
        "empty": [],
        "zeros": [0, None, 0],
        "single": [7],
    }[name]
    df = spark.createDataFrame([(i, n, 5) for i, n in enumerate(sizes)], "doc_id LONG, n INT, piece INT")
    out = packing.pack(df, "doc_id", "n", 100).collect()
    by_doc, used = collections.defaultdict(list), collections.Counter()
    for x in out:
        by_doc[x.doc_id].append((x.piece, x.piece_start, x.piece_length))
        used[x.container] += x.piece_length
    for i, n in enumerate(sizes):
        n = max(n or 0, 0)
        pieces = sorted(by_doc[i])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == n
        assert len(pieces) == max(1, -(-n // 100)) and all(p[1] == 100 * p[0] for p in pieces)
    assert all(v <= 100 for v in used.values())
    total = sum(max(n or 0, 0) for n in sizes)
    if name == "mixed":
        assert len(used) <= 1.01 * total / 100 + 2


def test_ways_that_are_not_quite_full_are_used(monkeypatch):
    histogram = {520: 600, 274: 600, 264: 600, 234: 1200}
    rows, containers = packing.plan(histogram, 1024)
    assert containers <= 910  # 900 are enough; greedy packing alone takes over 1,000
    held = collections.Counter()
    for n, a, b, first, each in rows:
        for rank in range(a, b):
            held[first + (rank - a) // each] += n
    assert max(held.values()) <= 1024 and len(held) == containers and sum(held.values()) == sum(n * c for n, c in histogram.items())
    monkeypatch.setattr(packing, "STEPS", 1)
    lengths, counts = np.array([300, 500, 700]), np.array([9, 4, 5])
    ways = packing.fractional(lengths, counts, 1024)
    assert (sum(x * way for way, x in ways) >= counts - 1e-9).all()


@pytest.mark.parametrize("seed,least,most,n", [(1, 1, 120, 400), (2, 1, 400, 3000), (3, 5, 90, 20_000), (4, 300, 700, 400)])
def test_the_program_places_everything_near_its_bound(seed, least, most, n):
    r = random.Random(seed)
    histogram = dict(collections.Counter(r.randrange(least, most) for _ in range(n)))
    ways, value, bound = packing.program(histogram, 1024)
    lengths = np.array(sorted(histogram))
    assert (sum(times * way for way, times in ways) == [histogram[int(i)] for i in lengths]).all() and all(way @ lengths <= 1024 for way, _ in ways)
    assert value == sum(times for _, times in ways) and bound <= value <= max(np.ceil(bound), bound * (1.01 if most < 500 else 1.05))
    assert packing.program({0: 5}, 1024) == ([], 0, 0.0)


def test_dearest_way_is_the_best():
    sizes, prices = np.array([3, 5, 7, 11]), np.array([0.3, 0.62, 0.8, 1.3])
    way = packing.dearest_way(sizes, prices, 29)
    best = max(a * 0.3 + b * 0.62 + c * 0.8 + d * 1.3 for a in range(10) for b in range(6) for c in range(5) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 29)
    assert way @ sizes <= 29 and abs(way @ prices - best) < 1e-9


# 8


def test_logistic_regression(spark):
    r = random.Random(8)
    rows = []
    for _ in range(1500):
        words = [r.choice("abcdefgh") for _ in range(r.randrange(1, 7))]
        odds = 1.5 * words.count("a") - 2 * words.count("b") + 0.3
        rows.append((float(r.random() < 1 / (1 + np.exp(-odds))), 1.0, words))
    df = spark.createDataFrame(rows, "label DOUBLE, weight DOUBLE, features ARRAY<STRING>").repartition(3)
    found = logistic.fitted(df, 1 << 12, 1e-6)
    scored = df.select("label", logistic.probability(F.col("features"), found, spark.sparkContext).alias("p")).toPandas()
    assert abs(scored.p.mean() - scored.label.mean()) < 0.01
    alone = spark.createDataFrame([(["a"],), (["b"],), (["h"],)], "features ARRAY<STRING>")
    a, b, h = (x.p for x in alone.select(logistic.probability(F.col("features"), found, spark.sparkContext).alias("p")).collect())
    logit = lambda p: np.log(p / (1 - p))
    assert abs(logit(a) - logit(h) - 1.5) < 0.5 and abs(logit(b) - logit(h) + 2) < 0.5
    assert logistic.fitted(df.where("label = 1"), 64, 1e-3) is None and logistic.fitted(df.limit(0), 64, 1e-3) is None


def test_truncation(spark):
    r = random.Random(9)
    nouns, verbs = ["filter", "sample", "report", "archive", "sensor", "plate"], ["checks", "moves", "covers", "follows"]
    sentence = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} near the {r.choice(nouns)}."
    text = lambda n: " ".join(sentence() for _ in range(n))
    rows, cut = [], set()
    for i in range(3000):
        t, source = text(r.randrange(1, 9)), r.choice(["limited", "bytes", "free", "free"])
        if source == "limited" and len(t) > 180:
            t = t[:180]
        if source == "bytes":
            t = t.replace("sample", "pröbe")
            if len(t.encode()) > 200:
                t = t.encode()[:200].decode("utf-8", "ignore")
        if source == "free" and i % 40 == 0:
            t = t[: r.randrange(20, len(t) - 3)]
            cut.add(i)
        if source != "free" and not t.endswith("."):
            cut.add(i)
        rows.append((i, source, t, "w"))
    first = min(cut)
    rows += [(5000, "free", rows[first][2], "w"), (5001, "free", None, "w"), (5002, None, " 　", "w"), (5003, None, "", "w"), (5004, "free", "The report checks the plate near the sensor", "w")]
    df = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING, why STRING")
    got = {x.key for x in truncation.truncated(df, "doc_id", "source", "text").collect()}
    want = cut | {5000}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    assert not got & {5001, 5002, 5003, 5004}
    assert truncation.truncated(df.limit(0), "doc_id", "source", "text").count() == 0
    shares = {x.source: x.n_rows for x in truncation.shares(df, "doc_id", "source", "text").collect()}
    assert sum(shares.values()) == len(rows)


def test_truncation_in_sources_that_mostly_break_off(spark):
    r = random.Random(11)
    nouns, verbs = ["filter", "sample", "report", "archive", "sensor", "plate"], ["checks", "moves", "covers", "follows"]
    phrase = lambda: f"Table {r.randrange(900)}: the {r.choice(nouns)}"
    sentence = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} near the {r.choice(nouns)}."
    rows, cut = [], set()
    for i in range(3000):
        source = ["broken", "free", "captions"][i % 3]
        t = phrase() if source == "captions" else " ".join(sentence() for _ in range(r.randrange(1, 9)))
        if (source == "broken" and i % 10 < 8) or (source == "free" and i % 40 == 1):
            t = t[: r.randrange(20, len(t) - 3)].rstrip(".")
            if t[-7:] not in {" sensor", " sample", " report", " filter"} and t[-6:] != " plate" and t[-8:] != " archive":  # there it may as well be whole
                cut.add(i)
            t += ["", "", "", "..."][i % 4]
        rows.append((i, source, t))
    rows += [(5000 + i, "captions", "Our new plate") for i in range(900)]  # short, and under half: no spike
    df = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING").repartition(4)
    got = {x.key for x in truncation.truncated(df, "doc_id", "source", "text").collect()}
    for source in ("broken", "free"):
        want = {i for i in cut if rows[i][1] == source}
        assert len(got & want) >= 0.95 * len(want)
    assert not {i for i in got if i >= 5000} and sum(rows[i][1] == "captions" for i in got) <= 10
    assert truncation._sample(truncation.judged(df, "doc_id", "source", "text").where("source = 'captions'"), 500).where("sentence = 'Our new plate'").count() <= 1


def test_short_cut_texts_are_judged(spark):
    r = random.Random(12)
    nouns, verbs = ["filter", "sample", "report", "archive", "sensor", "plate"], ["checks", "moves", "covers", "follows"]
    sentence = lambda: f"{r.choice(['The', 'A', 'Each'])} {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} near the {r.choice(nouns)}."
    rows = [(i, "broken", " ".join(sentence() for _ in range(r.randrange(1, 9)))) for i in range(1500)]
    rows = [(i, s, t[: r.randrange(20, len(t) - 3)] if i % 3 == 0 else t) for i, s, t in rows]
    short = {5000 + i: sentence()[: 1 + i % 7] for i in range(70)}
    rows += [(i, "broken", t) for i, t in short.items()] + [(6000 + i, "broken", t) for i, t in enumerate(["12.5", "0", "—", "🧬"])]
    df = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING").repartition(4)
    got = {x.key for x in truncation.truncated(df, "doc_id", "source", "text").collect()}
    assert len(got & set(short)) >= 0.9 * len(short) and not got & {6000, 6001, 6002, 6003}


def test_truncation_of_long_runs(spark):
    runs = [" " * 200_000, "(" * 50_000, ")" * 50_000, "<b>" * 20_000, "." * 3_000, "…" * 20_000, "«" * 50_000, "x" * 300_000]
    rows = [(i, "s", "The plate " + run + tail) for i, (run, tail) in enumerate((r, t) for r in runs for t in ("", " moves."))]
    df = spark.createDataFrame([*rows, (99, None, None)], "doc_id LONG, source STRING, text STRING")
    assert {x.doc_id: x.final for x in truncation.judged(df, "doc_id", "source", "text").withColumnRenamed("key", "doc_id").collect()} == {i: i % 2 == 1 for i, _, t in rows}
    assert {x.key for x in truncation.truncated(df, "doc_id", "source", "text").collect()} <= {i for i, _, _ in rows}
