"""For each core query, SQL that gives the same rows, written on its own from the definition of the operator."""

from __future__ import annotations

_VERSION = ["loaded_at", "seq", "qual", "header", "sequenced_at", "run_id", "sample_id", "lane"]

READS = f"""reads AS (
    SELECT read_id, {", ".join(_VERSION)} FROM (
        SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in _VERSION)}) AS turn
        FROM seq_reads WHERE read_id IS NOT NULL) WHERE turn = 1)"""
WINDOWS = f"""{READS},
    every AS (
        SELECT read_id, CAST(i - 1 AS INTEGER) AS pos, substring(s, i, 16) AS kmer
        FROM (SELECT read_id, s, unnest(range(1, length(s) - 14)) AS i FROM (SELECT read_id, translate(seq, 'NWKSYMR', 'AAAAAAA') AS s FROM reads WHERE length(seq) >= 16))),
    win AS (SELECT read_id, pos, kmer, least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS canonical FROM every WHERE regexp_full_match(kmer, '[ACGT]+'))"""
OFTEN = f"""{WINDOWS},
    often AS (SELECT canonical, CAST(least(count(*), 255) AS INTEGER) AS multiplicity FROM win GROUP BY canonical HAVING count(*) >= 2),
    ends AS (SELECT min(multiplicity) AS lo, max(multiplicity) AS hi FROM often),
    density AS (
        SELECT bin, CAST(count(m) AS BIGINT) AS kmers
        FROM (SELECT CAST(unnest(range(hi)) AS INTEGER) AS bin FROM ends) LEFT JOIN
             (SELECT CASE WHEN lo = hi THEN 0 ELSE least(hi - 1, ((multiplicity - lo) * hi) // greatest(hi - lo, 1)) END AS bin, multiplicity AS m FROM often, ends) USING (bin)
        GROUP BY bin),
    rises AS (SELECT bin, kmers, kmers > lag(kmers) OVER (ORDER BY bin) AS rise FROM density),
    valley AS (SELECT coalesce((SELECT min(bin) FROM rises WHERE rise) - 1, hi - 1) AS v FROM ends),
    peak AS (SELECT bin AS p FROM density, valley WHERE bin >= v ORDER BY kmers DESC, bin LIMIT 1),
    thin AS (SELECT bin AS i FROM density, valley, peak WHERE bin BETWEEN v AND p ORDER BY kmers, bin DESC LIMIT 1),
    cut AS (SELECT CAST(CASE WHEN lo = hi THEN hi ELSE (2 * lo * hi + (2 * i + 1) * (hi - lo) + 2 * hi - 1) // (2 * hi) END AS BIGINT) AS cutoff FROM ends, thin)"""
TRUSTED = f"""{OFTEN}, trusted AS (SELECT canonical, multiplicity FROM often, cut WHERE multiplicity >= cutoff)"""
_KEY = "CAST(translate(canonical, 'ACGT', '1234') AS BIGINT)"
SOLID = f"""{TRUSTED},
    hit AS (SELECT read_id, pos FROM win SEMI JOIN trusted USING (canonical)),
    places AS (SELECT read_id, CAST(unnest(range(length(seq))) AS INTEGER) AS pos FROM reads WHERE length(seq) > 0),
    solids AS (
        SELECT read_id, pos, max(h) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) = 1 AS solid
        FROM (SELECT p.read_id, p.pos, CASE WHEN h.pos IS NULL THEN 0 ELSE 1 END AS h FROM places p LEFT JOIN hit h ON p.read_id = h.read_id AND p.pos = h.pos))"""
REGIONS = f"""{TRUSTED},
    hit AS (SELECT read_id, pos FROM win SEMI JOIN trusted USING (canonical)),
    regions AS (
        SELECT read_id, min(pos) AS lo, max(pos) AS hi, max(pos) - min(pos) AS span
        FROM (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS run FROM hit) GROUP BY read_id, run)"""
_BASES = "(VALUES ('A'), ('C'), ('G'), ('T')) AS b(base)"
CANDIDATES = f"""{TRUSTED},
    weak AS (SELECT read_id, pos, kmer FROM win ANTI JOIN trusted USING (canonical)),
    mutants AS (
        SELECT read_id, pos AS start, pos + i AS pos, base, substring(kmer, 1, i) || base || substring(kmer, i + 2) AS m
        FROM (SELECT read_id, pos, kmer, CAST(unnest(range(16)) AS INTEGER) AS i FROM weak), {_BASES} WHERE substring(kmer, i + 1, 1) <> base),
    candidates AS (
        SELECT read_id, x.pos, base, start, multiplicity FROM (SELECT *, least(m, translate(reverse(m), 'ACGT', 'TGCA')) AS canonical FROM mutants) x JOIN trusted USING (canonical)),
    votes AS (SELECT read_id, pos, base, count(*) AS votes FROM candidates GROUP BY read_id, pos, base)"""
TWO_SIDED = f"""{SOLID},
    coded AS (SELECT read_id, translate(seq, 'NWKSYMR', 'AAAAAAA') AS s FROM reads WHERE length(seq) >= 16),
    tries AS (
        SELECT read_id, pos, base, substring(s, 1, pos) || base || substring(s, pos + 2) AS t, least(pos, length(s) - 16) AS a, greatest(pos - 15, 0) AS b
        FROM solids JOIN coded USING (read_id), {_BASES} WHERE NOT solid AND substring(s, pos + 1, 1) <> base),
    sides AS (SELECT read_id, pos, base, substring(t, a + 1, 16) AS r, substring(t, b + 1, 16) AS l FROM tries),
    paired AS (
        SELECT read_id, pos, base FROM sides
        WHERE least(r, translate(reverse(r), 'ACGT', 'TGCA')) IN (SELECT canonical FROM trusted) AND least(l, translate(reverse(l), 'ACGT', 'TGCA')) IN (SELECT canonical FROM trusted)
          AND regexp_full_match(r || l, '[ACGT]+')),
    fix AS (
        SELECT read_id, pos, base FROM (
            SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS turn FROM (SELECT read_id, pos, min(base) AS base FROM paired GROUP BY read_id, pos HAVING count(*) = 1))
        WHERE turn = 1),
    fixed AS (SELECT read_id, CASE WHEN pos IS NULL THEN seq ELSE substring(seq, 1, pos) || base || substring(seq, pos + 2) END AS seq FROM reads LEFT JOIN fix USING (read_id))"""
PARSED = "parsed AS (SELECT read_id, max(reads) AS seq FROM parse_results WHERE read_id IS NOT NULL GROUP BY read_id)"
ALIGNED = f"""{READS}, alignments AS (
    SELECT CASE WHEN seq IS NULL THEN 4 ELSE 0 END AS flag, CASE WHEN qual = '' THEN 0 ELSE ascii(qual) END - 33 AS mapq, length(regexp_replace(seq, '[ACGTRYKMSWacgtn]', '', 'g')) AS nm FROM reads)"""
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_THREE = f"({_FIELD}),({_FIELD}),({_FIELD})"
_VALUE = "CASE WHEN starts_with({0}, '\"') THEN replace(substring({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"
RECORDS = f"""lines AS (SELECT record_id, regexp_replace(coalesce(raw_line, ''), '\\r\\z', '') AS line FROM raw_records),
    split AS (
        SELECT record_id, regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') AS quoted, regexp_full_match(line, '(?s){_THREE}') AS three,
            {", ".join(f"regexp_extract(line, '(?s)^{_THREE}\\z', {i}) AS f{i}" for i in (1, 2, 3))} FROM lines),
    typed AS (SELECT record_id, quoted, three, {", ".join(f"{_VALUE.format(f'f{i}')} AS {n}" for i, n in ((1, "header"), (2, "seq"), (3, "quality")))} FROM split),
    judged AS (
        SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT three THEN 'columns' WHEN NOT regexp_matches(header, '\\A@[!-~]') THEN 'header'
            WHEN NOT regexp_full_match(seq, '[ACGTN]+') THEN 'seq' WHEN NOT regexp_full_match(quality, '[!-~]+') THEN 'quality' WHEN length(seq) <> length(quality) THEN 'length' END AS reason FROM typed)"""

def _rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


def _canonical(x: str) -> str:
    return f"least({x}, {_rc(x)})"


_ENCODED = "regexp_replace(translate(seq, 'NWKSYMR', 'AAAAAAA'), '[^ACGT]', '~', 'g')"


def _rewritten(name: str, source: str, fixes: str) -> str:
    """`name` (read_id, seq): the reads of `source` that have `fixes` (read_id, spot, base), with these written in."""
    return f"""{name} AS MATERIALIZED (
        SELECT read_id, string_agg(coalesce(base, substring(seq, CAST(p + 1 AS BIGINT), 1)), '' ORDER BY p) AS seq
        FROM (SELECT read_id, seq, unnest(range(length(seq))) AS p FROM {source} SEMI JOIN {fixes} USING (read_id)) LEFT JOIN (SELECT read_id, spot AS p, base FROM {fixes}) USING (read_id, p) GROUP BY read_id)"""


def _regions(i: str, source: str, longest_first: bool) -> str:
    """t (the reads, encoded), r (regions with their turn and neighbours), solid (reads whose every base is solid)."""
    order = "hi - lo DESC" if longest_first else "hi - lo"
    return f"""t{i} AS MATERIALIZED (SELECT read_id, seq, {_ENCODED} AS enc, length(seq) AS n FROM {source}),
    h{i} AS MATERIALIZED (
        SELECT read_id, pos FROM (SELECT read_id, pos, substring(enc, CAST(pos + 1 AS BIGINT), 16) AS g FROM (SELECT read_id, enc, unnest(range(0, n - 15)) AS pos FROM t{i})) x JOIN tr ON tr.canonical = {_canonical("x.g")}),
    r{i} AS MATERIALIZED (
        SELECT read_id, lo, hi, lag(hi) OVER w AS before, lead(lo) OVER w AS behind, row_number() OVER (PARTITION BY read_id ORDER BY {order}, lo) AS turn
        FROM (SELECT read_id, min(pos) AS lo, max(pos) AS hi FROM (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS run FROM h{i}) GROUP BY read_id, run)
        WINDOW w AS (PARTITION BY read_id ORDER BY lo)),
    solid{i} AS MATERIALIZED (SELECT read_id FROM r{i} JOIN t{i} USING (read_id) GROUP BY read_id HAVING min(lo) = 0 AND max(hi) = any_value(n) - 16 AND bool_and(behind IS NULL OR behind <= hi + 16))"""


def _tests(walks: str, ahead: int) -> str:
    """For each walk (with work, s and right): its k-mer (base '') and each other base with the k-mers that must be trusted; the first is the changed one."""
    spot = "s + CASE WHEN toright THEN 15 ELSE 0 END"
    near = f"""CASE WHEN base = '' THEN [s] WHEN toright THEN list_concat([s], CASE WHEN length(work) - s - 1 < 16 THEN [] ELSE range(s + 1, s + 2 + least(length(work) - s - 17, {ahead - 1})) END)
        ELSE list_concat([s], CASE WHEN s - 1 <= 0 THEN [] ELSE range(greatest(0, s - 1 - {ahead}), s - 1) END) END"""
    return f"""SELECT *, substring(mutant, CAST(q + 1 AS BIGINT), 16) AS g FROM (
            SELECT *, CASE WHEN base = '' THEN work ELSE substring(work, 1, CAST(spot AS BIGINT)) || base || substring(work, CAST(spot + 2 AS BIGINT)) END AS mutant, unnest({near}) AS q
            FROM (SELECT *, {spot} AS spot, substring(work, CAST(s + 1 AS BIGINT), 16) AS own FROM {walks}), (VALUES ('', 0), ('A', 1), ('C', 2), ('G', 3), ('T', 4)) AS b(base, letter) WHERE base <> substring(work, CAST(spot + 1 AS BIGINT), 1))"""


def _judged(walks: str, keys: str, kept: str, ahead: int) -> str:
    """One row a walk: multiplicity of its own k-mer, and the base that is chosen, if any."""
    held = ", ".join(f"any_value({c}) AS {c}" for c in kept.split(", "))
    return f"""SELECT {keys}, {held}, max(m) FILTER (base = '') AS trusted,
            CASE WHEN count(m) FILTER (base <> '') = 1 THEN any_value(base) FILTER (base <> '' AND m IS NOT NULL)
                ELSE arg_max(base, m * 10 + CASE WHEN {_rc("own")} <= own THEN letter ELSE 5 - letter END) FILTER (base <> '' AND m IS NOT NULL AND ok) END AS pick
        FROM (
            SELECT {keys}, base, {held}, any_value(own) AS own, any_value(letter) AS letter, max(m) FILTER (q = s) AS m, coalesce(bool_and(m IS NOT NULL) FILTER (q <> s), true) AS ok
            FROM (SELECT x.*, tr.multiplicity AS m FROM ({_tests(walks, ahead)}) x LEFT JOIN tr ON tr.canonical = {_canonical("x.g")}) GROUP BY {keys}, base)
        GROUP BY {keys}"""


def _pass(i: str, source: str, allowed: int, longest_first: bool) -> str:
    """p (read_id, seq, n): the reads of `source` after one pass; n is the number of logged changes, -1 if all bases were solid.

    A left walk is made twice, as after a right walk without a change (L) and as after one with (F), and the right one is taken.
    """
    state = "work, s, stop, made, first, anchor, n, step"
    walk = f"""SELECT read_id, turn, way, way = 'R' AS toright, {state} FROM walk{i} WHERE go AND CASE WHEN way = 'R' THEN s <= stop ELSE s >= stop END"""
    return f"""{_regions(i, source, longest_first)},
    walk{i}(read_id, turn, way, work, s, stop, made, first, anchor, n, step, go) AS (
        SELECT read_id, turn, way, enc, CASE WHEN way = 'R' THEN hi + 1 ELSE lo - 1 END, CASE WHEN way = 'R' THEN least(t.n - 16, coalesce(behind - 16, t.n)) ELSE coalesce(before + 16, 0) END,
            CAST([] AS STRUCT(spot BIGINT, base VARCHAR)[]), CAST(NULL AS BIGINT), CASE WHEN way = 'F' THEN CAST(-1000000000 AS BIGINT) END, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true
        FROM r{i} JOIN t{i} t USING (read_id), (VALUES ('R'), ('L'), ('F')) AS v(way)
        WHERE read_id NOT IN (SELECT read_id FROM solid{i})
        UNION ALL
        SELECT read_id, turn, way,
            CASE WHEN trusted IS NOT NULL OR pick IS NULL OR over THEN work ELSE substring(work, 1, CAST(spot AS BIGINT)) || pick || substring(work, CAST(spot + 2 AS BIGINT)) END,
            s + CASE WHEN way = 'R' THEN 1 ELSE -1 END, stop,
            CASE WHEN trusted IS NOT NULL OR pick IS NULL THEN made WHEN over THEN list_append(made, struct_pack(spot := spot, base := pick))[: len(made) + 1 - n2] ELSE list_append(made, struct_pack(spot := spot, base := pick)) END,
            CASE WHEN trusted IS NOT NULL OR pick IS NULL THEN first ELSE coalesce(first, spot) END,
            CASE WHEN trusted IS NOT NULL OR pick IS NULL THEN anchor WHEN near THEN coalesce(anchor, spot) ELSE spot END,
            CASE WHEN trusted IS NOT NULL OR pick IS NULL THEN n ELSE n2 END, step + 1, trusted IS NOT NULL OR (pick IS NOT NULL AND NOT over)
        FROM (SELECT *, near AND n + 1 > {allowed} AS over, CASE WHEN near THEN n + 1 ELSE 0 END AS n2 FROM (
            SELECT *, abs(spot - coalesce(anchor, spot)) < 16 AS near FROM (SELECT *, CAST(s + CASE WHEN way = 'R' THEN 15 ELSE 0 END AS BIGINT) AS spot FROM ({_judged(f"({walk})", "read_id, turn, way", state, 5 - allowed)}))))),
    last{i} AS MATERIALIZED (SELECT read_id, turn, way, arg_max(made, step) AS made, max(first) AS first FROM walk{i} GROUP BY read_id, turn, way),
    log{i} AS MATERIALIZED (
        SELECT read_id, c.spot AS spot, c.base AS base, turn * 4000000 + CASE WHEN way = 'R' THEN 0 ELSE 2000000 END + j AS place FROM (
            SELECT read_id, turn, way, unnest(made) AS c, generate_subscripts(made, 1) AS j
            FROM last{i} JOIN (SELECT read_id, turn, first IS NOT NULL AS changed FROM last{i} WHERE way = 'R') USING (read_id, turn) WHERE way = 'R' OR way = CASE WHEN changed THEN 'F' ELSE 'L' END)),
    fix{i} AS MATERIALIZED (SELECT read_id, spot, arg_max(base, place) AS base FROM log{i} GROUP BY read_id, spot),
    {_rewritten(f"new{i}", f"t{i}", f"fix{i}")},
    p{i} AS MATERIALIZED (
        SELECT read_id, coalesce(new{i}.seq, t.seq) AS seq, CASE WHEN s.read_id IS NOT NULL THEN -1 ELSE coalesce(c.n, 0) END AS n
        FROM t{i} t LEFT JOIN new{i} USING (read_id) LEFT JOIN solid{i} s USING (read_id) LEFT JOIN (SELECT read_id, count(*) AS n FROM log{i} GROUP BY read_id) c USING (read_id))"""


def _vote(i: str, source: str) -> str:
    """v (read_id, seq, most): the reads of `source` after the vote, and the most votes that one change had."""
    return f"""s{i} AS MATERIALIZED (SELECT read_id, seq, {_ENCODED} AS enc FROM {source}),
    g{i} AS (SELECT read_id, pos, substring(enc, CAST(pos + 1 AS BIGINT), 16) AS g FROM (SELECT read_id, enc, unnest(range(0, length(enc) - 15)) AS pos FROM s{i})),
    m{i} AS (
        SELECT read_id, pos + j AS spot, base, substring(g, 1, j) || base || substring(g, j + 2) AS g
        FROM (SELECT read_id, pos, g, CAST(unnest(range(16)) AS INTEGER) AS j FROM g{i} WHERE {_canonical("g")} NOT IN (SELECT canonical FROM tr)), {_BASES} WHERE substring(g, j + 1, 1) <> base),
    c{i} AS MATERIALIZED (SELECT read_id, spot, base, count(*) AS votes FROM m{i} JOIN tr ON tr.canonical = {_canonical("m" + i + ".g")} GROUP BY read_id, spot, base),
    b{i} AS MATERIALIZED (SELECT *, max(votes) OVER (PARTITION BY read_id) AS most FROM c{i}),
    won{i} AS MATERIALIZED (SELECT read_id, spot, max(base) AS base FROM b{i} WHERE votes = most AND most >= 3 GROUP BY read_id, spot HAVING count(*) <> 2),
    {_rewritten(f"kept{i}", f"s{i}", f"won{i}")},
    v{i} AS MATERIALIZED (
        SELECT read_id, coalesce(k.seq, s.seq) AS seq, coalesce(most, 0) AS most FROM s{i} s LEFT JOIN kept{i} k USING (read_id) LEFT JOIN (SELECT read_id, any_value(most) AS most FROM b{i} GROUP BY read_id) USING (read_id))"""


_WALKED = f"""{TRUSTED}, tr AS MATERIALIZED (SELECT canonical, multiplicity FROM trusted), live1 AS MATERIALIZED (SELECT read_id, seq FROM reads WHERE length(seq) >= 16)"""


def _correction(rounds: int = 4) -> str:
    """corrected (read_id, corrected): all reads after the whole correction."""
    parts, ended = [_WALKED], []
    for i in range(1, rounds + 1):
        a, b = f"{i}a", f"{i}b"
        parts += [_pass(a, f"live{i}", i, True), f"mid{i} AS MATERIALIZED (SELECT read_id, seq FROM p{a} WHERE n > 0)", _pass(b, f"mid{i}", i, False)]
        parts += [f"open{i} AS MATERIALIZED (SELECT read_id, seq FROM p{a} WHERE n = 0 UNION ALL SELECT read_id, seq FROM p{b} WHERE n >= 0)", _vote(str(i), f"open{i}")]
        parts += [f"live{i + 1} AS MATERIALIZED (SELECT read_id, seq FROM v{i} WHERE most > 0)"]
        ended += [f"SELECT read_id, seq FROM p{a} WHERE n = -1", f"SELECT read_id, seq FROM p{b} WHERE n = -1", f"SELECT read_id, seq FROM v{i} WHERE most = 0"]
    ended.append(f"SELECT read_id, seq FROM live{rounds + 1}")
    parts.append(f"ended AS MATERIALIZED ({' UNION ALL '.join(ended)})")
    parts.append("corrected AS MATERIALIZED (SELECT read_id, coalesce(e.seq, r.seq) AS corrected FROM reads r LEFT JOIN ended e USING (read_id))")
    return ", ".join(parts)


CORRECTED = _correction()

_STEPS = f"""{_WALKED}, {_regions("x", "live1", True)},
    tips AS (
        SELECT read_id, lo, toright, enc AS work, CASE WHEN toright THEN hi + 1 ELSE lo - 1 END AS s
        FROM rx JOIN tx USING (read_id), (VALUES (true), (false)) AS v(toright)
        WHERE CASE WHEN toright THEN hi + 1 <= n - 16 AND (behind IS NULL OR hi + 16 < behind) ELSE lo >= 1 AND (before IS NULL OR lo - 1 > before + 15) END)"""
_CONFIRMED = f"""{_STEPS}, told AS (
        SELECT read_id, lo, toright, any_value(spot) AS pos, base, max(m) FILTER (q = s) AS multiplicity, coalesce(bool_and(m IS NOT NULL) FILTER (q <> s), true) AS confirmed
        FROM (SELECT x.*, tr.multiplicity AS m FROM ({_tests("tips", 4)}) x LEFT JOIN tr ON tr.canonical = {_canonical("x.g")}) WHERE base <> '' GROUP BY read_id, lo, toright, base)
    SELECT read_id, lo, CAST(pos AS INTEGER) AS pos, base, multiplicity, confirmed FROM told WHERE multiplicity IS NOT NULL"""
_CODES = f"{_WALKED}, {_pass('x', 'live1', 1, True)}"


def _best_of_kmer(rank: str) -> str:
    return f"""WITH {CANDIDATES}, k AS (
            SELECT m.read_id, m.start, m.pos, m.base, t.multiplicity, CASE WHEN {rank} THEN ascii(m.base) ELSE -ascii(m.base) END AS rank
            FROM (SELECT *, {_canonical("m")} AS canonical FROM mutants) m JOIN trusted t USING (canonical) JOIN weak w ON w.read_id = m.read_id AND w.pos = m.start)
        SELECT read_id, start, pos, base, multiplicity FROM (SELECT *, row_number() OVER (PARTITION BY read_id, start, pos ORDER BY multiplicity DESC, rank DESC) AS turn FROM k) WHERE turn = 1"""


def _two_sided_round(i: str, source: str) -> str:
    """fixed (read_id, seq): the reads of `source` after one more round of the two-sided fix."""
    return f"""tw{i} AS MATERIALIZED (SELECT read_id, seq, length(seq) AS n, translate(seq, 'NWKSYMR', 'AAAAAAA') AS enc FROM {source} WHERE length(seq) >= 16),
    hw{i} AS MATERIALIZED (SELECT DISTINCT read_id, pos FROM (SELECT read_id, pos, substring(enc, CAST(pos + 1 AS BIGINT), 16) AS g FROM (SELECT read_id, enc, unnest(range(0, n - 15)) AS pos FROM tw{i})) x JOIN tr2 ON tr2.canonical = {_canonical("x.g")}),
    ow{i} AS (SELECT read_id, enc, n, p FROM (SELECT read_id, enc, n, unnest(range(n)) AS p FROM tw{i}) x WHERE NOT EXISTS (SELECT 1 FROM hw{i} h WHERE h.read_id = x.read_id AND h.pos BETWEEN x.p - 15 AND x.p)),
    yw{i} AS (
        SELECT read_id, p, base, substring(t, CAST(least(p, n - 16) + 1 AS BIGINT), 16) AS r, substring(t, CAST(greatest(p - 15, 0) + 1 AS BIGINT), 16) AS l
        FROM (SELECT *, substring(enc, 1, CAST(p AS BIGINT)) || base || substring(enc, CAST(p + 2 AS BIGINT)) AS t FROM ow{i}, {_BASES} WHERE substring(enc, CAST(p + 1 AS BIGINT), 1) <> base)),
    zw{i} AS (SELECT read_id, p, min(base) AS base FROM yw{i} JOIN tr2 a ON a.canonical = {_canonical("r")} JOIN tr2 b ON b.canonical = {_canonical("l")} GROUP BY read_id, p HAVING count(*) = 1),
    fw{i} AS (SELECT read_id, min(p) AS p, arg_min(base, p) AS base FROM zw{i} GROUP BY read_id),
    fixed{i} AS MATERIALIZED (SELECT read_id, CASE WHEN p IS NULL THEN seq ELSE substring(seq, 1, CAST(p AS BIGINT)) || base || substring(seq, CAST(p + 2 AS BIGINT)) END AS seq FROM {source} LEFT JOIN fw{i} USING (read_id))"""


_TWICE = f"{TWO_SIDED}, tr2 AS MATERIALIZED (SELECT canonical FROM trusted), {_two_sided_round('2', 'fixed')}"
_WRITTEN = f"""stored AS ({READS.removeprefix("reads AS (").rstrip()[:-1]}),
    reads AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY read_id) - 1 AS ordinal, read_id, regexp_replace(coalesce(header, ''), '[\r\n]', ' ', 'g') AS header, coalesce(seq, '') AS seq, coalesce(qual, '') AS qual
        FROM stored WHERE length(coalesce(seq, '')) = length(coalesce(qual, '')))"""
_SUFFIX = "CASE WHEN regexp_matches(split_part(header, ' ', 1), '(^|[.-])[0-9]{1,18}$') THEN CAST(regexp_extract(split_part(header, ' ', 1), '[0-9]+$') AS BIGINT) - 1 END"
_STREAM_FIELD = '(?:"(?:[^"]|"")*"|[^",\\n]*)'
_STREAM_HEAD = '(?:@(?:[!#-+\\x2d-~][^",\\n]*)?,|"@(?:[!#-~]|"")(?:[^"]|"")*",|"@",)'
_STREAMS = f"""blocks AS (
        SELECT raw_file, CAST(floor(line_no / 64) AS BIGINT) AS block, replace(string_agg(coalesce(raw_line, ''), chr(10) ORDER BY line_no NULLS FIRST, record_id NULLS FIRST), chr(13) || chr(10), chr(10)) AS body
        FROM raw_records GROUP BY raw_file, block),
    walk(raw_file, block, body, record_start, rec, resumed_at, pos) AS (
        SELECT raw_file, block, body, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM blocks
        UNION ALL
        SELECT raw_file, block, body, a, rec, CASE WHEN ok THEN NULL ELSE least(a + coalesce(jump, length(rest)), length(body)) END, a + CASE WHEN ok THEN length(rec) ELSE coalesce(jump, length(rest)) END
        FROM (
            SELECT *, CASE WHEN ok THEN regexp_extract(rest, '(?s)^({_STREAM_FIELD}(?:,{_STREAM_FIELD})*)(?:\n|\\z)', 1) END AS rec,
                CASE WHEN NOT ok AND regexp_matches(rest, '(?s)\n{_STREAM_HEAD}{_STREAM_FIELD},{_STREAM_FIELD}(?:\n|\\z)') THEN length(regexp_extract(rest, '(?s)^(.*?)\n{_STREAM_HEAD}{_STREAM_FIELD},{_STREAM_FIELD}(?:\n|\\z)', 1)) + 1 END AS jump
            FROM (
                SELECT *, regexp_matches(rest, '(?s)^{_STREAM_FIELD}(?:,{_STREAM_FIELD})*(?:\n|\\z)') AS ok
                FROM (SELECT raw_file, block, body, pos + length(regexp_extract(substring(body, pos + 1), '^\n*')) AS a, substring(body, pos + length(regexp_extract(substring(body, pos + 1), '^\n*')) + 1) AS rest FROM walk)
                WHERE rest <> ''))),
    split AS (SELECT raw_file, block, record_start, rec, resumed_at, regexp_full_match(rec, '(?s){_THREE}') AS three, {", ".join(f"regexp_extract(rec, '(?s)^{_THREE}\\z', {i}) AS f{i}" for i in (1, 2, 3))} FROM walk WHERE record_start IS NOT NULL),
    typed AS (SELECT *, {", ".join(f"{_VALUE.format(f'f{i}')} AS {n}" for i, n in ((1, "header"), (2, "seq"), (3, "quality")))} FROM split),
    judged AS (
        SELECT *, CASE WHEN resumed_at IS NOT NULL THEN 'quoting' WHEN NOT three THEN 'columns' WHEN NOT regexp_matches(header, '\\A@[!-~]') THEN 'header'
            WHEN NOT regexp_full_match(seq, '[ACGTN]+') THEN 'seq' WHEN NOT regexp_full_match(quality, '[!-~]+') THEN 'quality' WHEN length(seq) <> length(quality) THEN 'length' END AS reason FROM typed)"""
_MAPPED = "coalesce(length(seq), 0) > 0"

ORACLE = {
    "reads_latest": f"WITH {READS} SELECT * FROM reads",
    "read_lengths_offsets": f"""WITH {READS}, o AS (SELECT read_id, coalesce(length(seq), 0) AS n, sum(coalesce(length(seq), 0)) OVER (ORDER BY read_id ROWS UNBOUNDED PRECEDING) AS e FROM reads)
        SELECT read_id, CAST(e - n AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM o""",
    "read_length_max": f"WITH {READS} SELECT CAST(max(length(seq)) AS INTEGER) AS longest FROM reads",
    "read_partition_ntile": f"""WITH {READS}, t AS (SELECT read_id, CAST(ntile(12) OVER (ORDER BY read_id) AS INTEGER) AS part FROM reads)
        SELECT part, min(read_id) AS first_read, max(read_id) AS last_read, count(*) AS n_reads FROM t GROUP BY part""",
    "read_range": f"WITH {READS} SELECT read_id, header, seq, ordinal FROM (SELECT *, row_number() OVER (ORDER BY read_id) - 1 AS ordinal FROM reads) WHERE ordinal BETWEEN 250 AND 749",
    "read_count": f"WITH {READS} SELECT count(*) AS n_reads FROM reads",
    "id_suffix_parse": f"WITH {READS}, s AS (SELECT read_id, regexp_extract(split_part(header, ' ', 1), '[0-9]*$') AS n, regexp_matches(split_part(header, ' ', 1), '(^|[.-])[0-9]{{1,18}}$') AS ok FROM reads) SELECT read_id, CASE WHEN ok THEN CAST(n AS BIGINT) - 1 END AS row_index FROM s",
    "id_suffix_join": f"""WITH {READS}, s AS (SELECT read_id, CASE WHEN regexp_matches(split_part(header, ' ', 1), '(^|[.-])[0-9]{{1,18}}$') THEN CAST(regexp_extract(split_part(header, ' ', 1), '[0-9]+$') AS BIGINT) - 1 END AS row_index FROM reads),
        p AS (SELECT read_id AS row_index, max(reads) AS reads FROM parse_results GROUP BY read_id) SELECT read_id, row_index, reads FROM s JOIN p USING (row_index)""",
    "fastq_file_stems": "SELECT run_id, regexp_extract(fastq_file, '^(.*?)\\.(fastq|fq)', 1) AS stem FROM runs",
    "seq_decode_roundtrip": f"WITH {READS} SELECT read_id, translate(seq, 'ACGTN', '12345') AS digits, seq AS decoded FROM reads WHERE seq IS NOT NULL",
    "read_reverse_complement": f"WITH {READS} SELECT read_id, translate(reverse(seq), 'ACGTN', 'TGCAN') AS rc FROM reads WHERE seq IS NOT NULL",
    "replace_quality": f"""WITH {READS}, {RECORDS}, a AS (SELECT read_id, header, seq, row_number() OVER (ORDER BY read_id) AS i FROM reads),
        b AS (SELECT quality, row_number() OVER (ORDER BY record_id) AS i FROM judged WHERE reason IS NULL) SELECT read_id, header, seq, quality AS new_qual FROM a JOIN b USING (i)""",
    "fastq_roundtrip": f"WITH {READS} SELECT read_id, seq, qual FROM reads WHERE length(seq) = length(qual) AND length(seq) > 0 AND header IS NOT NULL",
    "kmer_windows": f"""WITH {WINDOWS} SELECT read_id, pos, e.kmer, w.canonical, CAST(translate(w.canonical, 'ACGT', '1234') AS BIGINT) AS key FROM every e LEFT JOIN win w USING (read_id, pos)""",
    "kmer_counts_forward": f"WITH {WINDOWS} SELECT kmer, count(*) AS n FROM win GROUP BY kmer",
    "kmer_counts_canonical": f"WITH {WINDOWS} SELECT {_KEY} AS key, CAST(least(count(*), 255) AS INTEGER) AS multiplicity FROM win GROUP BY canonical",
    "kmer_counts_merged": "SELECT key, CAST(least(sum(coalesce(multiplicity, 0)), 255) AS INTEGER) AS multiplicity FROM kmer_counts WHERE key IS NOT NULL GROUP BY key",
    "kmer_nonunique": f"WITH {OFTEN} SELECT {_KEY} AS key, multiplicity FROM often",
    "repeated_kmers": f"WITH {WINDOWS} SELECT kmer, count(*) - 1 AS repeats FROM win GROUP BY kmer HAVING count(*) >= 2",
    "kmer_decoded": "SELECT DISTINCT key, translate(CAST(key AS VARCHAR), '1234', 'ACGT') AS decoded, canonical = translate(CAST(key AS VARCHAR), '1234', 'ACGT') AS same FROM kmers WHERE key IS NOT NULL",
    "kmer_neighbours": "SELECT DISTINCT kmer, substring(kmer, 2) || 'A' AS \"on\", 'T' || substring(kmer, 1, length(kmer) - 1) AS back FROM kmers WHERE canonical IS NOT NULL",
    "kmer_histogram": f"WITH {OFTEN} SELECT multiplicity, count(*) AS kmers FROM often GROUP BY multiplicity",
    "kmer_density": f"WITH {OFTEN} SELECT bin, kmers FROM density",
    "kmer_cutoff": f"WITH {OFTEN} SELECT cutoff FROM cut",
    "spectrum_trusted": f"WITH {TRUSTED} SELECT {_KEY} AS key, multiplicity FROM trusted",
    "stream_counts": """WITH e AS (SELECT substring(s, i, 16) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 14)) AS i FROM (SELECT translate(reads, 'NWKSYMR', 'AAAAAAA') AS s FROM parse_results WHERE length(reads) >= 16))),
        c AS (SELECT least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS canonical FROM e WHERE regexp_full_match(kmer, '[ACGT]+'))
        SELECT CAST(translate(canonical, 'ACGT', '1234') AS BIGINT) AS key, CAST(least(count(*), 255) AS INTEGER) AS multiplicity FROM c GROUP BY canonical""",
    "kmer_membership_semi": f"WITH {TRUSTED} SELECT read_id, pos FROM win SEMI JOIN trusted USING (canonical)",
    "kmer_membership_anti": f"WITH {TRUSTED} SELECT read_id, pos FROM win ANTI JOIN trusted USING (canonical)",
    "kmer_multiplicity_lookup": f"WITH {TRUSTED} SELECT e.read_id, e.pos, coalesce(multiplicity, 0) AS multiplicity FROM every e LEFT JOIN win w USING (read_id, pos) LEFT JOIN trusted t ON w.canonical = t.canonical",
    "solid_bases": f"WITH {SOLID} SELECT read_id, pos, solid FROM solids",
    "solid_bases_forward": f"""WITH {SOLID},
        hit1 AS (SELECT read_id, pos FROM win WHERE kmer IN (SELECT canonical FROM trusted))
        SELECT read_id, pos, max(h) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) = 1 AS solid
        FROM (SELECT p.read_id, p.pos, CASE WHEN h.pos IS NULL THEN 0 ELSE 1 END AS h FROM places p LEFT JOIN hit1 h ON p.read_id = h.read_id AND p.pos = h.pos)""",
    "trusted_regions": f"WITH {REGIONS} SELECT read_id, lo, hi, span FROM regions",
    "trusted_base_regions": f"""WITH {SOLID} SELECT read_id, min(pos) AS lo, max(pos) AS hi
        FROM (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS run FROM solids WHERE solid) GROUP BY read_id, run HAVING count(*) >= 16""",
    "regions_ping_order": f"WITH {REGIONS} SELECT read_id, lo, hi, span, CAST(row_number() OVER (PARTITION BY read_id ORDER BY span DESC, lo) AS INTEGER) AS turn FROM regions",
    "regions_pong_order": f"WITH {REGIONS} SELECT read_id, lo, hi, span, CAST(row_number() OVER (PARTITION BY read_id ORDER BY span, lo) AS INTEGER) AS turn FROM regions",
    "all_solid_reads": f"WITH {SOLID} SELECT read_id, bool_and(solid) AS all_solid FROM solids GROUP BY read_id UNION ALL SELECT read_id, true FROM reads WHERE seq = ''",
    "solid_diagnostics": f"""WITH {SOLID}, per AS (SELECT read_id, count(*) AS n, count(*) FILTER (solid) AS s FROM solids GROUP BY read_id)
        SELECT count(*) AS reads, CAST(coalesce(sum(n), 0) AS BIGINT) AS bases, CAST(coalesce(sum(s), 0) AS BIGINT) AS solid_bases, count(*) FILTER (s < n) AS error_reads, CAST(coalesce(sum(n - s), 0) AS BIGINT) AS unsolid_bases FROM per""",
    "mutation_candidates": f"WITH {CANDIDATES} SELECT read_id, pos, base, start, multiplicity FROM candidates",
    "best_alternative": f"""WITH {CANDIDATES} SELECT read_id, pos, base, multiplicity FROM (
        SELECT *, row_number() OVER (PARTITION BY read_id, pos ORDER BY multiplicity DESC, base) AS turn FROM (SELECT read_id, pos, base, max(multiplicity) AS multiplicity FROM candidates GROUP BY read_id, pos, base)) WHERE turn = 1""",
    "vote_matrix": f"WITH {CANDIDATES} SELECT read_id, pos, base, votes FROM votes",
    "vote_winners": f"""WITH {CANDIDATES}, best AS (SELECT *, max(votes) OVER (PARTITION BY read_id) AS most FROM votes)
        SELECT read_id, pos, max(base) AS base, max(votes) AS votes FROM best WHERE votes = most GROUP BY read_id, pos HAVING count(*) <> 2""",
    "vote_place_winners": f"""WITH {CANDIDATES} SELECT read_id, pos, base, votes FROM (
        SELECT *, row_number() OVER (PARTITION BY read_id, pos ORDER BY votes DESC, base) AS turn FROM votes) WHERE turn = 1""",
    "vote_winners_limited": f"""WITH {CANDIDATES}, best AS (SELECT *, max(votes) OVER (PARTITION BY read_id) AS most FROM votes),
        won AS (SELECT read_id, pos, max(base) AS base FROM best WHERE votes = most GROUP BY read_id, pos HAVING count(*) <> 2),
        spread AS (SELECT read_id, pos, unnest(range(greatest(pos - 15, 0), least(pos, length(seq) - 16) + 1)) AS start FROM won JOIN reads USING (read_id) WHERE length(seq) >= 16),
        crowded AS (SELECT read_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY read_id, start) AS n FROM spread) WHERE n > 2)
        SELECT read_id, pos, base FROM won ANTI JOIN crowded USING (read_id, pos)""",
    "vote_diagnostics": f"WITH {CANDIDATES} SELECT count(DISTINCT read_id) AS reads, max(votes) AS most, CAST(sum(votes) AS BIGINT) AS votes FROM votes",
    "best_alternative_strand": _best_of_kmer(f"{_rc('w.kmer')} <= w.kmer"),
    "best_alternative_last": _best_of_kmer("true"),
    "lookahead_confirmed": f"WITH {_CONFIRMED} AND toright",
    "lookbehind_confirmed": f"WITH {_CONFIRMED} AND NOT toright",
    "one_sided_first_step": f"""WITH {_STEPS} SELECT read_id, lo, toright AS to_right, CAST(s + CASE WHEN toright THEN 15 ELSE 0 END AS INTEGER) AS pos, pick AS base
        FROM ({_judged("tips", "read_id, lo, toright", "s, work", 4)}) WHERE pick IS NOT NULL""",
    "one_sided_codes": f"WITH RECURSIVE {_CODES} SELECT read_id, CAST(n AS INTEGER) AS code FROM px",
    "one_sided_report": f"""WITH RECURSIVE {_CODES} SELECT count(*) FILTER (n = -1) AS all_solid, count(*) FILTER (n = 0) AS unchanged, count(*) FILTER (n > 0) AS changed, CAST(coalesce(sum(n) FILTER (n > 0), 0) AS BIGINT) AS changes FROM px""",
    "two_sided_applied_twice": f"WITH {_TWICE} SELECT read_id, seq FROM fixed2",
    "tp_fp_fn_twice": f"""WITH {_TWICE}, {PARSED},
        t AS (SELECT p.seq AS r, reads.seq AS o, fixed2.seq AS c, unnest(range(1, least(length(p.seq), length(reads.seq), length(fixed2.seq)) + 1)) AS i FROM reads JOIN fixed2 USING (read_id) JOIN parsed p USING (read_id) WHERE reads.seq IS NOT NULL AND p.seq IS NOT NULL),
        s AS (SELECT substring(r, i, 1) AS r, substring(o, i, 1) AS o, substring(c, i, 1) AS c FROM t)
        SELECT count(*) FILTER (o <> r AND c = r) AS tp, count(*) FILTER (o = r AND c <> r) AS fp, count(*) FILTER (o <> r AND c <> r) AS fn FROM s""",
    "fastq_range": f"WITH {_WRITTEN} SELECT ordinal, header, seq, qual FROM reads WHERE ordinal BETWEEN 250 AND 749",
    "correct_fastq": f"WITH RECURSIVE {CORRECTED.replace(READS, _WRITTEN)} SELECT ordinal, header, corrected AS seq, qual FROM corrected JOIN reads USING (read_id)",
    "fastq_by_suffix": f"""WITH {_WRITTEN}, o AS (SELECT read_id AS row_index, max(reads) AS other FROM parse_results WHERE reads IS NOT NULL GROUP BY read_id)
        SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, header, other AS seq, qual FROM (SELECT *, {_SUFFIX} AS row_index FROM reads) JOIN o USING (row_index) WHERE length(other) = length(qual)""",
    "sam_rates": f"""WITH {READS}, a AS (SELECT {_MAPPED} AS mapped, CASE WHEN coalesce(qual, '') = '' THEN 0 ELSE greatest(ascii(qual) - 33, 0) END AS mapq, length(regexp_replace(seq, '[ACGTRYKMSWacgtn]', '', 'g')) AS nm FROM reads)
        SELECT count(*) AS total, count(*) FILTER (mapq >= 1) AS uniquely, CAST(count(*) FILTER (mapq >= 1) * 100 // count(*) AS BIGINT) AS percent, count(*) FILTER (mapped AND nm > 0) AS with_errors FROM a""",
    "sam_confusion": f"""WITH RECURSIVE {CORRECTED}, {PARSED},
        p AS (SELECT read_id, x.seq AS o, corrected AS c, 'ACGTACG' || p.seq AS whole, length(x.seq) AS n, length(x.seq) > 10 AND read_id % 3 = 1 AS gap, CASE WHEN length(x.seq) > 10 AND read_id % 5 = 2 THEN 2 ELSE 0 END AS clip
            FROM (SELECT reads.*, corrected FROM reads JOIN corrected USING (read_id)) x JOIN (SELECT read_id, seq FROM parsed WHERE seq IS NOT NULL) p USING (read_id) WHERE length(x.seq) > 0),
        t AS (SELECT o, c, substring(whole, 8, CAST(n + CASE WHEN gap THEN 2 ELSE 0 END AS BIGINT)) AS r, clip, unnest(CASE WHEN gap THEN list_concat(range(0, 4), range(6, n + 2)) ELSE range(0, n) END) AS i, n FROM p),
        s AS (SELECT substring(r, i + 1, 1) AS r, substring(o, i + 1, 1) AS o, substring(c, i - clip + 1, 1) AS c FROM t WHERE i >= clip AND i < n AND i < length(r))
        SELECT count(*) FILTER (o <> r AND c = r) AS tp, count(*) FILTER (o = r AND c <> r) AS fp, count(*) FILTER (o <> r AND c <> r) AS fn FROM s""",
    "p5_streams": f"WITH RECURSIVE {_STREAMS} SELECT raw_file, block, CAST(record_start AS INTEGER) AS record_start, CASE WHEN reason IS NULL THEN header END AS header, CASE WHEN reason IS NULL THEN seq END AS seq, CASE WHEN reason IS NULL THEN quality END AS quality, reason, CAST(resumed_at AS INTEGER) AS resumed_at FROM judged",
    "correct_reads_full": f"WITH RECURSIVE {CORRECTED} SELECT read_id, header, qual, corrected FROM corrected JOIN reads USING (read_id)",
    "corrections_made": f"""WITH RECURSIVE {CORRECTED},
        d AS (SELECT run_id, len(list_filter(range(1, length(seq) + 1), lambda i: substring(seq, i, 1) <> substring(corrected, i, 1))) AS n FROM corrected JOIN reads USING (read_id) WHERE seq IS NOT NULL)
        SELECT run_id, count(*) AS n_reads, count(*) FILTER (n > 0) AS reads_changed, CAST(sum(n) AS BIGINT) AS bases_changed FROM d GROUP BY run_id""",
    "tp_fp_fn_full": f"""WITH RECURSIVE {CORRECTED}, {PARSED},
        t AS (SELECT p.seq AS r, reads.seq AS o, corrected AS c, unnest(range(1, least(length(p.seq), length(reads.seq), length(corrected)) + 1)) AS i FROM reads JOIN corrected USING (read_id) JOIN parsed p USING (read_id) WHERE reads.seq IS NOT NULL AND p.seq IS NOT NULL),
        s AS (SELECT substring(r, i, 1) AS r, substring(o, i, 1) AS o, substring(c, i, 1) AS c FROM t)
        SELECT count(*) FILTER (o <> r AND c = r) AS tp, count(*) FILTER (o = r AND c <> r) AS fp, count(*) FILTER (o <> r AND c <> r) AS fn FROM s""",
    "solid_changes": f"""WITH {TWO_SIDED},
        win2 AS (SELECT read_id, i - 1 AS pos, substring(s, i, 16) AS kmer FROM (SELECT read_id, s, unnest(range(1, length(s) - 14)) AS i FROM (SELECT read_id, translate(seq, 'NWKSYMR', 'AAAAAAA') AS s FROM fixed WHERE length(seq) >= 16))),
        hit2 AS (SELECT read_id, pos FROM win2 WHERE regexp_full_match(kmer, '[ACGT]+') AND least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) IN (SELECT canonical FROM trusted)),
        after AS (
            SELECT read_id, pos, max(h) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) = 1 AS a
            FROM (SELECT p.read_id, p.pos, CASE WHEN h.pos IS NULL THEN 0 ELSE 1 END AS h FROM places p LEFT JOIN hit2 h ON p.read_id = h.read_id AND p.pos = h.pos))
        SELECT count(*) FILTER (a AND NOT solid) AS gained, count(*) FILTER (solid AND NOT a) AS lost, count(*) FILTER (a = solid) AS same FROM solids JOIN after USING (read_id, pos)""",
    "two_sided_candidates": f"WITH {TWO_SIDED} SELECT read_id, pos, base FROM paired",
    "two_sided_fix_first": f"WITH {TWO_SIDED} SELECT read_id, pos, base FROM fix",
    "two_sided_interior": f"""WITH {TWO_SIDED}, one AS (SELECT read_id, pos, min(base) AS base FROM paired GROUP BY read_id, pos HAVING count(*) = 1)
        SELECT read_id, pos, base FROM one JOIN reads USING (read_id) WHERE pos BETWEEN 15 AND length(seq) - 16""",
    "two_sided_applied": f"WITH {TWO_SIDED} SELECT read_id, seq FROM fixed",
    "read_diff_left_join": f"""WITH {READS}, {PARSED}, j AS (SELECT r.read_id, CASE WHEN p.read_id IS NULL THEN 'missing' WHEN r.seq IS DISTINCT FROM p.seq THEN 'differs' END AS status FROM reads r LEFT JOIN parsed p USING (read_id))
        SELECT read_id, status FROM j WHERE status IS NOT NULL""",
    "position_intersection": f"""WITH {READS}, {PARSED}, j AS (SELECT read_id, r.seq AS a, p.seq AS b, least(length(r.seq), length(p.seq)) AS n FROM reads r JOIN parsed p USING (read_id) WHERE r.seq IS NOT NULL AND p.seq IS NOT NULL)
        SELECT read_id, CAST(n AS INTEGER) AS positions, CAST(len(list_filter(range(1, n + 1), lambda i: substring(a, i, 1) = substring(b, i, 1))) AS INTEGER) AS matches FROM j""",
    "tp_fp_fn": f"""WITH {TWO_SIDED}, {PARSED},
        t AS (SELECT p.seq AS r, reads.seq AS o, fixed.seq AS c, unnest(range(1, least(length(p.seq), length(reads.seq), length(fixed.seq)) + 1)) AS i FROM reads JOIN fixed USING (read_id) JOIN parsed p USING (read_id) WHERE reads.seq IS NOT NULL AND p.seq IS NOT NULL),
        s AS (SELECT substring(r, i, 1) AS r, substring(o, i, 1) AS o, substring(c, i, 1) AS c FROM t)
        SELECT count(*) FILTER (o <> r AND c = r) AS tp, count(*) FILTER (o = r AND c <> r) AS fp, count(*) FILTER (o <> r AND c <> r) AS fn FROM s""",
    "unique_rate": f"WITH {ALIGNED} SELECT count(*) AS total, count(*) FILTER (mapq >= 1) AS uniquely, CAST(count(*) FILTER (mapq >= 1) * 100 // count(*) AS BIGINT) AS percent FROM alignments",
    "mapped_with_errors": f"WITH {ALIGNED} SELECT count(*) FILTER (flag & 4 = 0 AND nm > 0) AS n FROM alignments",
    "p5_found": f"WITH {RECORDS} SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_loaded": f"WITH {RECORDS} SELECT record_id, header, seq, quality FROM judged WHERE reason IS NULL",
}
