"""Long exact spans shared between records, by suffix automata of shards of the texts.

Two records can share a window of `window` letters only if its rarest-looking seed (the one of its SEED-letter substrings
with the smallest hash) is the same. So each text is cut into segments of consecutive windows with the same seed, and
the segments of one seed make up one shard: every shared window lies whole in both records' segments of one shard. The
suffix automaton of a shard's segments is built where the shard lies, and the segments are streamed through it: the
matching statistics, cut at `window`, lead to one state per window, which knows whether two records reach it. (Sending
automata of all texts to all tasks instead would cost the square of the input.)

A shard gets each distinct segment with the smallest and the largest id of its records, not the places where it occurs: a
segment in a third of all records is one text there. The spans found join the places afterwards, salted where a segment
is frequent. A shard of more than SHARD_LETTERS distinct letters is cut again, its segments by the least seed of another
hash, and what is still too large by whole windows, of which each is one text: so every span comes from an automaton.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.tables import stage

WINDOW, SEED, SHARD_LETTERS, HOT_LEAST, SALTS = 64, 32, 300_000, 64, 16
BY_WINDOW = 2  # the level at which each window is a segment of its own
_U = np.uint64
_LETTERS = np.full(256, 4, np.uint8)
_LETTERS[list(b"ACGT")] = range(4)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _codes(letters: np.ndarray, size: int) -> np.ndarray:
    """Two bits a letter, for every stretch of `size` letters, by doubling."""
    part, p, out, have = letters.astype(_U), 1, None, 0
    while size:
        if size & 1:
            out = part if out is None else (out[: len(part) - have] << _U(2 * p)) | part[have:]
            have += p
        size >>= 1
        if size:
            part = (part[:-p] << _U(2 * p)) | part[p:]
            p *= 2
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    p = 1
    while 2 * p <= width:
        x, p = np.minimum(x[:-p], x[p:]), 2 * p
    return np.minimum(x[: len(x) - (width - p)], x[width - p :]) if p < width else x


class Windows:
    """The valid windows of a batch of texts: `at` (offset in the flat text) and `key`, the shard of each at this level."""

    def __init__(self, texts: pa.StringArray, window: int, level: int) -> None:
        raw = [t.encode("ascii", "replace") + b" " for t in texts.to_pylist()]  # one byte a letter
        self.flat = b"".join(raw)
        self.begin = np.cumsum([0, *map(len, raw)])[:-1]
        self.window, self.level = window, level
        letters = _LETTERS[np.frombuffer(self.flat, np.uint8)]
        if len(letters) < window:
            self.at, self.key = np.zeros(0, np.int64), np.zeros(0, _U)
            return
        seed = min(SEED, window)
        code, bad = _codes(letters & 3, seed), np.r_[0, np.cumsum(letters > 3)]
        if level < BY_WINDOW:
            key = _least(_mixed(code, level), window - seed + 1)
        else:
            n, key = len(letters) - window + 1, np.zeros(len(letters) - window + 1, _U)
            for i in sorted({*range(0, window - seed, seed), window - seed}):
                key = _mixed(key ^ code[i : i + n], level)
        self.at = np.nonzero(bad[window:] == bad[:-window])[0]
        self.key = key[self.at]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """The first window of each segment and the one behind its last."""
        if not len(self.at):
            return self.at, self.at
        new = (self.key[1:] != self.key[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.level >= BY_WINDOW)
        cut = np.nonzero(new)[0] + 1
        return np.r_[0, cut], np.r_[cut, len(self.at)]


SEGMENT = "key BIGINT, text STRING, low BIGINT, high BIGINT, n BIGINT, hot BOOLEAN, ids ARRAY<BIGINT>, starts ARRAY<INT>"
PART = "key BIGINT, text STRING, low BIGINT, high BIGINT, n BIGINT, hot BOOLEAN, outer_key BIGINT, outer_text STRING, start INT"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _segments(batches: Iterator[pa.RecordBatch], window: int, least: int) -> Iterator[pa.RecordBatch]:
    """One row per distinct segment of a batch of records (id, text), with its places."""
    for batch in batches:
        w = Windows(batch.column(1), window, 0)
        ids = batch.column(0).to_numpy()
        first, end = w.segments()
        start, row = w.at[first], w.row(w.at[first])
        stop, key = w.at[end - 1] + window, w.key[first].view(np.int64)
        place = start - w.begin[row]
        found: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
        for s, a, b, r, p in zip(key.tolist(), start.tolist(), stop.tolist(), ids[row].tolist(), place.tolist()):
            where = found.setdefault((s, w.flat[a:b]), ([], []))
            where[0].append(r)
            where[1].append(p)
        held = [v[0] for v in found.values()]
        n = np.array([len(v) for v in held], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1].decode() for k in found], pa.string()), pa.array([min(v) for v in held], pa.int64()), pa.array([max(v) for v in held], pa.int64()), pa.array(n), pa.array(n >= least), pa.array(held, pa.list_(pa.int64())), pa.array([v[1] for v in found.values()], pa.list_(pa.int32()))],
            names=_names(SEGMENT),
        )


def _parts(batches: Iterator[pa.RecordBatch], window: int, level: int, least: int) -> Iterator[pa.RecordBatch]:
    """The segments (key, text, low, high) of shards that are too large, cut at the next level: one row per place."""
    for batch in batches:
        w = Windows(batch.column(1), window, level)
        first, end = w.segments()
        row = w.row(w.at[first])
        outer = batch.column(0).to_numpy()[row]
        key = w.key[first] if level >= BY_WINDOW else _mixed(w.key[first] ^ outer.view(_U), level)
        text = [w.flat[a:b].decode() for a, b in zip(w.at[first].tolist(), (w.at[end - 1] + window).tolist())]
        named = list(zip(key.tolist(), text))
        often = Counter(named)
        low, high = batch.column(2).to_numpy()[row], batch.column(3).to_numpy()[row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(text, pa.string()), pa.array(low), pa.array(high), pa.array(np.ones(len(row), np.int64)), pa.array([often[x] >= least for x in named], pa.bool_()), pa.array(outer), batch.column(1).take(pa.array(row)), pa.array((w.at[first] - w.begin[row]).astype(np.int32))],
            names=_names(PART),
        )


class SuffixAutomaton:
    """Of several texts over four letters: state 0 is empty; `follow` has four entries a state, -1 for none."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.follow, self.link, self.size = [-1, -1, -1, -1], [-1], [0]

    def add(self, text: bytes) -> None:
        follow, link, size, last = self.follow, self.link, self.size, 0
        for c in text:
            to = follow[4 * last + c]
            if to >= 0:  # the text so far is known
                last = to if size[to] == size[last] + 1 else self._split(last, to, c)
                continue
            new = len(size)
            size.append(size[last] + 1)
            follow += (-1, -1, -1, -1)
            link.append(0)
            p = last
            while p >= 0 and follow[4 * p + c] < 0:
                follow[4 * p + c] = new
                p = link[p]
            if p >= 0:
                to = follow[4 * p + c]
                link[new] = to if size[to] == size[p] + 1 else self._split(p, to, c)
            last = new

    def _split(self, p: int, to: int, c: int) -> int:
        """A copy of state `to` for the shorter texts that reach it from p."""
        follow, link = self.follow, self.link
        copy = len(self.size)
        self.size.append(self.size[p] + 1)
        follow += follow[4 * to : 4 * to + 4]
        link.append(link[to])
        link[to] = copy
        while p >= 0 and follow[4 * p + c] == to:
            follow[4 * p + c] = copy
            p = link[p]
        return copy

    def windows(self, text: bytes) -> list[int]:
        """Streaming `text`: the state of each window, that is of the last letters at each place."""
        follow, link, size, window, v, out = self.follow, self.link, self.size, self.window, 0, []
        for n, c in enumerate(text, 1):
            v = follow[4 * v + c]
            while size[link[v]] >= window:
                v = link[v]
            if n >= window:
                out.append(v)
        return out


_TO_LETTERS = bytes(_LETTERS.tolist())
FOUND = "key BIGINT, text STRING, low BIGINT, high BIGINT, n BIGINT, span_start INT, span_end INT"


def _shard_rows(texts: dict[str, list[int]], window: int) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the shared spans of one shard; texts: {text: [smallest id, largest id, places]}."""
    lowest = min(v[0] for v in texts.values())
    if all(v[0] == v[1] == lowest for v in texts.values()):
        return
    automaton = SuffixAutomaton(window)
    coded = {t: t.encode().translate(_TO_LETTERS) for t in sorted(texts)}
    for c in coded.values():
        automaton.add(c)
    path = {t: automaton.windows(c) for t, c in coded.items()}
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for t, states in path.items():
        a, b, _ = texts[t]
        for v in states:
            if a < low.get(v, a + 1):
                low[v] = a
            if b > high.get(v, b - 1):
                high[v] = b
    for t, states in path.items():
        shared, i = [low[v] != high[v] for v in states], 0
        while i < len(shared):
            if shared[i]:
                j = i
                while j < len(shared) and shared[j]:
                    j += 1
                yield t, i, j - 1 + window
                i = j
            i += 1


def _match(batches: Iterator[pa.RecordBatch], window: int, most_letters: float) -> Iterator[pa.RecordBatch]:
    """Per shard its texts with a shared span, one row a span; of a shard that is too large its distinct texts, without a span."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    out: list[tuple] = []
    now, held, letters, large = None, {}, 0, False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=_names(FOUND))

    def passed_on() -> list[tuple]:
        return [(now, t, *v, None, None) for t, v in held.items()]

    def closed() -> list[tuple]:
        return passed_on() if large else [(now, t, *held[t], a, b) for t, a, b in _shard_rows(held, window)] if held else []

    for batch in batches:
        for key, text, low, high, n in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if key != now:
                out += closed()
                now, held, letters, large = key, {}, 0, False
            known = held.get(text)
            if known:
                known[0], known[1], known[2] = min(known[0], low), max(known[1], high), known[2] + n
            else:
                held[text] = [low, high, n]
                letters += len(text)
                if letters > most_letters:
                    large = True
                    out += passed_on()
                    held, letters = {}, 0
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
    out += closed()
    yield batch_of(out)


def _found(segments: DataFrame, window: int, level: int, most_letters: int, least: int) -> DataFrame:
    """(key, text, n, span_start, span_end): the shared spans of the distinct texts of `segments`."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = float("inf") if level >= BY_WINDOW else most_letters
    shards = segments.select("key", "text", "low", "high", "n").repartition(n, "key").sortWithinPartitions("key")
    matched = stage(shards.mapInArrow(lambda b: _match(b, window, limit), FOUND), "span-matches")
    spans = matched.where("span_end is not null").select("key", "text", "n", "span_start", "span_end")
    large = matched.where("span_end is null")
    if level >= BY_WINDOW or large.isEmpty():
        return spans
    cut = large.select("key", "text", "low", "high").mapInArrow(lambda b: _parts(b, window, level + 1, least), PART)
    parts = stage(cut, "span-parts")
    inner = _placed(parts, _found(parts, window, level + 1, most_letters, least), least)
    at = [(F.col("start") + F.col(c)).alias(c) for c in ("span_start", "span_end")]
    sums = large.groupBy("key", "text").agg(F.sum("n").alias("n"))  # a text may have been passed on more than once
    whole = inner.select(F.col("outer_key").alias("key"), F.col("outer_text").alias("text"), *at).distinct()
    return spans.unionByName(whole.join(sums.hint("merge"), ["key", "text"]).select(*spans.columns))


def _placed(segments: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """The segments beside each span of their text; those that a batch has often are spread by salt."""
    salt = F.when(F.col("hot"), F.pmod(F.hash(*(c for c in segments.columns if c not in ("key", "text"))), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.col("n") >= least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = segments.withColumn("salt", salt.cast("int")).drop("low", "high", "n", "hot")
    return spread.join(found.withColumn("salt", F.explode(salts)).drop("n").hint("merge"), ["key", "text", "salt"])


def shared_spans(df: DataFrame, record: str, text: str, window: int = WINDOW) -> DataFrame:
    """(read_id, span_start, span_end): the maximal runs of positions of a record that lie in a window of `window` letters
    A, C, G, T which also stands in a record of another id. Start 0-based, end exclusive.

    Rows with the same id are one record; null texts and ids are left out; texts shorter than the window give nothing.
    """
    most_letters, least = SHARD_LETTERS, HOT_LEAST
    rows = df.where(F.col(text).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("long").alias("id"), F.col(text).alias("text"))
    segments = stage(rows.mapInArrow(lambda b: _segments(b, window, least), SEGMENT), "span-segments")
    placed = _placed(segments, _found(segments, window, 0, most_letters, least), least)
    one = placed.select(F.explode(F.arrays_zip("ids", "starts")).alias("x"), "span_start", "span_end")
    spans = one.select(F.col("x.ids").alias("read_id"), (F.col("x.starts") + F.col("span_start")).alias("span_start"), (F.col("x.starts") + F.col("span_end")).alias("span_end"))
    return joined(spans.distinct())


def joined(spans: DataFrame) -> DataFrame:
    """Spans of a record that overlap or touch, as one."""
    by = Window.partitionBy("read_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("opens", F.when(F.col("span_start") <= reach, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("read_id", "run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("run")


def shared_shares(df: DataFrame, record: str, text: str, window: int = WINDOW) -> DataFrame:
    """(read_id, bases, shared_bases): for each record, how many of its letters are shared. Of several texts of one id the longest counts."""
    sums = shared_spans(df, record, text, window).groupBy("read_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_bases"))
    sizes = df.where(F.col(record).isNotNull()).groupBy(F.col(record).cast("long").alias("read_id")).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).alias("bases"))
    return sizes.join(sums, "read_id", "left").select("read_id", "bases", F.coalesce("shared_bases", F.lit(0)).alias("shared_bases"))
