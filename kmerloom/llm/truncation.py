"""Texts cut off before their end: by a limit of their source, or mid-transfer.

A limit shows as a spike in the upper half of the source's histogram of lengths, in characters or in bytes: many values
without a final mark at or just under one length, few on either side. Values at spike lengths without a final mark are cut. Marks put at a
cut (an ellipsis, also in brackets) are no final mark.

A transfer that breaks off leaves no spike. For the other values without a final mark, a logistic regression tells from
the last sentence whether it ends inside a word or sentence. It is fitted on about FIT_ROWS and PLAIN_ROWS of the table's own rows:
last sentences of texts with a final mark, as they are (without the mark) and cut at a random place, and the texts of
sources that mostly have no final mark, such as captions. A source may also lack them because it mostly breaks off: a
first regression, of the ends of the marked sentences alone, tells, and only sources of whose texts no more than PLAIN_CUT
look clearly cut (LOOKS_CUT) to it are taught as whole, texts with a mark of a cut not at all. What such a source holds
of cut texts is still taught as whole with the others; captions that end like no marked sentence are not taught.
Each text is taught once. The odds of the second are weighed by how often the source breaks off, by its mean. Texts of any length are judged, but not those of
numbers and signs alone: they end inside no word or sentence. Last, a text that equals a cut one is cut as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm import logistic
from kmerloom.tables import stage

NEAR, RING, LEAST, SHARE, EXCESS, NARROW = 3, 40, 8, 0.35, 4.0, 0.6  # see spikes
FIT_ROWS, FIT_FEATURES, PLAIN_ROWS, PLAIN_WEIGHT, LOOKS_CUT, PLAIN_CUT = 30_000, 1 << 17, 15_000, 4.0, 0.9, 0.2
FIT_PENALTY = 1e-3

# Fixed patterns: what may stand behind the last word of a whole text, and marks that a cut leaves. Long runs are
# taken at once and only from their start, so that a text of nothing but blanks or brackets costs linear time and no stack.
_BLANK = r"\s\p{Z}\p{Cf}\p{Cc}"
_CLOSE = _BLANK + r"\"'”»“’)\]」』）"
_AFTER_TAG = r"(?<!</?\w{1,12}/?>)"
_CLOSING = rf"(?=[{_CLOSE}<])(?<![{_CLOSE}]){_AFTER_TAG}(?:[{_CLOSE}]++|</?\w+/?>)++$"
_SPACE = rf"(?=[{_BLANK}<])(?<![{_BLANK}]){_AFTER_TAG}(?:[{_BLANK}]++|</?\w+/?>)++$"
_MARKER = r"(?<![\s…])(?<!\.\.\.)(?:\s*+(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\(\.\.\.\)))++$"
_OPENING = rf"^(?:[{_BLANK}]++|</?\w+/?>|&nbsp;)*+"
_FINAL_MARKS = ".!?。！？"
_MARKERS = ("...", "…", "...]", "…]", "...)")  # what a text must end with for _MARKER to match
_FINAL_SIGNS, _CLOSERS = ".!?。！？:：", r"\"'”»“’)\]」』）"
_FINALS = rf"(?<![{_FINAL_SIGNS}])[{_FINAL_SIGNS}]++([{_CLOSERS}]*+)$"
_SENTENCE_END = r"(?s)^.*(?:[.!?][\"'”»“’)]*\s+|[。！？][」』）]*|\n)(?=\S)"


def _ends(text: Column, last: str) -> Column:
    """Whether the last character is one of the class `last`: most texts need no pattern over all of them."""
    return F.rlike(F.substring(text, -1, 1), F.lit(f"[{last}]"))


def _without(text: Column, pattern: str, last: str) -> Column:
    """The text without what `pattern` matches at its end, which can only be where it ends with one of the class `last`."""
    return F.when(_ends(text, last), F.regexp_replace(text, pattern, "")).otherwise(text)


def _bare(text: Column) -> Column:
    return _without(text, _CLOSING, _CLOSE + ">")


def has_final_mark(text: Column) -> Column:
    """Whether a sentence ends at the end of the text; closing quotes, brackets, tags and white space don't count."""
    return _ends(_bare(text), _FINAL_MARKS) & ~has_marker(text)


def has_marker(text: Column) -> Column:
    """Whether the text ends with an ellipsis of any form."""
    return _marked(_without(text, _SPACE, _BLANK + ">"))


def _marked(text: Column) -> Column:
    may = F.endswith(text, F.lit(_MARKERS[0]))
    for m in _MARKERS[1:]:
        may = may | F.endswith(text, F.lit(m))
    return may & F.rlike(text, F.lit(_MARKER))


def judged(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """What the rest works on, staged so that each text is read and matched once: (key, source, chars, bytes, final, marker, text_hash, sentence, follows)."""
    t = F.col("t")
    rows = df.where(F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\s\p{Z}\p{Cf}\p{Cc}]")))
    named = rows.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("t"))
    sized = named.select("key", "source", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.xxhash64(t).alias("text_hash"), _bare(t).alias("closed"),
                         _without(t, _SPACE, _BLANK + ">").alias("spaced"), F.when(F.rlike(F.substring(t, -4, 4), F.lit(r"\S $")), " ").otherwise("").alias("space"))
    marked = sized.withColumn("marker", _marked(F.col("spaced"))).withColumn("final", _ends(F.col("closed"), _FINAL_MARKS) & ~F.col("marker"))
    bare = marked.withColumn("bare", F.when(F.col("marker"), F.regexp_replace("spaced", _MARKER, "")).otherwise(F.col("spaced")))
    pair, one_mark = F.substring("bare", -2, 2), F.lit(rf"(?s)^[^{_FINAL_SIGNS}][{_FINAL_SIGNS}]$")
    some = F.rlike(F.substring("bare", -1, 1), F.lit(rf"[{_FINAL_SIGNS}{_CLOSERS}]"))
    plain = F.when(F.rlike(pair, one_mark), F.expr("substring(bare, 1, length(bare) - 1)")).when(some, F.regexp_replace("bare", _FINALS, "$1")).otherwise(F.col("bare"))
    last = bare.withColumn("bare", plain).withColumn("last", F.regexp_replace("bare", _SENTENCE_END, ""))
    sentence = F.concat(F.regexp_replace(F.regexp_replace("last", _OPENING, ""), r"&nbsp;|[\p{Z}\t]", " "), "space")
    return stage(last.select("key", "source", "chars", "bytes", "final", "marker", "text_hash", sentence.alias("sentence"), (F.length("last") < F.length("bare")).alias("follows")), "truncation-rows")


def lengths(rows: DataFrame) -> DataFrame:
    """(source, unit, length, n, open): how many values have that length, and how many of them no final mark."""
    units = F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "length")
    return rows.select("source", "final", units).groupBy("source", "unit", "length").agg(F.count("*").alias("n"), F.sum((~F.col("final")).cast("int")).alias("open"))


def spikes(histogram: DataFrame) -> DataFrame:
    """(source, unit, length): the lengths at a spike.

    At least half of the source's values are no longer. Within NEAR of the length there are at least LEAST values without a final mark, at least SHARE of the values there,
    and EXCESS times as many as in as wide a stretch of the RING around; in a source that mostly has no final marks also
    NARROW of those within 4 * NEAR.
    """
    by = Window.partitionBy("source", "unit").orderBy("length")
    near, ring = by.rangeBetween(-NEAR, NEAR), by.rangeBetween(-RING, RING)
    inner = by.rangeBetween(-4 * NEAR, 4 * NEAR)
    all_ = Window.partitionBy("source", "unit")
    upto = by.rangeBetween(Window.unboundedPreceding, 0)
    upper = F.sum("n").over(upto) * 2 >= F.sum("n").over(all_)
    plain = F.sum("open").over(all_) * 2 > F.sum("n").over(all_)
    summed = histogram.select(upper.alias("upper"), plain.alias("plain"), "source", "unit", "length", F.sum("open").over(near).alias("o"), F.sum("n").over(near).alias("all"), F.sum("open").over(ring).alias("r"), F.sum("open").over(inner).alias("i"))
    expected = (F.col("r") - F.col("i")) * (2 * NEAR + 1) / (2.0 * (RING - 4 * NEAR))
    narrow = ~F.col("plain") | (F.col("o") >= NARROW * F.col("i"))
    return summed.where(F.col("upper") & narrow & (F.col("o") >= LEAST) & (F.col("o") >= SHARE * F.col("all")) & (F.col("o") >= EXCESS * expected)).select("source", "unit", "length")


def _words(sentence: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), r"[\d]", "0"), r"\s+", " ")), " ")


def endings(sentence: Column) -> Column:
    """Its last word and letters only: these look whole in captions as well."""
    return F.array(F.concat(F.lit("w:"), F.try_element_at(_words(sentence), F.lit(-1))), *(F.concat(F.lit(f"c{k}:"), F.substring(sentence, -k, k)) for k in range(1, 8)))


def features(sentence: Column, follows: Column) -> Column:
    """What the classifier sees of a last sentence without its final mark: its last words and letters, its first words, and whether it follows another: captions stand alone."""
    word = _words(sentence)
    back, n = F.reverse(word), F.size(word)
    at = lambda i: F.coalesce(F.try_element_at(back, F.lit(i)), F.lit("^"))
    few = F.least(n, F.lit(9)).cast("string")
    ahead = lambda i: F.coalesce(F.try_element_at(word, F.lit(i)), F.lit("$"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index(sentence, " ", -1), r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\d", "0")
    parts = [F.concat(F.lit(f"w{i}:"), at(i)) for i in range(1, 8)]
    parts += [F.concat_ws(" ", F.lit(f"g{k}"), *(at(i) for i in range(k, 0, -1))) for k in (2, 3, 4)]
    parts += [F.concat(F.lit(f"n{i}:"), few, at(i)) for i in range(1, 6)]
    parts += [F.concat(F.lit(f"c{k}:"), F.substring(sentence, -k, k)) for k in range(1, 8)]
    parts += [F.concat(F.lit(f"p{k}:"), few, F.substring(sentence, 1, k)) for k in (1, 3)] + [F.concat(F.lit("h:"), F.regexp_extract(shape, "(.{1,6})$", 1))]
    parts += [F.concat(F.lit("a1:"), ahead(1)), F.concat_ws(" ", F.lit("a2"), ahead(1), ahead(2)), F.concat(F.lit("s:"), shape), F.concat(F.lit("n:"), few)]
    parts += [F.concat_ws(" ", F.lit(f"x{i}"), few, ahead(1), at(i)) for i in (1, 3, 4, 5)]
    parts += [F.concat_ws(" ", F.lit("z"), few, ahead(1), shape), F.concat_ws(" ", F.lit("y"), few, shape)]
    parts += [F.when(F.rlike(sentence, F.lit(r"[(（][^)）(（]*$")), "open(").otherwise("-("), F.when(F.rlike(sentence, F.lit(r"[\"„“«「][^\"“”»」„«「]*$")), "open'").otherwise("-'")]
    place = F.when(follows, "f").otherwise("o")
    parts += [F.concat(F.lit("q:"), place, few), F.concat_ws(" ", F.lit("q1"), place, few, ahead(1)), F.concat_ws(" ", F.lit("q2"), place, few, shape)]
    bag = F.transform(word, lambda w: F.concat(F.lit("b:"), w))
    return F.concat(F.array(*parts), bag)


def _able(final: bool) -> Column:
    return (F.col("final") if final else ~F.col("final")) & (F.length("sentence") >= 3)


def per_source(rows: DataFrame) -> DataFrame:
    """(source, open, marked, unmarked): the share of rows without a final mark, and about how many texts that can be taught have one or not."""
    texts = {name: F.approx_count_distinct(F.when(_able(final), F.col("text_hash")), 0.02).alias(name) for name, final in (("marked", True), ("unmarked", False))}
    return stage(rows.groupBy("source").agg(F.avg((~F.col("final")).cast("int")).alias("open"), *texts.values()), "truncation-sources")


def _sample(rows: DataFrame, n: int, texts: int | None = None) -> DataFrame:
    """(source, follows, sentence, marker, text_hash) of about n texts, those of the smallest hashes; copies count once.

    Hashes spread evenly over their range, so a share of the range holds that share of the texts. `texts` tells how many
    there are, if that is known.
    """
    able = rows.where(F.length("sentence") >= 3)
    known = able.agg(F.approx_count_distinct("text_hash", 0.02)).first()[0] if texts is None else texts
    share = n / max(known, n)
    below = able.where(F.col("text_hash") <= F.lit(min(int(-(2.0**63) + share * 2.0**64), 2**63 - 1)))
    return below.groupBy("text_hash").agg(F.min(F.struct("source", "follows", "sentence", "marker")).alias("r")).select("r.*", "text_hash")


def _examples(rows: DataFrame, texts: int) -> DataFrame:
    """(sentence, follows, label, weight): 1 = cut. Last sentences of FIT_ROWS of the `texts` with a final mark, whole and cut."""
    s = _sample(rows.where("final"), FIT_ROWS, texts)
    n, h = F.length("sentence"), F.xxhash64("text_hash")
    cut_at = F.when(n >= 8, 2 + F.pmod(h, n - 3)).otherwise(1 + F.pmod(h, n - 2)).cast("int")
    early = F.when(F.pmod(h, F.lit(16)) == 0, 1 + F.pmod(F.xxhash64("sentence"), F.least(n - 2, F.lit(7)))).cast("int")  # short cuts are rare among the others
    whole = s.select("sentence", "follows", F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"))
    return whole.unionByName(s.select("sentence", "follows", F.explode(F.array_compact(F.array(cut_at, early))).alias("n")).select(F.substring("sentence", F.lit(1), F.col("n")).alias("sentence"), "follows", F.lit(1.0).alias("label"), F.lit(1.0).alias("weight")))


def _plain_examples(rows: DataFrame, plain_sources: DataFrame, texts: int, marked: DataFrame) -> DataFrame:
    """The same of PLAIN_ROWS of the `texts` without a final mark, as whole; from those of the sources that don't mostly break off.

    `marked` has the examples with final marks, whose ends tell.
    """
    s = stage(_sample(rows.where("not final").join(plain_sources, "source", "left_semi"), PLAIN_ROWS, texts), "truncation-plain")
    look = _fitted(marked, lambda r: endings(r["sentence"])) if not s.isEmpty() else None
    if look is None:
        return marked.limit(0)
    seen = stage(look(s).withColumn("cut", F.when(F.col("marker"), 1.0).otherwise(F.col("p"))), "truncation-looks")
    whole = seen.groupBy("source").agg(F.avg((F.col("cut") > LOOKS_CUT).cast("int")).alias("share")).where(F.col("share") <= PLAIN_CUT)
    return seen.where("not marker").join(whole, "source", "left_semi").select("sentence", "follows", F.lit(0.0).alias("label"), F.lit(PLAIN_WEIGHT).alias("weight"))


def _fitted(examples: DataFrame, seen: Callable[[DataFrame], Column]) -> Callable[[DataFrame], DataFrame] | None:
    """What adds to rows the probability p of a cut by what is `seen` of them; none if the examples have but one label."""
    fit_on = stage(examples.select("label", "weight", seen(examples).alias("features")), "truncation-fit")
    found = logistic.fitted(fit_on, FIT_FEATURES, FIT_PENALTY)
    if found is None:
        return None
    return lambda df: df.select(*df.columns, logistic.probability(seen(df), found, df.sparkSession.sparkContext).alias("p"))


def truncated(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, text_hash, why) of the cut rows; why: `limit`, `transfer` or `copy`.

    Null, empty and blank texts are never cut. A null source is a source of its own. An empty table gives no rows.
    """
    rows = judged(df, key, source, text)
    at = spikes(lengths(rows)).groupBy("source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("at_chars"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("at_bytes")
    )
    spiked = F.coalesce(F.array_contains("at_chars", F.col("chars")) | F.array_contains("at_bytes", F.col("bytes")), F.lit(False))
    open_rows = rows.where("not final").join(at, "source", "left").select("key", "source", "text_hash", "chars", "sentence", "follows", F.when(spiked, F.lit("limit")).alias("why"))
    held = stage(open_rows, "truncation-open")
    cut = held.where("why is not null").select("key", "source", "text_hash", "why")

    sources = per_source(rows)
    plain = sources.where("open > 0.5").join(at.select("source"), "source", "left_anti")
    texts = sources.join(plain.select("source", F.lit(1).alias("plain")), "source", "left").agg(F.sum("marked").alias("marked"), F.sum(F.when(F.col("plain") == 1, F.col("unmarked"))).alias("plain")).first()
    marked = stage(_examples(rows, texts.marked or 0), "truncation-marked")
    odds = _fitted(marked.unionByName(_plain_examples(rows, plain.select("source"), texts.plain or 0, marked)), lambda r: features(r["sentence"], r["follows"]))
    if odds is not None:
        rest = held.where(F.col("why").isNull() & F.rlike("sentence", F.lit(r"\p{L}")))  # numbers and signs alone end inside no word or sentence
        scored = stage(odds(rest).select("key", "source", "text_hash", "p"), "truncation-scored")
        often = scored.groupBy("source").agg(F.least(F.greatest(F.avg("p"), F.lit(0.02)), F.lit(0.98)).alias("often"))
        broken = scored.join(often, "source").where(F.col("p") * F.col("often") > (1 - F.col("p")) * (1 - F.col("often")))
        cut = cut.unionByName(broken.select("key", "source", "text_hash", F.lit("transfer").alias("why")))
    cut = stage(cut, "truncation-cut")
    copies = held.join(cut.select("text_hash").distinct(), "text_hash", "left_semi").join(cut, "key", "left_anti")
    return cut.unionByName(copies.select("key", "source", "text_hash", F.lit("copy").alias("why")))


def shares(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(source, n_rows, n_cut, share, by limit and by transfer): how often each source cuts off. A null source is reported as ''."""
    cut = truncated(df, key, source, text).groupBy("source").agg(F.count("*").alias("n_cut"), F.count_if(F.col("why") == "limit").alias("by_limit"), F.count_if(F.col("why") == "transfer").alias("by_transfer"))
    all_ = df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n_rows"))
    joined = all_.join(cut, "source", "left").na.fill(0, ["n_cut", "by_limit", "by_transfer"])
    return joined.select("source", "n_rows", "n_cut", (F.col("n_cut") / F.col("n_rows")).alias("share"), "by_limit", "by_transfer")
