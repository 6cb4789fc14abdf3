"""Operator 13: quality rules with thresholds that each language and source sets for itself.

Built-in functions alone. Each document is measured once: words, characters in words, symbols,
repeated lines, and words in five-word windows that the text has more than once. Two base rules are
fixed: at least ten words, and at most a fifth of them in repeated windows. What passes is counted
into quantile sketches, one for each language, source and measure: a sketch is the count of values
in buckets of seven significant bits (a value is known to within 1/64), so that sketches merge by
adding counts, in any order, to the same result. Their quartiles give the thresholds: a document
fails where a measure lies beyond a quartile by more than ``reach`` times the distance between the
quartiles. Quartiles of a source are drawn to those of its language by the weight of ``prior``
documents, so that a source of a few documents is judged mostly as its language is, without a
switch at any size. The fewer words a text has, the more a share varies by chance: the allowed
distance grows with ``1 + sqrt(chance / words)``. The thresholds are joined to the documents, and
the verdict is a filter.

Windows are told apart by 64-bit hashes within one text.

Defined results: a null text has no words and fails the base rule, as do empty and blank ones; a null
lang or source counts as the empty one; rows are judged each, repeated ones alike, with or without
an id; ties lie within a threshold, never beyond it; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, only, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: measure -> (numerator, denominator, least distance between quartiles), all in thousandths; only the first has a lower threshold
SHARES = {"word_length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 50), "dup_lines": ("n_dup_lines", "n_lines", 100), "repeats": ("n_repeat_words", "n_words", 50)}
TWO_SIDED = ("word_length",)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` looks at it."""
    return F.transform(F.array(value), use)[0]


def covered(starts: Column) -> Column:
    """How many words lie in windows that begin at these ascending places."""
    gaps = F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - starts[i - 1])))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more in a list of words, the first occurrence included; null if there are none."""
    n = F.size(words)
    prints = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def places(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda r, j: (F.get(s, j - 1)["x"] == r["x"]) | (F.get(s, j + 1)["x"] == r["x"]))
        return bind(ranked, lambda s: F.sort_array(F.transform(twice(s), lambda r: r["i"])))

    counted = bind(prints, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bind(places(h), covered)))
    return F.when(n >= WINDOW, counted)


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.coalesce(repeated_words(w), F.lit(0)).cast("long").alias("n_repeat_words"))

    def by_line(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = bind(F.filter(F.split(text, SPACE), lambda x: x != ""), counts)
    return F.struct(words.alias("w"), bind(lines, by_line).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def measured(docs: DataFrame, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """doc_id, lang, source ("" for null), all counts and base_failed of each document."""
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = only(docs, "doc_id", "text", "lang", "source").select("doc_id", none("lang").alias("lang"), none("source").alias("source"), measures(F.col("text")).alias("m"))
    rows = rows.select("doc_id", "lang", "source", "m.w.*", "m.l.*", "m.n_symbols")
    return rows.withColumn("base_failed", base_failed(least_words, most_repeated))


def base_failed(least_words: int, most_repeated: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def share(measure: str) -> Column:
    """A measure in whole thousandths; 0 of nothing."""
    top, below, _ = SHARES[measure]
    return F.expr(f"1000 * {top} div greatest({below}, 1)")


def bucket(value: Column) -> Column:
    """The smallest value that shares the seven leading bits."""
    rest = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest)


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, measure, at, n: how many documents that pass the base rules have a value in each bucket."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(share(m)).alias("at")) for m in SHARES])
    rows = counted.where("NOT base_failed").select("lang", "source", F.explode(each).alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.at").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, total, low, high: the quartiles of merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "at").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("at"))).withColumn("total", F.sum("n").over(group))
    first = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("at")))
    return ranked.groupBy(*keys, "measure").agg(F.first("total").alias("total"), first(1).alias("low"), first(3).alias("high"))


def thresholds(counted: DataFrame, prior: int = 100) -> DataFrame:
    """lang, source and the quartiles of each measure, ``<measure>_low`` and ``<measure>_high``, a row for each source of a language."""
    sketch = stored(sketches(counted), "sketches")
    own = quartiles(sketch, "lang", "source")
    whole = quartiles(sketch, "lang").select("lang", "measure", F.col("low").alias("lang_low"), F.col("high").alias("lang_high"))
    drawn = lambda c: (F.col("total") * F.col(c) + prior * F.col(f"lang_{c}")) / (F.col("total") + F.lit(float(prior)))
    both = own.join(whole, ["lang", "measure"]).select("lang", "source", "measure", drawn("low").alias("low"), drawn("high").alias("high"))
    return both.groupBy("lang", "source").pivot("measure", list(SHARES)).agg(F.first("low").alias("low"), F.first("high").alias("high"))


def beyond(measure: str, reach: float, chance: float) -> Column:
    """Whether a measure lies beyond the thresholds; false where there are none."""
    low, high, value = F.col(f"{measure}_low"), F.col(f"{measure}_high"), share(measure)
    width = reach * F.greatest(high - low, F.lit(float(SHARES[measure][2]))) * (1 + F.sqrt(chance / F.col("n_words")))
    out = value > high + width
    return F.coalesce(out | (value < low - width) if measure in TWO_SIDED else out, F.lit(False))


def verdicts(counted: DataFrame, limits: DataFrame, reach: float = 3.0, chance: float = 100.0) -> DataFrame:
    """The counted documents with the thresholds of their source, the measures that fail, and ``kept``."""
    # stored, so that its size is known: broadcast below the session's threshold, else joined by sorting, where Spark splits a hot source
    limits = stored(limits, "thresholds").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    rows = counted.join(limits, (F.col("lang") == F.col("of_lang")) & (F.col("source") == F.col("of_source")), "left")
    failed = F.filter(F.array(*[F.when(beyond(m, reach, chance), F.lit(m)) for m in SHARES]), lambda m: m.isNotNull())
    return rows.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed)).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and which measures failed, of each document."""
    counted = stored(measured(docs), "measured")
    return verdicts(counted, thresholds(counted)).select("doc_id", "lang", "source", *COUNTS, "base_failed", "kept", "failed")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    limits = thresholds(stored(measured(docs), "measured"))
    whole, kept = fresh(docs, "whole"), docs.select(F.struct("*").alias("whole"))
    rows = kept.select(F.col("whole").alias(whole), *[F.col(f"whole.`{c}`").alias(c) for c in ("lang", "source", "text")])
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.select(whole, none("lang").alias("lang"), none("source").alias("source"), measures(F.col("text")).alias("m")).select(whole, "lang", "source", "m.w.*", "m.l.*", "m.n_symbols")
    return verdicts(rows.withColumn("base_failed", base_failed(10, 20)), limits).where("kept").select(f"{whole}.*")
