"""String functions: similarity, names, paths, hashes, and small parsers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Substrings that mark a variant of a family.
VARIANT_WORDS = ("bold", "italic", "light", "medium", "thin", "black", "heavy", "semibold", "extrabold", "extralight", "ultralight", "ultrabold", "demibold", "condensed", "expanded", "narrow", "wide", "oblique", "slant", "regular")
#: Characters that recognisers take for each other.
CONFUSIONS = {
    "O": "0QD", "0": "OQD", "I": "1l|", "1": "Il|", "l": "1I|", "S": "5$", "5": "S", "Z": "2", "2": "Z", "B": "8", "8": "B", "G": "6", "6": "Gb", "g": "9q", "9": "gq", "q": "9g", "b": "6d", "d": "b", "p": "P", "P": "p", "n": "h", "h": "n", "u": "vU", "v": "uV", "m": "nM", "w": "W", "c": "C(", "C": "c(",
}
#: Letters that look alike in both cases.
CASE_SYMMETRIC = tuple("cvwxoszui")


def strip(c: Column) -> Column:
    """Trim all white space, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def plain_ascii(c: Column) -> Column:
    return F.regexp_replace(c, "[^ -~]", "")


def edit_confidence(expected: Column, actual: Column, errors: bool = False) -> Column:
    """1 - edit distance / longer length, of trimmed lower-case texts; 0 for an empty reading, or one that reports an error."""
    e, a = F.lower(strip(expected)), F.lower(strip(actual))
    longest = F.greatest(F.length(e), F.length(a))
    out = F.when(F.length(a) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(e, a) / longest))
    return F.when(actual.startswith("ERROR"), 0.0).otherwise(out) if errors else out


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; another measure than :func:`edit_confidence`."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def accepted(expected: Column, actual: Column, confidence: Column, least: float = 0.5) -> Column:
    """The same letter in either case, or a known confusion that was read with confidence."""
    similar = F.create_map(*[F.lit(x) for k, v in CONFUSIONS.items() for x in (k, v)])
    return (F.lower(expected) == F.lower(actual)) | (F.coalesce(F.contains(F.try_element_at(similar, expected), actual), F.lit(False)) & (confidence >= least))


def rejection(expected: Column, actual: Column, confidence: Column, least: float = 0.5) -> Column:
    """Why a reading is not accepted: a confusion read without confidence, or another letter; null if it is accepted."""
    return F.when(accepted(expected, actual, confidence, least), F.lit(None)).when(accepted(expected, actual, F.lit(1.0), least), "unsure").otherwise("different")


def any_keyword(c: Column, words: Sequence[str] = VARIANT_WORDS) -> Column:
    """Whether the lower-cased text has any of the words as a substring."""
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def detect_source(path: Column, sources: Sequence[str]) -> Column:
    """The source whose name is a folder of the path."""
    out = F.lit("unknown")
    for s in reversed(list(sources)):
        out = F.when(F.lower(path).contains(f"/{s}/"), s).otherwise(out)
    return out


def safe_file_name(c: Column, default: str = "unnamed") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), F.lit(". ")), F.lit("")), F.lit(default))


def resolve(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def quote(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and _.-~"""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unescape(c: Column) -> Column:
    """The five predefined entities; the ampersand last, so nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def content_key(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, length)


def hash_halves(hex64: Column) -> tuple[Column, Column]:
    """A hash of 16 hex digits as two numbers; all 16 digits would overflow."""
    return F.conv(F.substring(hex64, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hex64, 9, 8), 16, 10).cast("long")


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def event_frame(*cols: str | Column) -> Column:
    """A server-sent event holding the columns as JSON."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*cols)), F.lit("\n\n"))


def details(fields: Column, dropped: Sequence[str]) -> Column:
    """A map as JSON, without the dropped keys."""
    return F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(list(dropped))))


def result_block(output: Column, schema: str) -> Column:
    """The JSON between the result markers of a worker's output."""
    return F.from_json(F.regexp_extract(output, r"(?s)RESULTS_START\n(.*)\nRESULTS_END", 1), schema)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there, also within functions of an array's items."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(values: Column) -> Column:
    """The exponentials of an array over their sum; the largest value and the sum are computed once a row, not once an item."""
    powers = once(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    share = lambda e: once(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda v: v / total))
    return once(powers, share)


def top_classes(probabilities: Column, labels: Column, k: int = 3) -> Column:
    """The k likeliest (p, label), ties by label."""
    pairs = F.arrays_zip(probabilities.alias("p"), labels.alias("label"))
    return F.slice(F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["label"] < b["label"], -1).otherwise(1)), 1, k)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def case_probability(probabilities: Column, letter: Column) -> Column:
    """The largest probability (map by character) of a letter as it is, in upper and in lower case; 0 for unknown ones."""
    at = lambda k: F.coalesce(F.try_element_at(probabilities, k), F.lit(0.0))
    return F.greatest(at(letter), at(F.upper(letter)), at(F.lower(letter)))


def get_or(value: Column, default: str, *keys: str) -> Column:
    """The value below nested keys of maps, or the default where one is missing or null."""
    for k in keys:
        value = F.try_element_at(value, F.lit(k))
    return F.coalesce(value, F.lit(default))
