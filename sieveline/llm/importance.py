"""Operator 11: importance resampling towards a target distribution.

Features are runs of ``low`` to ``high`` words, hashed into buckets; the corpus and the target are
each a count by bucket. A bucket's gain, a log ratio of both in whole thousandths, goes into one
array; a document's weight is the floored mean of the gains of its features, taken from that array in
Arrow batches. A score adds Gumbel noise that hangs on the document's id alone, so that the
highest scores are a draw without replacement by weight, the same on every run.

The draw sorts nothing globally. Scores are integers, so their exact histogram is small: the sums of
its counts from the top say how many documents lie above each score, and so which score is the last
to be drawn from. Only what reaches that score is shuffled; ``row_number`` by id within a score,
added to what lies above, is the rank. Repeated rows are one row with a count until they are ranked.

Defined results: null, empty and word-free texts have no features, weight 0 and a score by their id;
a null id counts as the empty text in the noise and comes last among equal scores; rows of one id
and score are ordered by their numbers of features and weights, repeated rows get ranks of their own;
an empty table gives an empty result, an empty target is one without features; other columns are
ignored by ``resample`` and kept by ``draw``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import bounded_batches, fresh, only, stored

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on UTF-8 of which A-Z are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCORE = "n_words long, n_features long, weight long, score long"
#: A repeated row is unfolded by so many at a time, in as many tasks as that makes.
FOLD = 4096


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # bytes.lower() knows A-Z alone


def feature_buckets(words: list[bytes], low: int, high: int, buckets: int) -> np.ndarray:
    """The bucket of each run of ``low`` to ``high`` words."""
    runs = chain.from_iterable(words if n == 1 else (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) for n in range(low, high + 1))
    return np.fromiter(map(zlib.crc32, runs), np.uint32).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, column: str, low: int, high: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in a column of texts; at most ``buckets`` rows of a task and of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                at, n = np.unique(feature_buckets(words_of(text.as_py()), low, high, buckets), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = only(texts, column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in whole thousandths, with one count added to each."""
    buckets = len(corpus)
    whole, aim = int(corpus.sum()) + buckets, int(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * aim))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, salt: str) -> int:
    """Gumbel noise of an id in whole thousandths."""
    h = int(hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scorer(corpus: DataFrame, target: DataFrame, low: int, high: int, buckets: int, salt: str):
    """A function of a batch's ids and texts that gives their scores; the array of gains goes along with it."""
    gain = gains(bucket_counts(corpus, "text", low, high, buckets), bucket_counts(target, "text", low, high, buckets))

    def score(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            words = words_of(text.as_py())
            at = feature_buckets(words, low, high, buckets)
            weight = int(gain[at].sum()) // len(at) if len(at) else 0
            rows.append((len(words), len(at), weight, weight + noise(doc_id.as_py(), salt)))
        return [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), (), (), ()))]

    return score


def scored(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, salt: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document; stored."""
    bounded_batches(docs.sparkSession)
    score = scorer(docs, target, low, high, buckets, salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *score(b.column(0), b.column(1))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind: DataType = docs.schema["doc_id"].dataType
    return stored(only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, {SCORE}"), "scores", compression="zstd")


def histogram(candidates: DataFrame, block: int = 256) -> DataFrame:
    """score, n, above: how many candidates have a score and how many a higher one.

    Scores are summed from the top within blocks of neighbouring scores, and the blocks by their totals.
    """
    counts = candidates.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"floor(score / {block})"))
    counts = stored(counts, "histogram")
    before = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("total")).select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("over"))
    inside = Window.partitionBy("block").orderBy(F.desc("score"))
    upto = counts.withColumn("upto", F.sum("n").over(inside))
    return stored(upto.join(blocks, "block").select("score", "n", (F.col("over") + F.col("upto") - F.col("n")).alias("above")), "offsets")


def cutoff(offsets: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many are drawn, and the lowest score that is drawn from: None if none is."""
    drawn = (offsets.agg(F.sum("n")).first()[0] or 0) * percent // 100
    last = offsets.where((F.col("above") < drawn) & (F.col("above") + F.col("n") >= drawn)).first()
    return drawn, last["score"] if last else None


def unfolded(rows: DataFrame, copies: str, first: str) -> DataFrame:
    """A row with the next ``first`` for each of the ``copies`` of a row; many copies are dealt over tasks."""
    each = lambda begin, n: F.explode(F.sequence(begin, begin + n - 1))
    kept = [c for c in rows.columns if c not in (copies, first)]
    few = rows.where(F.col(copies) <= FOLD).select(*kept, each(F.col(first), F.col(copies)).alias(first))
    many = rows.where(F.col(copies) > FOLD).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {FOLD}"))).alias("fold")).repartition(F.col("fold"), F.col(first))
    begin = F.col(first) + F.col("fold") * FOLD
    many = many.select(*kept, each(begin, F.least(F.lit(FOLD).cast("long"), F.col(copies) - F.col("fold") * FOLD)).alias(first))
    return few.union(many)


def ranked(scores: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """The scores with ``rank``, 1 for the best of those drawn and null for all others."""
    able = F.col("n_words") >= min_words
    offsets = histogram(scores.where(able))
    drawn, lowest = cutoff(offsets, percent)
    if lowest is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    rows = ["doc_id", "n_words", "n_features", "weight", "score"]
    reached = able & (F.col("score") >= lowest)
    alike = scores.where(reached).groupBy(*rows).agg(F.count("*").alias("copies"))  # repeated rows are one until here
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = alike.withColumn("place", F.sum("copies").over(order) - F.col("copies"))  # row_number() less one, copies counted
    placed = placed.join(offsets.where(F.col("score") >= lowest).select("score", "above"), "score")
    best = unfolded(placed.select(*rows, "copies", (F.col("above") + F.col("place") + 1).alias("rank")), "copies", "rank")
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(scores.where(~reached).select(*rows, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, **features: int | str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document, null where it is not drawn."""
    return ranked(scored(docs, target, **features), percent, min_words)


def draw(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, low: int = 1, high: int = 1, buckets: int = 10_000, salt: str = "2024") -> DataFrame:
    """The drawn documents with all their columns, found by their scores alone: no text is shuffled.

    Of rows that share id, numbers and score with the last document drawn, as many stay as are drawn.
    """
    scores = scored(docs, target, low, high, buckets, salt)
    best = ranked(scores, percent, min_words).where("rank IS NOT NULL")
    last = best.orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    score = scorer(docs, target, low, high, buckets, salt)

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SCORE.split(', '))}>")
    def of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(score(ids, texts), names=["n_words", "n_features", "weight", "score"])

    at = fresh(docs, "drawn_by")
    rows = docs.withColumn(at, of(F.col("doc_id"), F.col("text"))).where(F.col(at)["n_words"] >= min_words)
    order: list[Column] = [-F.col(at)["score"], F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType)), F.col(at)["n_features"], F.col(at)["n_words"], F.col(at)["weight"]]
    names = [f"k{i}" for i in range(len(order))]
    key = F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)])
    place = [-last["score"], last["doc_id"] is None, 0 if last["doc_id"] is None else last["doc_id"], last["n_features"], last["n_words"], last["weight"]]
    end = F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(place, names, ["long", "boolean", docs.schema["doc_id"].dataType, "long", "long", "long"], strict=True)])
    alike = best.where((F.col("score") == last["score"]) & F.col("doc_id").eqNullSafe(last["doc_id"]) & (F.col("n_features") == last["n_features"]) & (F.col("n_words") == last["n_words"]) & (F.col("weight") == last["weight"])).count()
    return rows.where(key < end).drop(at).union(rows.where(key == end).drop(at).limit(alike))
