"""Operator 9: quality classifier, a logistic regression on hashed word n-grams trained by
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

Tokens of a text: runs of letters (lower-cased, plus their case pattern), of digits, and of
other visible characters. Features: hashed 1-grams and 2-grams, all 2-grams of one white-space
part said twice sharing a bucket; the value of a feature is its share of the text's n-grams. Nothing but the text is an input.

The model is fitted on at most ``max_rows`` labelled documents (those of lowest hashed id);
one task streams them through the sequential updates and returns ``2**bits`` weights, 1 MB by
default, which are broadcast to the scoring tasks.

Defined results: null, empty and blank texts have no n-grams and get the score of the bias; a
label without a document, a null label or id is not learned from; repeated labels are learned
from each, of rows of one id that of the smallest text hash; repeated rows are scored each; without any label the score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held, id_crc, only, release, uncollected

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
SCALE = 32.0


class Hasher:
    """Hashed n-grams of texts. The hashes of the recurring white-space parts are kept."""

    def __init__(self, bits: int, kept: int = 100_000):
        self.shift, self.kept = np.uint64(64 - bits), kept
        self.parts: dict[str, tuple[bytes, bytes]] = {}
        self.same = np.array([xxhash.xxh64_intdigest("=")], dtype=np.uint64)

    def _part(self, part: str) -> tuple[bytes, bytes]:
        out = []
        for t in TOKEN.findall(part):
            if t[0].isalpha():
                out.append("^" + ("X" if t.isupper() and len(t) > 1 else "Xx" if t[0].isupper() else "x"))
                out.append(t.lower())
            else:
                out.append("0" if t[0].isdigit() else t[:8])
        hashes = b"".join(xxhash.xxh64_intdigest(t).to_bytes(8, "little") for t in out)
        if len(part) <= 64:
            self.parts[part] = hashes, hashes[-8:]
        return hashes, hashes[-8:] if len(part) <= 64 else xxhash.xxh64_digest(part)

    def features(self, text: str | None) -> np.ndarray:
        """Bucket of each 1-gram and 2-gram, with repetition."""
        if len(self.parts) > self.kept:
            self.parts.clear()
        get, learn = self.parts.get, self._part
        got = [h if (h := get(p)) is not None else learn(p) for p in (text or "").split()]
        h = np.frombuffer(b"".join([g[0] for g in got]), dtype=np.uint64)
        ends = np.frombuffer(b"".join([g[1] for g in got]), dtype=np.uint64)
        pairs = h[:-1] * ODD2 ^ h[1:] >> np.uint64(7) ^ h[1:]
        same = np.repeat(self.same, int((ends[1:] == ends[:-1]).sum()))
        return (np.concatenate([h, pairs, same]) * ODD >> self.shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression over ``2**bits`` weights and a bias."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, buckets: np.ndarray, label: int) -> None:
        at, count = np.unique(buckets, return_counts=True)
        at, x = np.append(at, len(self.z) - 1), np.append(count * (SCALE / max(1, len(buckets))), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def margin(weights: np.ndarray, buckets: np.ndarray) -> float:
    return float(weights[-1] + (SCALE * weights[buckets].mean() if len(buckets) else 0.0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, epochs: int = 3, bits: int = 18) -> np.ndarray:
    """Weights learned from at most ``max_rows`` rows of ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    order = F.xxhash64(F.col("doc_id"), F.lit(9))
    few = only(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).orderBy(order, "doc_id", "quality").limit(max_rows)
    few = few.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    rows = only(docs, "doc_id", "text").join(F.broadcast(few.groupBy("_id").agg(F.collect_list("_label").alias("_labels"))), F.col("doc_id") == F.col("_id"))  # at most max_rows small rows
    # one text for each id, so that no more than max_rows rows go to the task that learns
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("_labels").alias("_labels")).select("doc_id", "text", F.explode("_labels").alias("_label"))
    rows = rows.select("text", "_label", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("_epoch"), F.xxhash64("doc_id", F.lit(9)).alias("_order"), "doc_id")
    rows = rows.repartition(1).sortWithinPartitions("_epoch", "_order", "doc_id", "_label", "text").select("text", "_label")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        hasher, model = Hasher(bits), Ftrl(bits)
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                model.update(hasher.features(text), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["w"])
        del hasher, model
        release()

    got = rows.mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(got[0]["w"]), dtype=np.float32) if got else np.zeros((1 << bits) + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and ``score`` (0 to 1) of each row."""
    spark = docs.sparkSession
    bits, sent = int(np.log2(len(weights) - 1)), spark.sparkContext.broadcast(weights.astype(np.float32).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        hasher, w = Hasher(bits), np.frombuffer(sent.value, dtype=np.float32).astype(np.float64)
        for b in batches:
            with uncollected():
                m = np.array([margin(w, hasher.features(t)) for t in b.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))), pa.float64())], names=["doc_id", "score"])
        release()

    bounded_batches(spark)
    return only(docs, "doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose crc32 mod ``folds`` is ``held_out`` are not learned from."""
    weights = fit(docs, labels.where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held_out))
    fold = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == held_out, F.lit(False))
    return score(docs, weights).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold: judged in one pass, without a join."""
    spark, names = docs.sparkSession, docs.columns
    weights = fit(docs, labels.where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held_out))
    bits, sent, at = int(np.log2(len(weights) - 1)), spark.sparkContext.broadcast(weights.tobytes()), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        hasher, w = Hasher(bits), np.frombuffer(sent.value, dtype=np.float32).astype(np.float64)
        for b in batches:
            with uncollected():
                m = np.array([margin(w, hasher.features(t)) for t in b.column(at).to_pylist()], dtype=np.float64)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))) >= threshold))
        release()

    bounded_batches(spark)
    return docs.mapInArrow(run, docs.schema)
