"""A corpus pipeline: good documents, one of each group of near duplicates, none with benchmark passages, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read back as the next stage's documents. All but the last return the columns of documents.

Defined results: extra columns, whatever their names, are kept by all stages but the last; an
empty table gives an empty result. The classifier judges null and empty texts by its bias alone
and repeated rows each. Of rows near each other, or repeated, one stays: that of the smallest id;
rows without an id are known by their texts and come after all others; null, empty and word-free
texts are near nothing, though repeated rows of them become one. Such texts hold no benchmark
passage. The encoding of a null text is that of an empty one. Very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bpe, decontaminate, jaccard, quality
from sieveline.llm.common import stored, table
from sieveline.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by shingles of five words and a similarity of 0.8."""
    return jaccard.keep_first(docs, words=5, num=8, den=10)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_matches(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each document."""
    return bpe.encode_with_digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: The classifier's training is iterative: no SQL. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
