"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, html, importance, jaccard, lm, media, quality, rules, shards, tokenfile, urls
from .common import table


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; the folder is a parameter (SIEVELINE_TOKENIZERS)."""
    if folder := os.environ.get("SIEVELINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), "n_chars")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_lm_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op7_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_trie": op1_bpe_trie,
    "op2_html_consensus": op2_html_consensus,
    "op3_url_filter": op3_url_filter,
    "op4_lm_interpolation": op4_lm_interpolation,
    "op5_media_tiles": op5_media_tiles,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_simhash_windows": op7_simhash_windows,
    "op8_token_planes": op8_token_planes,
    "op9_quality_ftrl": op9_quality_ftrl,
    "op10_jaccard_parity": op10_jaccard_parity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality_rules": op13_quality_rules,
}
