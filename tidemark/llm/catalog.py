"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audit, bpe, crf, decontaminate, hilbert, licences, minhash, perspectives, simhash, substrings, trie, urls, wordpiece
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    said = crf.predict(docs.select("doc_id", "text"), crf.fit(docs))
    return said.select("doc_id", (crf.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "switches")


def op2_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives.rotate(table(spark, folder, "conversations"))


def op3_prefix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op5_ball_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("rest.doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.with_search(table(spark, folder, "documents"), F.col("doc_id") % 50 == 0)


def op8_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op9_wordpiece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, folder, "documents"), vocabulary_path())


def op10_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), vocabulary_path(), with_ids=False)


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


def op13_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.shard(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_crf_language, op2_perspectives, op3_prefix_decontamination, op4_licence_scan, op5_ball_simhash, op6_substring_dedup,
    op7_minhash, op8_url_templates, op9_wordpiece_counts, op10_tree_bpe, op11_filter_audit, op12_prefix_trie, op13_hilbert_shards)}
