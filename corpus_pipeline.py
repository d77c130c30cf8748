"""Corpus pipeline: raw documents to token ids, in five stages that each read what the one before kept.

Documents need doc_id, text and lang; all other columns pass through, whatever their names. Rows with a null doc_id or text,
repeated rows and empty tables are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, crf, decontaminate, simhash, substrings
from tidemark.llm.catalog import vocabulary_path
from tidemark.llm.common import CACHE_WORDS, table
from tidemark.llm.storage import shared_folder

SURE = 0.5  # mean probability of the document's language below which language ID rejects it


OWN = ("doc_id", "text", "lang")  # columns that stages read; all others travel in one struct, so no name can clash


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and `more`, the other columns of `docs`."""
    others = [c for c in docs.columns if c not in OWN]
    return docs.select(*OWN, F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("more"))


def unpacked(rows: DataFrame, docs: DataFrame, own: str = "", more: str = "more", **changed) -> DataFrame:
    """The columns of `docs` again, taken from packed rows; `changed` replaces some of them."""
    others = {c: f"{more}.c{i}" for i, c in enumerate(c for c in docs.columns if c not in OWN)}
    return rows.select(*[changed.get(c, F.col(others.get(c, f"{own}{c}"))).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or without one clear language go."""
    rows = packed(docs)
    said = crf.predict(rows, crf.fit(rows))
    return unpacked(said.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= SURE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group."""
    return unpacked(simhash.keep_first(packed(docs)), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; a document of which nothing is left goes."""
    left = substrings.remove_repeats(packed(docs)).where("n_removed < n_words or n_removed = 0")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        at = [c for c in docs.columns if c not in OWN].index("n_chars")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(f"rest.more.c{at}"))
    return unpacked(left, docs, own="rest.", more="rest.more", **changed)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return unpacked(decontaminate.clean(packed(docs), table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token ids."""
    return bpe.encode(docs, vocabulary_path(), held=CACHE_WORDS)  # its workers' memory has grown with the stages before


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontaminated), ("bpe", tokens)]

ORACLE_SQL = None  # a trained model, XXH64 votes and merges are not SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read back."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
