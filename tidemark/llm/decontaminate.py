"""Benchmark passages in documents by a prefix-filtered join, in DataFrame functions only (operator 3).

Words are runs of ASCII letters, digits and all other non-ASCII characters, A-Z lower-cased. A window is 10 consecutive words
of an item; an item of fewer words is one window. Exact containment of a window needs all its words, so its prefix is its one
rarest word by the counts over all documents. Words of documents are joined with these prefix words; position and length
bounds discard windows that would leave the document; the rest is verified word for word.

Null text has no words and no hit; an item without words has no window. A null item_id is left out of the list but counted
once. Repeated rows of documents give repeated results. No item or no document: no hit or no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER
from tidemark.llm.storage import checkpointed

BROADCAST_BYTES = 32 << 20
WINDOW, EACH = 10, "\x00"
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """Lower-cased words in order: one translation of every character and a cut at single spaces, with no pattern matcher."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (array of words), items (ids that hold it): distinct windows of all items."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, window).alias("win"))
    return each.groupBy("win").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(EACH))).alias("items"))


def small(df: DataFrame) -> DataFrame:
    """`df` computed once; with a broadcast hint only if its measured size is below the bound, else Spark shuffles both sides."""
    df = checkpointed(df)
    bytes_of = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16 for c in df.columns]
    size = df.agg(F.sum(sum(bytes_of[1:], bytes_of[0]))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def prefixes(wins: DataFrame, texts: DataFrame) -> DataFrame:
    """wins with token, its rarest word by the counts over all documents, and offset, where that word stands."""
    vocabulary = small(wins.select(F.explode("win").alias("word")).distinct())
    counts = texts.select(F.explode(words(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    ranked = (wins.select("win", F.posexplode("win").alias("offset", "word")).join(counts, "word", "left")
              .groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("first")))
    return ranked.join(wins, "win").select(F.col("first.word").alias("token"), F.col("first.offset").alias("offset"), "win", "items")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated of every row."""
    return judged(docs, items, window).drop("h")


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of scan() and h, the hash of the row's text."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    nothing = texts.sparkSession.range(1).select(F.lit(EACH).alias("token"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"))
    keyed = small(prefixes(windows(items, window), texts).unionByName(nothing))
    # one more token per document joins with a row of its own, so documents without a candidate stay in the same pass
    each = (texts.select("doc_id", "h", words(F.col("text")).alias("w"))
            .select("doc_id", "h", F.size("w").alias("n"), F.posexplode(F.array_append("w", F.lit(EACH))).alias("pos", "token")))
    start = F.col("pos") - F.col("offset")
    fits = F.col("win").isNull() | ((start >= 0) & (start + F.size("win") <= F.col("n")))
    found = (each.join(keyed, "token").where(fits).groupBy(F.col("doc_id").alias("k"), F.col("h").alias("kh"))
             .agg(F.max("n").alias("n"), F.collect_set(F.when(F.col("win").isNotNull(), F.struct(start.alias("a"), "win", "items"))).alias("candidates")))
    # the words are needed again only where there is a candidate
    w = F.when(F.size("candidates") > 0, words(F.col("text")))
    matching = lambda w: F.filter("candidates", lambda c: F.slice(w, c["a"] + 1, F.size(c["win"])) == c["win"])
    both = (texts.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & F.col("h").eqNullSafe(F.col("kh")))
            .select("doc_id", "h", "text", F.col("n").cast("long").alias("n_words"), F.sort_array("candidates").alias("candidates")))
    # bound as an element, the words are cut once per document and not once per candidate
    spans = F.transform(F.array(w), matching)[0]
    hits = both.select("doc_id", "h", "n_words", spans.alias("spans")).select("doc_id", "h", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("spans.items"))).alias("found"))
    # spans are sorted by start: each adds what reaches beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["a"] + F.size(x["win"]) - F.greatest(s["end"], x["a"]))).alias("n"), F.greatest(s["end"], x["a"] + F.size(x["win"])).alias("end")), lambda s: s["n"])
    return (hits.select("doc_id", "h", "n_words", covered.cast("long").alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.array_remove("found", EACH).alias("item_ids"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a benchmark window; rows of one id, or of none, are told apart by their texts."""
    bad = judged(docs, items, window).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("h").alias("_bad_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64(F.col("text")) == F.col("_bad_text")), "left_anti")
