"""MinHash fingerprints of documents and of their edited texts; band search with verified Jaccard (operator 7).

Signature: the minimum of each of 64 universal hash permutations x -> a x + b over the hashes of all five-word shingles,
computed in numpy; 16 bits of each minimum are kept. Likeness of two signatures: share of equal lanes. A text of fewer
than five words is one shingle; a text without words has the empty signature, which equals only itself.

Search: equal texts form one class, named by 120 bits of its SHA-256. Each class sends 16 band keys; classes that share one
with a class that is asked for are candidates, and the exact Jaccard of their shingle sets decides. A pair of texts at 0.8
shares a band with probability 0.9998. Only texts of candidates move, and copies are counted, never paired. Asked classes are
gathered in blocks; a class meets a block, not each asked class in it, and the task that holds both compares and counts.

Null text counts as empty. A null doc_id orders after all others. Rows that share a doc_id follow each other, ordered by
a hash of their text. The only row of a table is its own next document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import mix, shingle_hashes, word_hasher, word_hashes
from tidemark.llm.storage import stored

LANES, WORDS, BANDS, LIKE = 64, 5, 16, 0.8
ROWS_PER_BUCKET, MAX_BUCKETS = 4_000, 20_000  # buckets are streamed, so larger ones need no more memory
CHUNK, SLICE_ROWS = 2_048, 1_000
ASKED_PER_BLOCK, BLOCK_CHARS, ROWS_PER_PART = 128, 1 << 20, 512  # results do not depend on them
BROADCAST_BYTES = 64 << 20
NEAR = ("near_texts", "near_docs", "near_first")
_R = np.random.default_rng(7)
MUL = _R.integers(1, 2 ** 63, LANES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
ADD = _R.integers(1, 2 ** 63, LANES, dtype=np.uint64)[:, None]


def signature(text: str | None, hasher) -> np.ndarray:
    """64 lanes of 16 bits."""
    s = shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), hasher), WORDS)
    low = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), CHUNK):
        np.minimum(low, (MUL * s[None, i:i + CHUNK] + ADD).min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / LANES


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) of every row."""
    src = docs.select("doc_id", "text")
    schema = StructType([src.schema["doc_id"]]).add("fingerprint", "string")

    def run(batches):
        hasher = word_hasher()
        for b in batches:
            out = [signature(t, hasher).tobytes().hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def text_key(text: str) -> tuple[int, int]:
    """Two runs of 15 hex digits of the SHA-256; `_keys` gives the same."""
    h = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:15], 16), int(h[15:30], 16)


def _keys(text: Column) -> list[Column]:
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "k1"), (16, "k2"))]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, text of every row; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(text), text.alias("text"))


def classes(docs: DataFrame, asked: Column) -> DataFrame:
    """k1, k2, fingerprint, n (rows that hold the text), first_id (smallest doc_id), asked, size (characters): one row per
    different text, stored."""
    text = F.coalesce("text", F.lit(""))
    src = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(asked, F.lit(False)).alias("asked"), *_keys(text), F.char_length(text).cast("long").alias("size"))

    def run(batches):
        hasher = word_hasher()
        for b in batches:
            for i in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(i, SLICE_ROWS)
                prints = [signature(t, hasher).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(prints, pa.binary())], names=["doc_id", "asked", "k1", "k2", "size", "fingerprint"])

    d = src.mapInArrow(run, "doc_id long, asked boolean, k1 long, k2 long, size long, fingerprint binary")
    return stored(d.groupBy("k1", "k2", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("asked").alias("asked"), F.max("size").alias("size")), "classes")


def _sized(d: DataFrame) -> DataFrame:
    """A stored table, broadcast where its counted rows of at most 64 bytes stay within the bound."""
    return F.broadcast(d) if d.count() * 64 <= BROADCAST_BYTES else d


def _bands(cls: DataFrame, *cols: str) -> DataFrame:
    """The chosen columns of each class, once per band key."""
    width = LANES * 2 // BANDS
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("fingerprint", i * width + 1, width)) for i in range(BANDS)))
    return cls.select(*cols, F.explode(keys).alias("band"))


def blocks(cls: DataFrame) -> DataFrame:
    """k1, k2, block: every asked class in one block, with others that hold its most frequent band among asked classes. Stored."""
    bands = _bands(cls.where("asked"), "k1", "k2", "size")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
    home = bands.join(sizes, "band").groupBy("k1", "k2").agg(F.max(F.struct("_n", "band", "_size")).alias("_h"))
    cuts = F.greatest(F.ceil(F.col("_h._n") / ASKED_PER_BLOCK), F.ceil(F.col("_h._size") / BLOCK_CHARS), F.lit(1))
    return stored(home.select("k1", "k2", F.xxhash64("_h.band", F.pmod("k1", cuts)).alias("block")), "blocks")


def _met(cls: DataFrame, own: DataFrame) -> DataFrame:
    """block, part, is_asked, k1, k2: the classes that share a band with an asked class of a block, cut into parts, and in each
    part the asked classes of the block; `own`: see blocks. Stored."""
    asked = _bands(cls.where("asked"), "k1", "k2").join(own, ["k1", "k2"]).groupBy("band", "block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("k1").alias("_k1"), F.min("k2").alias("_k2"))
    met = _bands(cls, "k1", "k2").join(asked, "band").where("_n > 1 or k1 <> _k1 or k2 <> _k2")  # not a class with itself alone
    met = stored(met.select("k1", "k2", "block").distinct(), "met")
    parts = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_PART).alias("_parts"))
    rows = met.join(parts, "block").select("block", F.pmod("k2", "_parts").alias("part"), F.lit(False).alias("is_asked"), "k1", "k2")
    asked = own.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), F.lit(True).alias("is_asked"), "k1", "k2")
    return stored(rows.unionByName(asked), "rows")


def _compared(docs: DataFrame, cls: DataFrame, like: float, counted: bool) -> DataFrame:
    """See `alike`; if `counted`, q1, q2, texts, docs, first: sums over the classes that are alike, one row per asked class and part."""
    rows = _met(cls, blocks(cls))
    needed = stored(rows.select("k1", "k2").distinct().join(cls.select("k1", "k2", "fingerprint", "n", "first_id"), ["k1", "k2"]), "needed")
    found = keyed(docs).join(_sized(needed.select("k1", "k2", "first_id")), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = stored(found.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(needed, ["k1", "k2"]), "texts")  # repeated rows
    cols = ["block", "part", "is_asked", "k1", "k2", "n", "first_id", "fingerprint", "text"]
    dealt = rows.join(texts, ["k1", "k2"]).select(*cols).repartition("block", "part").sortWithinPartitions("block", "part", F.desc("is_asked"))
    schema = "q1 long, q2 long, texts long, docs long, first long" if counted else "q1 long, q2 long, k1 long, k2 long, jaccard double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        hasher, at, asked, group, out = word_hasher(), None, [], None, []

        def shingles(text):
            return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower().split(), hasher), WORDS))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if x == "jaccard" else pa.int64()) for c, x in zip(zip(*out), names)], names=names)
            out.clear()
            return made

        for b in batches:
            for block, part, is_asked, k1, k2, n, first, print_, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in cols)):
                if (block, part) != at:
                    if counted and group:
                        out += group.sums()
                    at, asked, group = (block, part), [], None
                lanes = np.frombuffer(print_, np.uint64).reshape(BANDS, -1)
                if is_asked:
                    asked.append((k1, k2, lanes, shingles(text)))
                    continue
                group = group or _Asked(asked)
                if not (which := group.meeting(k1, k2, lanes)).any():
                    continue
                share = group.jaccard(shingles(text))
                near = np.flatnonzero(which & (share >= like))
                if counted:
                    group.add(near, n, first)
                else:
                    out += [(asked[i][0], asked[i][1], k1, k2, float(share[i])) for i in near]
                if len(out) >= SLICE_ROWS:
                    yield batch()
        if counted and group:
            out += group.sums()
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)


class _Asked:
    """The asked classes of a block, compared with one other class at a time; `asked`: (k1, k2, bands, sorted shingle hashes)."""

    def __init__(self, asked: list[tuple]):
        self.k1, self.k2 = (np.array([a[i] for a in asked], np.int64) for i in (0, 1))
        self.lanes = np.stack([a[2] for a in asked])
        self.sizes = np.array([len(a[3]) for a in asked], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.concatenate([a[3] for a in asked])
        self.texts, self.docs, self.first = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), [None] * len(asked)

    def meeting(self, k1: int, k2: int, lanes: np.ndarray) -> np.ndarray:
        """Which of them share a band with a class and are not that class."""
        return (self.lanes == lanes).all(axis=2).any(axis=1) & ((self.k1 != k1) | (self.k2 != k2))

    def jaccard(self, s: np.ndarray) -> np.ndarray:
        if len(s) == 0:
            return (self.sizes == 0).astype(np.float64)
        at = np.searchsorted(s, self.hashes)
        hit = s[np.minimum(at, len(s) - 1)] == self.hashes
        both = np.diff(np.concatenate([[0], np.cumsum(hit)])[self.ends])
        return both / (self.sizes + len(s) - both)

    def add(self, near: np.ndarray, n: int, first: int | None) -> None:
        self.texts[near] += 1
        self.docs[near] += n
        if first is not None:
            for i in near:
                self.first[i] = first if self.first[i] is None else min(first, self.first[i])

    def sums(self) -> list[tuple]:
        return [x for x in zip(self.k1.tolist(), self.k2.tolist(), self.texts.tolist(), self.docs.tolist(), self.first) if x[2]]


def alike(docs: DataFrame, cls: DataFrame, like: float = LIKE) -> DataFrame:
    """q1, q2, k1, k2, jaccard: asked classes and the other classes that are alike; `cls`: see classes, `docs`: the rows it was made of."""
    return _compared(docs, cls, like, False)


def search(docs: DataFrame, queries: DataFrame, like: float = LIKE) -> DataFrame:
    """query_id, doc_id, jaccard: documents whose shingle set is like a query's. Each row counts for itself; rows with a null
    text or id find nothing."""
    valid = "doc_id is not null and text is not null"
    d, q = docs.where(valid).select("doc_id", "text"), queries.where(valid).select("doc_id", "text")
    both = d.withColumn("_ask", F.lit(False)).unionByName(q.withColumn("_ask", F.lit(True)))
    links = alike(both, classes(both, F.col("_ask")), like)
    mine = keyed(q).select(F.col("doc_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    same = mine.select("q1", "q2").distinct().select("q1", "q2", F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.lit(1.0).alias("jaccard"))
    return mine.join(links.unionByName(same), ["q1", "q2"]).join(keyed(d).drop("text"), ["k1", "k2"]).select("query_id", "doc_id", "jaccard")


def near_counts(docs: DataFrame, asked: Column, like: float = LIKE) -> DataFrame:
    """k1, k2, near_texts, near_docs, near_first of every asked text: other texts that are alike, other rows that hold them or
    the text itself, and the smallest doc_id among all of these and its own. Stored."""
    cls = classes(docs, asked)
    links = _compared(docs, cls, like, True).groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.sum("texts").alias("_texts"), F.sum("docs").alias("_docs"), F.min("first").alias("_first"))
    d = cls.where("asked").select("k1", "k2", "n", "first_id").join(links, ["k1", "k2"], "left")
    return stored(d.select("k1", "k2", F.coalesce("_texts", F.lit(0)).alias("near_texts"), (F.coalesce("_docs", F.lit(0)) + F.col("n") - 1).alias("near_docs"),
                           F.least("first_id", "_first").alias("near_first")), "near")


def with_search(docs: DataFrame, asked: Column) -> DataFrame:
    """Rows of `edited` with near_texts, near_docs and near_first where `asked` holds, null elsewhere."""
    near = _sized(near_counts(docs, asked))
    d = edited(docs).withColumn("_asked", F.coalesce(asked, F.lit(False))).join(near, ["k1", "k2"], "left")
    return d.select(*[c for c in d.columns if c not in ("k1", "k2", "_asked", *NEAR)], *[F.when(F.col("_asked"), F.col(c)).alias(c) for c in NEAR])


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text and of the next document, in descending order of doc_id; k1, k2 name the text.

    Documents are dealt once, by ranges of doc_id cut at quantiles; each range also gets the first document of the range
    below it, which its last document needs, so no order runs through one task.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = src.count()
    parts = max(1, min(-(-n // ROWS_PER_BUCKET), MAX_BUCKETS))
    cuts: list[int] = []
    if parts > 1:
        shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
        cuts = src.agg(F.percentile_approx("doc_id", shares, F.lit(10 * parts)).alias("c")).first()["c"] or []
    at = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(at, ids.fillna(0).to_numpy(np.int64), side="left")), dtype="int32")

    tops = sorted((r["b"], r["top"]) for r in src.where("doc_id is not null").groupBy(bucket("doc_id").alias("b")).agg(F.max("doc_id").alias("top")).collect())  # one row per bucket
    above = {top: tops[i + 1][0] for i, (_, top) in enumerate(tops[:-1])}
    if tops:
        above[tops[-1][1]] = 0 if tops[0][0] == 0 or src.where("doc_id is null").limit(1).count() else tops[0][0]

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(at, ids.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series([[0] if pd.isna(i) else [int(b), -1 - above[int(i)]] if int(i) in above else [int(b)] for i, b in zip(ids, own)])

    dealt = (src.withColumn("b", F.explode(targets("doc_id")))
             .withColumn("carried", F.col("b") < 0).withColumn("b", F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")))
             .repartitionById(len(at) + 1, "b")
             .sortWithinPartitions("b", "carried", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"))
    schema = StructType([src.schema["doc_id"]])
    for c, t in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("k1", "long"), ("k2", "long")):
        schema = schema.add(c, t)

    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "carried")))

    def run(batches):
        hasher, held, first, out = word_hasher(), None, None, []

        def judged(a, b):
            half = len(a[1]) // 2
            changed = a[1][:len(a[1]) - half] + b[1][:half]
            e = signature(changed, hasher)
            return (a[0], len(a[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), a[2].tobytes().hex(), e.tobytes().hex(), likeness(a[2], e), likeness(a[2], b[2]), *text_key(a[1]))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))], names=schema.names)

        over = False
        for doc_id, text, carried in rows(batches):
            if over:
                continue  # more carried rows with the same id
            row = (doc_id, text, signature(text, hasher))
            first = first or row
            if held is not None:
                out.append(judged(held, row))
            held, over = (None, True) if carried else (row, False)
            if len(out) >= 1_000:
                yield batch()
                out.clear()
        if held is not None:  # ids that are all null: one range, closed in itself
            out.append(judged(held, first))
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)
