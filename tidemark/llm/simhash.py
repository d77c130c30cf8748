"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 5).

Every distinct fingerprint emits itself and its 64 one-bit variants. Two fingerprints within two bits share a variant, and
two that share a variant are within two bits, so a bucket holds at most 65 fingerprints; each links to the smallest of its
bucket, which joins the same groups as all pairs would. Components come from label spreading with pointer jumps.

Null text counts as empty: fingerprint zero, linked like any other. A null doc_id orders after all others. Repeated rows
give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import forget
from tidemark.llm.storage import checkpointed

SEED, SHINGLE, RADIUS, CHUNK = 42, 3, 2, 8_192


def fingerprint(text: str | None) -> bytes:
    """8 bytes: majority of each bit over the XXH64 of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    k = min(SHINGLE, len(words))
    ends = (starts + size)[k - 1:].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends)).astype(">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i:i + CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns `more`, fp (bits as a signed 64-bit number) of every row."""
    src = docs.select("doc_id", "text", *more)
    schema = StructType([f for f in src.schema if f.name != "text"]).add("fp", "long")

    def run(batches):
        forget()
        for b in batches:
            fps = b"".join(map(fingerprint, b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(np.frombuffer(fps, ">i8").astype(np.int64), pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def links(fps: DataFrame) -> DataFrame:
    """a, b: distinct fingerprints within two bits, enough of them to join each group. `fps` has distinct `fp`."""
    ball = fps.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("variant"))
    met = ball.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("variant")).alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, RADIUS)
    return met.where(close).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of all nodes of the links (a, b)."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        own = seen.join(labels.select(F.col("node").alias("a"), "root"), "a")
        # a neighbour's label is offered to the node and to the node's root, so whole trees move at once
        near = own.select(F.explode(F.array("a", "root")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("root", "near").alias("mid"), F.col("root").alias("was"))
        jump = spread.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        new = checkpointed(spread.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), "was"))
        if not new.where("root <> was").limit(1).count():
            return labels
        labels = new.select("node", "root")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = checkpointed(fingerprints(docs))
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least_doc"))
    roots = components(links(own.select("fp")))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group: the one with the smallest doc_id, rows without an id after all others; rows that
    agree in that by the smallest hash of the text and then of the whole row."""
    flat = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    keyed = docs.withColumns({"_text": F.xxhash64("text"), "_row": F.xxhash64(*flat)})
    rows = checkpointed(fingerprints(keyed, "_text", "_row"))
    own = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "_text", "_row")).alias("least"))
    roots = components(links(own.select("fp")))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select("least._text", "least._row")
    # rows alike in every column are still several
    return keyed.join(kept, ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
