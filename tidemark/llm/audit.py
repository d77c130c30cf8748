"""Interaction audit of corpus filters with a counting-Bloom duplicate prepass (operator 11).

Filters A to D look at one text each; E fails a text that a smaller doc_id holds as well. Every row gets a mask of the filters
it fails, masks are counted per part, and all figures of all filter orders follow from those counts.

Duplicates: every task counts the hashes of its texts in a sketch, K saturating counters a text; sketches are summed region
by region. A text with a counter of one is unique for certain and is done with. Only the rest, possible repeats, shuffle, and
the smallest id of each text is taken by the whole text's SHA-256, so an unlucky counter costs work and never a result.
The sketch grows with the number of rows. Its bits (one byte a row) are broadcast up to `BROADCAST_BYTES`; beyond, rows meet
the bits of their region in a shuffle of their hashes, large regions split.

Null text counts as empty, a null lang as the part ''. A null doc_id has no label, is never a repeat and makes none. Of
several labels of one doc_id each counts if any row has it. Repeated rows count each; they share the id, so they are no
repeats of each other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import mix
from tidemark.llm.storage import stored

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SLOTS_PER_ROW, K, REGION_BITS = 8, 3, 22
BROADCAST_BYTES, REGION_ROWS, FLUSH = 64 << 20, 1 << 20, 1 << 21


# ---- filters -----------------------------------------------------------------------------------------------------------
def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; `text` is not null."""
    w = F.split(text, r"[\x20\x09-\x0D]+")  # may begin and end with an empty piece
    n = F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
    different = F.size(F.array_distinct(w)) - F.array_contains(w, "").cast("int")
    upper = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < MIN_WORDS, 100 * different < MIN_DISTINCT_PCT * n, 100 * upper.cast("long") > MAX_UPPER_PCT * F.char_length(text), text.rlike(SYMBOLS))
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


# ---- counting Bloom sketch -----------------------------------------------------------------------------------------------
def places(h: np.ndarray, bits: int, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """Region of every hash, and its K different slots of the 2**bits in there."""
    x = mix(h.astype(np.uint64))
    y = mix(x ^ np.uint64(0x9E3779B97F4A7C15))
    step = (y >> np.uint64(32)) | np.uint64(1)
    slots = (y[:, None] + np.arange(K, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)
    return (x % np.uint64(regions)).astype(np.int64), slots.astype(np.int64)


def sketch_size(n: int, region_bits: int = REGION_BITS) -> tuple[int, int]:
    """(bits of a region, regions) for n rows."""
    want = max(n * SLOTS_PER_ROW, 1 << 12)
    if want <= 1 << region_bits:
        return (want - 1).bit_length(), 1
    return region_bits, -(-want >> region_bits)


def sketch(hashes: DataFrame, bits: int, regions: int) -> DataFrame:
    """region, seen: one bit for every slot counted twice or more. `hashes` has one column of 64-bit hashes."""

    def count(batches):
        held, size = [], 0

        def flush():
            if not held:
                return
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cut = np.flatnonzero(np.diff(at >> bits, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
                yield int(at[a] >> bits), (at[a:b] & ((1 << bits) - 1)).astype(np.uint32).tobytes(), np.minimum(n[a:b], 2).astype(np.uint8).tobytes()

        def batch(rows):
            r, s, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.binary()), pa.array(c, pa.binary())], names=["region", "slots", "counts"])

        for b in batches:
            region, slots = places(b.column(0).to_numpy(zero_copy_only=False), bits, regions)
            held.append(((region[:, None] << bits) + slots).ravel())
            size += held[-1].size
            if size >= FLUSH:
                rows, size = list(flush()), 0
                if rows:
                    yield batch(rows)
        rows = list(flush())
        if rows:
            yield batch(rows)

    def merge(batches):
        at, counters = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(counters >= 2, bitorder="little").tobytes()], pa.binary())], names=["region", "seen"])

        for b in batches:
            for region, slots, counts in zip(*(c.to_pylist() for c in b.columns)):
                if region != at:
                    if at is not None:
                        yield done()
                    at, counters = region, np.zeros(1 << bits, np.uint8)
                s = np.frombuffer(slots, np.uint32)  # the slots of one sketch differ
                counters[s] = np.minimum(counters[s] + np.frombuffer(counts, np.uint8), 2)
        if at is not None:
            yield done()

    parts = hashes.mapInArrow(count, "region long, slots binary, counts binary")
    return parts.repartition("region").sortWithinPartitions("region").mapInArrow(merge, "region long, seen binary")


def _again(seen: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((seen[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1)


def possible_repeats(rows: DataFrame, hash_name: str, bound: int = BROADCAST_BYTES, region_bits: int = REGION_BITS, region_rows: int = REGION_ROWS) -> DataFrame:
    """`rows` with `maybe`: false if no other row has the same hash, for certain. `rows` is stored and has a column `row` of numbers."""
    bits, regions = sketch_size(rows.count(), region_bits)
    seen = sketch(rows.select(hash_name), bits, regions)
    schema = StructType([*rows.schema.fields]).add("maybe", "boolean")
    names = list(rows.columns)
    at, width = names.index(hash_name), len(names)

    if regions << bits >> 3 <= bound:
        merged = np.zeros((regions, 1 << bits >> 3), np.uint8)
        for r in seen.collect():  # one byte a row, at most `bound`
            merged[r.region] = np.frombuffer(r.seen, np.uint8)
        held = rows.sparkSession.sparkContext.broadcast(merged)

        def test(batches):
            table = held.value.reshape(-1)
            for b in batches:
                region, slots = places(b.column(at).to_numpy(zero_copy_only=False), bits, regions)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_again(table, (region[:, None] << bits) + slots))], names=schema.names)

        return rows.mapInArrow(test, schema)

    def regional(batches):
        for b in batches:
            region, _ = places(b.column(at).to_numpy(zero_copy_only=False), bits, regions)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int64())], names=[*names, "region"])

    placed = rows.mapInArrow(regional, StructType([*rows.schema.fields]).add("region", "long"))
    loads = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / region_rows).alias("parts"))
    near = placed.join(loads, "region").withColumn("part_no", F.pmod("row", "parts")).drop("parts").withColumn("seen", F.lit(None).cast("binary"))
    tables = seen.join(loads, "region").select("region", "seen", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part_no"))
    met = near.unionByName(tables, allowMissingColumns=True).repartition("region", "part_no").sortWithinPartitions("region", "part_no", F.col("seen").isNull())
    met = met.select(*names, "region", "seen")

    def streamed(batches):
        table = None
        for b in batches:
            seen_col = b.column(width + 1)
            heads = np.flatnonzero(seen_col.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, z in zip([-1, *heads], [*heads, b.num_rows]):
                if a >= 0:
                    table = np.frombuffer(seen_col[a].as_py(), np.uint8)
                if z > a + 1:
                    part = b.slice(a + 1, z - a - 1)
                    _, slots = places(part.column(at).to_numpy(zero_copy_only=False), bits, regions)
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(_again(table, slots))], names=schema.names)

    return met.mapInArrow(streamed, schema)


def repeats(rows: DataFrame, **sizes) -> DataFrame:
    """`rows` with `again`: a smaller doc_id has the same text. `rows` is stored, with row, doc_id, digest and h."""
    tested = stored(possible_repeats(rows, "h", **sizes), "tested")
    maybe = tested.where("maybe")
    least = maybe.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least")
    least = stored(least, "least")  # a plain exchange on both sides of the join lets the adaptive plan split a hot text
    found = maybe.join(least, "digest", "left").withColumn("again", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    return found.select(*rows.columns, "again").unionByName(tested.where("not maybe").select(*rows.columns, F.lit(False).alias("again")))


# ---- audit -----------------------------------------------------------------------------------------------------------------
def mask_counts(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """part, mask, n, good, toxic: documents by the exact set of filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("digest")}), "masks")
    flagged = repeats(rows, **sizes).select("doc_id", "part", (F.col("mask") + F.col("again").cast("int") * (1 << LETTERS.index("E"))).alias("mask"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    blank = F.lit(None).cast("int")
    both = flagged.where("doc_id is not null").join(said, "doc_id", "left").unionByName(flagged.where("doc_id is null").withColumns({"good": blank, "toxic": blank}))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Figures of every step of every order of the filters, from the counts of masks."""
    k = len(letters)
    per_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # at most 2**k entries
    per_part = per_part.select("part", *[F.expr(f"transform(sequence(0, {(1 << k) - 1}), i -> coalesce(m[i].{c}, 0L))").alias(c) for c in ("n", "good", "toxic")])
    runs = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    d = per_part.select("*", F.explode(runs).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda letter: f"shiftleft(1, instr('{letters}', {letter}) - 1)"
    d = d.withColumns({"f": F.expr(bit("substr(filter_order, step, 1)")),
                       "before": F.expr(f"aggregate(sequence(0, step - 1), 0, (a, i) -> a + if(i = 0, 0, {bit('substr(filter_order, i, 1)')}))")})
    every = f"sequence(0, {(1 << k) - 1})"
    total = lambda value, cond: F.expr(f"aggregate({every}, 0L, (a, i) -> a + if({cond}, {value}, 0L))")
    first = "(i & f) <> 0 and (i & before) = 0"
    fact = "aggregate(sequence(1, {}), 1L, (a, i) -> a * i)".format(k)
    return d.select("part", "filter_order", "step", total("n[i]", "(i & (before | f)) = 0").alias("kept"), total("n[i]", first).alias("removed"),
                    total("n[i]", "(i & f) <> 0 and (i & before) <> 0").alias("redundant"), total("n[i]", "i = f").alias("unique_fails"),
                    total("good[i]", first).alias("good_lost"), total("toxic[i]", first).alias("toxic_lost"),
                    # in one of bit_count(i) orders the filter comes first of those that a document fails
                    total(f"n[i] * ({fact} div greatest(bit_count(i), 1))", "(i & f) <> 0").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """part, filter_order, step and the figures of `orders` for whole documents."""
    return orders(stored(mask_counts(docs, labels, **sizes), "counts"))
