"""Shards cut from a Hilbert curve over document metadata (operator 13). DataFrame functions only.

Every dimension is quantised into 2**BITS levels of about equal numbers of rows. Its values fall into bins that any data fill
in a bounded number: sizes by their leading bits, strings by the four hex digits after the prefix that all of them share. The
running share of a bin is its level. The levels of a row are read bit by bit through the state table of the curve; rows near
each other in all dimensions get near indices. Rows are ordered by curve index, within one index by a hash of id and text,
and runs of the order are cut into shards whose row counts differ by one at most (law `rows`).

No task sorts the whole order: a cell of the curve is split by hash into buckets of about n / 2**20 rows, rows are numbered
within their bucket, and offsets of buckets and cells are running sums over those small tables. Repeated rows are one row
with a count until their positions are known, so no group of copies meets in one task.

Null text counts as empty (size 8, checksum 0); a null or empty string is the lowest level of its dimension; rows without a
doc_id take part like others. Repeated rows get a place each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark.llm.storage import stored

BITS, SHARDS, OVERHEAD = 5, 24, 8
LEAST_BUCKET, MAX_BUCKETS = 512, 1 << 20  # rows of a bucket at least; buckets that large inputs are split into
COARSE = 9  # bits of the curve index below which running sums of cells are taken apart
DIMENSIONS = ("lang", "source")


def curve_table(n: int) -> list[int]:
    """next state * 2**n + digit for every (state, corner); a state is (entry corner, direction) of a sub-cube.

    The rule is the published one of Gray-coded corners: rotate and reflect the corner into the sub-cube's own frame, its rank
    along the Gray code is the digit, and the digit tells the frame of the next level.
    """
    full = (1 << n) - 1
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << n)]
    along = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    out = []
    for state in range(n << n):
        e, d = divmod(state, n)
        for corner in range(1 << n):
            w = gray.index(turn(corner ^ e, n - (d + 1) % n))
            out.append(((e ^ turn(entry[w], d + 1)) * n + (d + along[w] + 1) % n << n) + w)
    return out


def curve_index(levels: list[Column], bits: int = BITS) -> Column:
    """Position along the curve of a point whose coordinates have `bits` bits each."""
    n = len(levels)
    table = F.array(*[F.lit(x) for x in curve_table(n)])

    def step(acc: Column, i: Column) -> Column:
        corner = sum(((F.call_function("shiftright", x, i).bitwiseAND(1)) * (1 << j) for j, x in enumerate(levels)), F.lit(0))
        hit = F.get(table, (acc["state"] * (1 << n) + corner).cast("int"))
        return F.struct(F.shiftright(hit, n).alias("state"), (acc["at"] * (1 << n) + hit.bitwiseAND((1 << n) - 1)).alias("at"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("at")), step, lambda a: a["at"])


def size_bin(size: Column) -> Column:
    """Sixteen bins to every doubling: at most 1,008."""
    top = F.length(F.bin(size)) - 1
    return (top * 16 + F.call_function("shiftright", F.shiftleft(size, 4), top).bitwiseAND(15)).cast("int")


def text_bin(rows: DataFrame, name: str) -> Column:
    """Four hex digits of a string's bytes after the digits that the least and the greatest string, hence all, share."""
    x = F.hex(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
    ends = rows.select(x.alias("x")).where("x <> ''").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    same = F.expr("size(filter(sequence(1, greatest(length(a), 1)), i -> left(a, i) = left(b, i)))")
    return F.substr(x, F.coalesce(ends.select(same).scalar(), F.lit(0)) + 1, F.lit(4))


def levels(rows: DataFrame, bin_name: str, level: str, bits: int = BITS) -> DataFrame:
    """Level of every bin by its running share of `copies`; bins are bounded (65,536 and shorter ones), so one task sums them."""
    counts = rows.groupBy(bin_name).agg(F.sum("copies").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(bin_name).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy())
    return counts.select(bin_name, F.floor(before * (1 << bits) / total).cast("int").alias(level))


def placed(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, copies and `curve` of every distinct row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       *[F.col(f"`{c}`").alias(f"_dim{i}") for i, c in enumerate(dimensions)])
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "rows")
    rows = rows.withColumns({"_bin": size_bin(F.col("size")), **{f"_bin{i}": text_bin(rows, f"_dim{i}") for i in range(len(dimensions))}})
    names = ["_bin", *[f"_bin{i}" for i in range(len(dimensions))]]
    out = rows
    for b in names:
        out = out.join(F.broadcast(levels(rows, b, f"{b}_level", bits)), b)  # bounded by the number of bins
    return out.select("doc_id", "size", "text_crc32", "copies", *[f"_dim{i}" for i in range(len(dimensions))], curve_index([F.col(f"{b}_level") for b in names], bits).alias("curve"))


def positions(rows: DataFrame) -> DataFrame:
    """`first`: number of rows before a row in the order of the curve; `rows` has one row per distinct document and `copies`."""
    keyed = rows.withColumn("_key", F.crc32(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")).cast("binary")))
    total = keyed.agg(F.sum("copies").alias("n")).select("n").scalar()
    cells = keyed.groupBy("curve").agg(F.sum("copies").alias("_n"))
    width = F.greatest(F.lit(LEAST_BUCKET), F.ceil(total / MAX_BUCKETS))
    coarse = F.call_function("shiftright", F.col("curve"), F.lit(COARSE))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.groupBy(coarse.alias("_block")).agg(F.sum("_n").alias("_block_n"))
    blocks = blocks.select("_block", before("_block_n", W.orderBy("_block")).alias("_block_at"))  # bounded by the curve
    cells = (cells.withColumn("_block", coarse).withColumn("_in_block", before("_n", W.partitionBy("_block").orderBy("curve")))
             .join(F.broadcast(blocks), "_block").select("curve", F.ceil(F.col("_n") / width).alias("_splits"), (F.col("_block_at") + F.col("_in_block")).alias("_cell_at")))
    split = keyed.join(F.broadcast(cells), "curve").withColumn("_bucket", F.floor(F.col("_key") * F.col("_splits") / F.lit(1 << 32)))  # cells are bounded by the curve
    buckets = split.groupBy("curve", "_cell_at", "_bucket").agg(F.sum("copies").alias("_n"))
    buckets = buckets.select("curve", "_bucket", (F.col("_cell_at") + before("_n", W.partitionBy("curve").orderBy("_bucket"))).alias("_at"))
    order = [F.col(c).asc_nulls_first() for c in ("_key", "doc_id", "text_crc32", "size", *[c for c in rows.columns if c.startswith("_dim")])]
    numbered = split.withColumn("_in", before("copies", W.partitionBy("curve", "_bucket").orderBy(*order)))
    return numbered.join(buckets, ["curve", "_bucket"]).withColumn("first", F.col("_at") + F.col("_in")).select(*rows.columns, "first")


def shard(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row."""
    rows = placed(docs, dimensions)
    n = rows.agg(F.sum("copies").alias("n")).select("n").scalar()
    each = positions(rows).select("doc_id", "size", "text_crc32", "curve", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("at"))
    cut = each.withColumn("shard", F.call_function("div", F.col("at") * shards, n).cast("int"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - F.ceil(F.col("shard").cast("long") * n / F.lit(shards))).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


# ---- files ---------------------------------------------------------------------------------------------------------------
def write_files(docs: DataFrame, path: str, files: int, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """All columns of `docs` as Parquet files, each a run of the curve over the size of the text and `dimensions`. Files are cut
    by Spark's range partitioning with the hash of id and text behind the index, so a hot cell spreads over several files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    probe = docs.select(size.alias("_size"), *[F.col(f"`{c}`").alias(f"_dim{i}") for i, c in enumerate(dimensions)]).withColumn("copies", F.lit(1))
    bins = {"_bin": (size_bin(F.col("_size")), size_bin(size))}
    for i, c in enumerate(dimensions):
        bins[f"_bin{i}"] = (text_bin(probe, f"_dim{i}"), text_bin(docs, c))
    out = docs.withColumns({f"_hilbert{b}": mine for b, (_, mine) in bins.items()})
    for b, (theirs, _) in bins.items():
        table = levels(probe.withColumn(f"_hilbert{b}", theirs), f"_hilbert{b}", f"_hilbert{b}_level")
        out = out.join(F.broadcast(table), f"_hilbert{b}")
    at = curve_index([F.col(f"_hilbert{b}_level") for b in bins])
    out = out.withColumns({"_hilbert_at": at, "_hilbert_key": F.xxhash64(F.col("doc_id"), text)})
    keep = [F.col(f"`{c}`") for c in docs.columns]
    out.repartitionByRange(files, "_hilbert_at", "_hilbert_key").sortWithinPartitions("_hilbert_at", "_hilbert_key").select(*keep).write.parquet(path)


def manifest(files: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """file, rows, and least and greatest value of the size and of every dimension, read from written files."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + OVERHEAD
    ends = [f(x).alias(f"{name}_{end}") for name, x in [("size", size), *[(c, F.col(f"`{c}`")) for c in dimensions]] for end, f in (("min", F.min), ("max", F.max))]
    return files.withColumn("_file", F.input_file_name()).groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends)


def prune(table: DataFrame, **ranges: tuple) -> DataFrame:
    """Files of a manifest that can hold rows whose dimensions lie in the given closed ranges."""
    out = table
    for name, (low, high) in ranges.items():
        out = out.where((F.col(f"`{name}_max`") >= F.lit(low)) & (F.col(f"`{name}_min`") <= F.lit(high)))
    return out
