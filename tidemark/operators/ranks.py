"""Exact ranks, row numbers and quantiles for groups of any size.

A cross-sectional group (one date, one peer group) may hold a third of all rows, so no window
here is partitioned by the group alone:

1. equal values collapse to one row with a count (combined before the shuffle);
2. values fall into log-scaled buckets, a fixed monotone function of the value, so a group of any
   size is spread over thousands of buckets and any retry assigns the same bucket;
3. running counts are taken inside a bucket, bucket totals are summed over the (small) bucket
   list, and both are added.

NaN counts as a missing value. The result equals one window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BUCKETS_PER_E_FOLD = 200.0
WHOLE_GROUP = 100_000  # rows of a group that one task may rank at once; results do not depend on it


def value_bucket(x: str, per_fold: float = BUCKETS_PER_E_FOLD) -> Column:
    """Infinite values take the first and last bucket."""
    v = F.col(x).cast("double")
    scaled = F.signum(v) * F.log1p(F.abs(v) * 1000.0) * per_fold
    return F.floor(F.greatest(F.least(scaled, F.lit(1e9)), F.lit(-1e9))).cast("int")


def ranked(df: DataFrame, value: str) -> Column:
    """Whether a value takes part in a rank: neither NULL nor NaN."""
    there = F.col(value).isNotNull()
    return there & ~F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else there


def value_positions(df: DataFrame, keys: list[str], value: str, per_fold: float = BUCKETS_PER_E_FOLD) -> DataFrame:
    """Per distinct value of a group: rows below it, rows equal to it, rows in all."""
    vals = (df.where(ranked(df, value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
            .withColumn("_bucket", F.coalesce(value_bucket(value, per_fold), F.lit(0))))
    # totals of the buckets come from the same exchange as the running counts, so the value counts are made once; a bucket that
    # may be NULL would put a filter on one of the two sides only, and both would be computed
    bucket = W.partitionBy(*keys, "_bucket")
    inside = F.sum("_ties").over(bucket.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    vals = vals.withColumns({"_inside": inside, "_in_bucket": F.sum("_ties").over(bucket)})
    group = W.partitionBy(*keys)
    lower = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = vals.where("_inside IS NULL").select(
        *keys, "_bucket",
        F.coalesce(F.sum("_in_bucket").over(lower), F.lit(0)).alias("_lower"),
        F.sum("_in_bucket").over(group).alias("n_ranked"))
    return (vals.join(offsets, [*keys, "_bucket"])
                .select(*keys, value, (F.col("_lower") + F.coalesce("_inside", F.lit(0))).alias("n_below"),
                        F.col("_ties").alias("n_equal"), "n_ranked"))


def row_ranks(df: DataFrame, keys: list[str], value: str, size: str, per_fold: float = BUCKETS_PER_E_FOLD,
              whole: int = WHOLE_GROUP, counted: DataFrame | None = None) -> DataFrame:
    """Every row with a value, with n_below, n_equal and n_ranked of its group; keys are not NULL.

    `size` is a bound of the rows of a group, the same on all its rows. Groups of at most `whole` rows are ranked where their
    rows meet; larger ones are spread over value buckets, and only their rows are read again for the bucket offsets. The rows
    move once, as values are not counted first. `counted` has the same rows from a shorter plan, to be read for the offsets.
    """
    spread = F.col(size) > whole
    placed_in = lambda d: d.where(ranked(d, value)).withColumn(
        "_bucket", F.when(spread, F.coalesce(value_bucket(value, per_fold), F.lit(0))).otherwise(0))
    rows, again = placed_in(df), placed_in(df if counted is None else counted)
    bucket, group = W.partitionBy(*keys, "_bucket"), W.partitionBy(*keys)
    lower = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = again.where(spread).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_bucket", F.sum("_n").over(lower).alias("_lower"), F.sum("_n").over(group).alias("_in_group"))
    order = bucket.orderBy(value)
    placed = rows.withColumns({"_inside": F.rank().over(order) - 1, "_upto": F.count(F.lit(1)).over(order),
                               "_in_bucket": F.count(F.lit(1)).over(bucket)})
    return (placed.join(offsets, [*keys, "_bucket"], "left")
                  .select(*df.columns, (F.coalesce("_lower", F.lit(0)) + F.col("_inside")).alias("n_below"),
                          (F.col("_upto") - F.col("_inside")).alias("n_equal"),
                          F.coalesce("_in_group", "_in_bucket").alias("n_ranked")))


def with_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds n_below, n_equal and n_ranked; NULL values keep NULL positions.

    NULL values match nothing; a salt keeps them from meeting in one task.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(997)) + 1
    salted = df.withColumn("_salt", F.when(~ranked(df, value), spread).otherwise(0))
    pos = value_positions(df, keys, value).withColumn("_salt", F.lit(0).cast("long"))
    return salted.join(pos, [*keys, value, "_salt"], "left").drop("_salt")


def average_rank() -> Column:
    return F.col("n_below") + (F.col("n_equal") + 1) / 2.0


def average_rank_pct(df: DataFrame, keys: list[str], value: str, out: str, *,
                     min_ranked: int = 1) -> DataFrame:
    """Average-tie percentile rank 0..100 among non-NULL values; callers reverse by 100 - p."""
    p = average_rank() / F.col("n_ranked") * 100.0
    return (with_positions(df, keys, value)
            .withColumn(out, F.when(F.col("n_ranked") >= min_ranked, p))
            .drop("n_below", "n_equal", "n_ranked"))


def min_rank_desc(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    r = F.col("n_ranked") - F.col("n_below") - F.col("n_equal") + 1
    return (with_positions(df, keys, value).withColumn(out, r)
            .drop("n_below", "n_equal", "n_ranked"))


def row_positions(df: DataFrame, keys: list[str], value: str, tie: str, out: str, *,
                  descending: bool = False, keep_n: str | None = None) -> DataFrame:
    """Total order by (value, tie): 1-based position of each row with a non-NULL value.

    `tie` is a string and always ascends. Rows with one equal value are split by the head of
    `tie`, which follows its order.
    """
    head = F.substring(tie, 1, 5)
    same = [*keys, value]
    rows = (df.where(ranked(df, value)).withColumn("_head", head))
    inside = W.partitionBy(*same, "_head").orderBy(tie)
    heads = rows.groupBy(*same, "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*same).orderBy("_head").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*same, "_head",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = (F.col("n_ranked") - F.col("n_below") - F.col("n_equal") if descending
             else F.col("n_below"))
    placed = (rows.withColumn("_in", F.row_number().over(inside))
              .join(heads, [*same, "_head"])
              .join(value_positions(df, keys, value), same))
    placed = placed.withColumn(out, (start + F.col("_before") + F.col("_in")).cast("long"))
    if keep_n:
        placed = placed.withColumn(keep_n, F.col("n_ranked"))
    return placed.drop("_head", "_in", "_before", "n_below", "n_equal", "n_ranked")


def quantile_bucket(position: str, n: str, k: int) -> Column:
    """Bucket 1..k of a row position, the cut points of an equal-count quantile cut."""
    p, m = F.col(position), F.col(n)
    return F.when(m <= 1, 1).otherwise(
        F.greatest(F.lit(1), F.ceil(k * (p - 1) / (m - 1)))).cast("int")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, taken from value positions.

    Only the two neighbours of each quantile leave the executors that hold them; no group is
    gathered.
    """
    pos = value_positions(df, keys, value)
    last = F.col("n_below") + F.col("n_equal") - 1
    aggs = []
    for name, q in probs.items():
        h = (F.col("n_ranked") - 1) * float(q)
        lo, hi = F.floor(h), F.ceil(h)
        at = lambda i: (F.col("n_below") <= i) & (last >= i)
        aggs += [F.max(F.when(at(lo), F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(at(hi), F.col(value))).alias(f"_hi_{name}"),
                 F.max(h - lo).alias(f"_w_{name}")]
    out = pos.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in probs])


def top_n(df: DataFrame, keys: list[str], score: str, n: int, *, tie: str = "ticker",
          out: str = "rank") -> DataFrame:
    """The n highest scores per group, ties by `tie`; NULL scores never enter.

    Spark limits each map task to n rows per group before the shuffle, so the group size does
    not matter.
    """
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return (df.where(F.col(score).isNotNull())
              .withColumn(out, F.row_number().over(w)).where(F.col(out) <= n))
