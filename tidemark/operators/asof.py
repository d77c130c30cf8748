"""As-of operators.

The observation side is always unique on (key, day) or (key, period): a key has at most one row
per calendar day, which bounds every window partitioned by key. Sides without that bound (news
mentions, picks) are reduced to distinct (key, day) first and joined back by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def day_slots(spark: SparkSession, dates: Column) -> Column:
    """For every day after the first date of a calendar: the number of the first date on or after it. One array of as many
    entries as the calendar has days, looked up by date arithmetic."""
    days = spark.range(1).select(dates.alias("c")).select(F.expr("""flatten(transform(
        slice(sequence(0, size(c)), 2, greatest(size(c) - 1, 0)), i -> array_repeat(i, datediff(c[i], c[i - 1]))))"""))
    return days.scalar()


def slot_of(obs: DataFrame, ts: str, dates: Column) -> Column:
    """Number of the first calendar date on or after the day of `ts`; NULL after the last one."""
    first = obs.sparkSession.range(1).select(F.get(dates, F.lit(0))).scalar()
    after = F.datediff(F.col(ts), first)
    return F.when(after <= 0, F.lit(0)).otherwise(F.get(day_slots(obs.sparkSession, dates), after - 1))


def _over_slots(last: DataFrame, columns: list[str], dates: Column, out: str) -> DataFrame:
    """Rows of a slot repeated for its date and those of the empty slots before `_next`."""
    span = F.slice("_cal", F.col("_slot") + 1, F.coalesce("_next", F.size("_cal")) - F.col("_slot"))
    return last.withColumn("_cal", dates).select(*[F.col(f"`{c}`") for c in columns], F.explode(span).alias(out))


def on_dates(obs: DataFrame, key: str, ts: str, dates: Column, out: str = "asof") -> DataFrame:
    """Last observation at or before each date of a calendar (a sorted array column). (key, ts) is unique.

    A day belongs to the slot of the first calendar date on or after it. The last row of each (key, slot) is taken by an
    aggregate that is combined before the shuffle; only those few rows are then filled forward over empty slots.
    """
    rest = [c for c in obs.columns if c not in (key, ts)]
    per = (obs.withColumn("_slot", slot_of(obs, ts, dates)).where("_slot IS NOT NULL").groupBy(key, "_slot")
           .agg(F.max(ts).alias(ts), *[F.max_by(F.col(f"`{c}`"), F.col(ts)).alias(c) for c in rest]))
    nxt = F.lead("_slot").over(W.partitionBy(key).orderBy("_slot"))
    return _over_slots(per.withColumn("_next", nxt), obs.columns, dates, out)


def ordered_on_dates(obs: DataFrame, key: str, ts: str, dates: Column, out: str = "asof") -> DataFrame:
    """`on_dates` for observations that windows over (key, ts) have already dealt by key and sorted: the last row of a slot is the one
    before the next slot, so nothing is gathered."""
    nxt = F.lead("_slot").over(W.partitionBy(key).orderBy(ts))
    seen = obs.withColumn("_slot", slot_of(obs, ts, dates)).where("_slot IS NOT NULL").withColumn("_next", nxt)
    return _over_slots(seen.where("_next IS NULL OR _next > _slot"), obs.columns, dates, out)


def _explode_validity(obs: DataFrame, nxt: Column, ts: str, dates: Column, out: str) -> DataFrame:
    # the calendar is a column first: a subquery may not sit inside a lambda
    valid = F.filter("_cal", lambda d: (d >= F.col(ts)) & (F.col("_next").isNull() | (d < F.col("_next"))))
    return (obs.withColumn("_next", nxt).withColumn("_cal", dates)
               .withColumn(out, F.explode(valid)).drop("_next", "_cal"))


def latest_period_on_dates(filings: DataFrame, keys: list[str], period: str, ts: str,
                           dates: Column, out: str = "asof") -> DataFrame:
    """Latest *period* already received at each date, whatever order filings arrived in."""
    day = filings.groupBy(*keys, ts).agg(F.max_by(
        F.struct(*[F.col(x) for x in filings.columns if x not in (*keys, ts)]), period).alias("_r"))
    day = day.select(*keys, ts, "_r.*")
    order = W.partitionBy(*keys).orderBy(ts)
    seen = F.max(period).over(order.rowsBetween(W.unboundedPreceding, -1))
    records = (day.withColumn("_seen", seen)
                  .where(F.col("_seen").isNull() | (F.col(period) >= F.col("_seen"))).drop("_seen"))
    return _explode_validity(records, F.lead(ts).over(order), ts, dates, out)


def backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
             values: list[str]) -> DataFrame:
    """Left rows with the last right row at or before them (inclusive); unmatched rows stay.

    Only distinct (key, day) of the left side meet the right side.
    """
    probes = left.select(key, F.col(left_ts).alias("_ts")).distinct()
    payload = F.struct(F.col(right_ts).alias(right_ts), *[F.col(v) for v in values])
    both = (probes.select(key, "_ts", F.lit(1).alias("_probe"),
                          F.lit(None).cast(_struct_of(right, [right_ts, *values])).alias("_r"))
            .unionByName(right.select(key, F.col(right_ts).alias("_ts"), F.lit(0).alias("_probe"),
                                      payload.alias("_r"))))
    w = W.partitionBy(key).orderBy("_ts", "_probe").rowsBetween(W.unboundedPreceding, 0)
    filled = (both.withColumn("_r", F.last("_r", ignorenulls=True).over(w))
                  .where(F.col("_probe") == 1).select(key, F.col("_ts").alias(left_ts), "_r.*"))
    return left.join(filled, [key, left_ts], "left")


def previous_versions(df: DataFrame, version: str, out: str) -> DataFrame:
    """(version, out): every version of `df` with the latest strictly older one; the first has none and is left out.

    Versions are dates of a calendar, one row each.
    """
    v = df.select(version).distinct()
    return v.withColumn(out, F.lag(version).over(W.orderBy(version))).where(F.col(out).isNotNull())


def _struct_of(df: DataFrame, cols: list[str]) -> str:
    t = dict(df.dtypes)
    return "struct<" + ",".join(f"`{x}`:{t[x]}" for x in cols) + ">"


def latest_received(df: DataFrame, asof: Column, *, key: str = "ticker", ts: str = "rcept_dt",
                    order: str = "period") -> DataFrame:
    """One row per key: the row received last at or before `asof` (first in `order` on a tie)."""
    rest = [x for x in df.columns if x != key]
    return (df.where(F.col(ts) <= asof)
              .groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), -F.col(order))).alias("_r"))
              .select(key, "_r.*").select(*df.columns))


def forward_rows(prices: DataFrame, horizon: int, *, key: str = "ticker", ts: str = "date",
                 value: str = "close_adj") -> DataFrame:
    """Per row, percent return to the `horizon`-th following row; NULL when it does not exist."""
    w = W.partitionBy(key).orderBy(ts)
    later = F.lead(value, horizon).over(w)
    return prices.withColumn(f"fwd_{horizon}",
                             F.when(F.col(value) > 0, (later / F.col(value) - 1) * 100.0))
