"""Checks that make silent data loss visible; each returns rows instead of printing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedupe import union_by_priority
from tidemark.operators.ranks import exact_quantiles
from tidemark.params import Params


def coverage(prices: DataFrame, drop: float = 0.5, grace_months: int = 6) -> DataFrame:
    """Distinct tickers per month; months far below the peak after the first half year are flagged."""
    m = prices.groupBy(F.trunc("date", "month").alias("month")).agg(F.countDistinct("ticker").alias("tickers"))
    d = m.withColumn("peak", m.agg(F.max("tickers")).scalar()).withColumn("first", m.agg(F.min("month")).scalar())
    late = F.months_between("month", "first") > grace_months
    return d.select("month", "tickers", "peak", ((F.col("tickers") < F.col("peak") * drop) & late).alias("bad"))


def staleness(prepared: DataFrame, p: Params) -> DataFrame:
    """Share of universe rows scored on filings older than the limit, per month."""
    age = F.datediff("asof", "rcept_dt") / 30.44
    stale = F.coalesce(age > p.stale_months, F.lit(False)).cast("double")
    g = prepared.where("in_universe").groupBy("asof").agg(F.avg(stale).alias("stale_share"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("bad", F.col("stale_share") > p.stale_share)


def completeness(snaps: DataFrame, t: DataFrame, prices: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per ever-included member: first and last inclusion, last filing year, last price, track."""
    inc = snaps.where("included").groupBy("ticker").agg(F.min("asof_date").alias("first_in"), F.max("asof_date").alias("last_in"))
    names = snaps.where("name IS NOT NULL").groupBy("ticker").agg(F.max_by("name", "asof_date").alias("name"))
    fin = t.groupBy("ticker").agg(F.max("year").alias("fin_year"))
    px = prices.groupBy("ticker").agg(F.max("date").alias("px_last"))
    tr = tracks.select("ticker", F.lit(True).alias("_t")).distinct()
    d = reduce(lambda a, b: a.join(b, "ticker", "left"), [names, fin, px, tr], inc)
    stale = F.col("fin_year").isNull() | (F.col("fin_year") < F.year("last_in"))
    return d.select("ticker", "name", "first_in", "last_in", "fin_year", "px_last",
                    F.col("_t").isNotNull().alias("has_track"), stale.alias("stale"))


def missing_dates(wanted: Column, snaps: DataFrame) -> DataFrame:
    frame = snaps.sparkSession.range(1).select(F.explode(wanted).alias("asof_date"))
    return frame.join(snaps.select("asof_date").distinct(), "asof_date", "left_anti")


def needs_extension(prices: DataFrame, end: Column, days: int) -> DataFrame:
    last = prices.groupBy("ticker").agg(F.max("date").alias("last_date"))
    return last.where(F.col("last_date") < F.date_sub(end, days))


def upsert_prices(history: DataFrame, new: DataFrame) -> DataFrame:
    """History and new rows, new rows win on the same (ticker, date); history's columns only."""
    return union_by_priority([history, new.select(*[x for x in history.columns if x in new.columns])], ["ticker", "date"])


def reconcile(ours: DataFrame, external: DataFrame, fields: list[str], tol: float = 0.10) -> DataFrame:
    """Relative error against an outside source per field: compared, within tolerance, median.

    Zero or missing outside values do not count.
    """
    ext = external.select("ticker", *[F.col(f).alias(f"_x_{f}") for f in fields])
    d = ours.join(ext, "ticker")
    rel = lambda f: F.when(F.col(f"_x_{f}") != 0, F.abs(F.col(f) - F.col(f"_x_{f}")) / F.abs(f"_x_{f}"))
    arr = F.array(*[F.struct(F.lit(f).alias("field"), rel(f).alias("err")) for f in fields])
    e = d.select(F.explode(arr).alias("r")).select("r.*").where("err IS NOT NULL")
    g = e.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("err") <= tol).cast("int")).alias("within"))
    return g.join(exact_quantiles(e, ["field"], "err", {"median_err": 0.5}), "field")
