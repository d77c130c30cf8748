"""Universe snapshots of every rebalance date in one plan; excluded rows stay with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import min_rank_desc, top_n
from tidemark.params import Params

# fixed values: exclusion reasons, first match wins
PREFERRED, NO_CAP, LOW_CAP, LOW_TURNOVER, OUT_OF_TOP = (
    "preferred", "no_cap", "low_cap", "low_turnover", "out_of_top")


def settled_days(market: DataFrame) -> DataFrame:
    """(market, date) pairs on which more than half of the rows carry a positive close."""
    return (market.groupBy("market", "date")
            .agg(F.avg((F.coalesce("close", F.lit(0.0)) > 0).cast("double")).alias("_share"))
            .where("_share > 0.5").select("market", "date"))


def recent_settled(days: DataFrame, dates: Column, back: int, n: int) -> DataFrame:
    """For each date and market, the last `n` settled days among `back` calendar days."""
    hit = F.filter("_cal", lambda d: (d >= F.col("date")) & (F.datediff(d, F.col("date")) < back))
    rows = days.withColumn("_cal", dates).withColumn("asof", F.explode(hit)).drop("_cal")
    w = W.partitionBy("asof", "market").orderBy(F.col("date").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def previous_settled(days: DataFrame, dates: Column, lead_market: str, p: Params) -> DataFrame:
    """(asof, price_date); an asof without a settled day in reach has no row."""
    lead = days.where(F.col("market") == lead_market)
    return recent_settled(lead, dates, p.business_day_lookback, 1).select(
        "asof", F.col("date").alias("price_date"))


def liquidity(market: DataFrame, days: DataFrame, dates: Column, p: Params) -> DataFrame:
    """Mean trading value per (asof, ticker) over the last settled days of its market."""
    # rows: settled days x dates within reach, bounded by the calendar
    window = recent_settled(days, dates, p.liquidity_calendar_days, p.liquidity_days)
    return (market.select("ticker", "market", "date", "trading_value")
            .join(F.broadcast(window.select("asof", "market", "date")), ["market", "date"])
            .groupBy("asof", "ticker").agg(F.avg("trading_value").alias("avg_trading_value")))


def snapshots(market: DataFrame, dates: Column, p: Params, lead_market: str = "KOSPI") -> DataFrame:
    days = settled_days(market)
    price_days = previous_settled(days, dates, lead_market, p)
    base = (market.withColumnRenamed("date", "price_date")
            .join(F.broadcast(price_days), "price_date")
            .join(liquidity(market, days, dates, p), ["asof", "ticker"], "left"))
    reason = (F.when(~F.col("ticker").endswith("0"), PREFERRED)
               .when(F.col("market_cap").isNull() | (F.col("market_cap") <= 0), NO_CAP)
               .when(F.col("market_cap") < p.min_market_cap, LOW_CAP)
               .when(F.col("avg_trading_value").isNull()
                     | (F.col("avg_trading_value") < p.min_avg_trading_value), LOW_TURNOVER))
    base = base.withColumn("excluded_reason", reason)
    members = top_n(base.where(F.col("excluded_reason").isNull()), ["asof"], "market_cap",
                    p.universe_size).select("asof", "ticker", F.lit(True).alias("_in"))
    out = min_rank_desc(base.join(members, ["asof", "ticker"], "left"), ["asof"], "market_cap", "cap_rank")
    included = F.coalesce("_in", F.lit(False))
    return (out.withColumn("excluded_reason",
                           F.when(F.col("excluded_reason").isNull() & ~included, OUT_OF_TOP)
                           .otherwise(F.col("excluded_reason")))
            .select(F.col("asof").alias("asof_date"), "price_date", "ticker", "name", "market",
                    "close", "market_cap", "shares_out", "volume", "trading_value",
                    "avg_trading_value", "cap_rank", included.alias("included"), "excluded_reason"))


def ever_included(snaps: DataFrame) -> DataFrame:
    return snaps.where("included").select("ticker").distinct()
