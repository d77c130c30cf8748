"""Price momentum of every (ticker, day) row in one window pass."""

from __future__ import annotations

from functools import reduce
from math import prod
from operator import add

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# fixed values: window lengths in rows
M1, M3, M6, W52, VOL_SHORT, VOL_LONG, MA, RSI = 21, 63, 126, 252, 5, 60, 20, 14


# a frame of so many rows is put together in steps: the factors are the parts that each step joins
STEPS = {VOL_SHORT: (5,), RSI: (7, 2), MA: (5, 4), VOL_LONG: (5, 4, 3), W52: (6, 6, 7)}


def trailing(d: DataFrame, frames: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Adds the sum, count or max of a column over the last n rows of each ticker: {name: (column, n, kind)}.

    A frame is the last part of a row and those that end before it, so a row reads as many earlier rows as the factors of n
    add up to, not n; nothing is subtracted from a sum. As in a window frame, missing values are left out, but the sum of none is zero.
    """
    w = W.partitionBy("ticker").orderBy("date")
    known = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    counted = {c: f"_upto_{c}" for c, _, kind in frames.values() if kind == "count"}
    d = d.withColumns({name: F.count(c).over(w.rowsBetween(W.unboundedPreceding, 0)) for c, name in counted.items()})
    steps = {n: STEPS.get(n, (n,)) for _, n, kind in frames.values() if kind != "count"}
    depths, own = max(map(len, steps.values())), set(counted.values())
    part = lambda c, kind, some: f"_{kind}_{c}_{prod(some)}" if some else c
    for depth in range(1, depths + 1):
        new = {}
        for c, n, kind in frames.values():
            if kind == "count" or depth > len(steps[n]):
                continue
            some, size = steps[n][:depth], prod(steps[n][:depth - 1])
            before = part(c, kind, some[:-1])
            parts = [F.col(before), *[F.lag(before, size * i).over(w) for i in range(1, some[-1])]]
            new[part(c, kind, some)] = reduce(add, map(known, parts)) if kind == "sum" else F.greatest(*parts)
        if depth == depths:
            new |= {name: F.col(counted[c]) - F.coalesce(F.lag(counted[c], n).over(w), F.lit(0)) for name, (c, n, kind) in frames.items() if kind == "count"}
        own |= {*new} - {*frames}
        d = d.withColumns(new)
    return d.withColumns({name: F.col(part(c, kind, steps[n])) for name, (c, n, kind) in frames.items() if kind != "count"}).drop(*own)


def _mean(total: str, n: str) -> Column:
    return F.col(total) / F.nullif(F.col(n), F.lit(0))


# fixed values: frames of the momentum columns and of the turnover, column and rows
MOMENTUM = {"_v_short": ("volume", VOL_SHORT, "sum"), "_n_short": ("volume", VOL_SHORT, "count"),
            "_v_long": ("volume", VOL_LONG, "sum"), "_n_long": ("volume", VOL_LONG, "count"),
            "_ma": ("close_adj", MA, "sum"), "_n_ma": ("close_adj", MA, "count"), "_hi": ("close_adj", W52, "max"),
            "_up": ("_gain", RSI, "sum"), "_down": ("_loss", RSI, "sum")}
TURNOVER = {"_total": ("_tv", VOL_LONG, "sum"), "_n_tv": ("_tv", VOL_LONG, "count")}
TURNOVER_MIN = 20


def features(prices: DataFrame, turnover: bool = False) -> DataFrame:
    """Momentum columns, with `turnover` also that of `average_turnover`; `prices` has one row per (ticker, date)."""
    w = W.partitionBy("ticker").orderBy("date")
    close, rn = F.col("close_adj"), F.col("price_days")

    def ret(n: int) -> Column:
        prev = F.lag("close_adj", n).over(w)
        return F.when(prev > 0, (close / prev - 1) * 100.0)

    def over(n: int, base: Column, value: Column) -> Column:
        return F.when((rn >= n) & (base > 0), value)

    d = _with_tv(prices) if turnover else prices
    d = d.withColumns({"price_days": F.row_number().over(w), "_diff": close - F.lag("close_adj").over(w),
                       "return_1m": ret(M1), "return_3m": ret(M3), "return_6m": ret(M6)})
    d = d.withColumns({"_gain": F.greatest(F.col("_diff"), F.lit(0.0)), "_loss": F.greatest(-F.col("_diff"), F.lit(0.0))})
    d = trailing(d, {**MOMENTUM, **(TURNOVER if turnover else {})})
    d = d.withColumns({"_v_short": _mean("_v_short", "_n_short"), "_v_long": _mean("_v_long", "_n_long"), "_ma": _mean("_ma", "_n_ma"),
                       "_up": F.col("_up") / RSI, "_down": F.col("_down") / RSI})
    d = d.withColumns({
        "volume_ratio": over(VOL_LONG, F.col("_v_long"), F.col("_v_short") / F.col("_v_long")),
        "pos_52w": over(W52, F.col("_hi"), close / F.col("_hi") * 100.0),
        "disparity_20": over(MA, F.col("_ma"), close / F.col("_ma") * 100.0),
        "rsi_14": F.when(rn >= RSI + 1,
                         F.when(F.col("_down") == 0, 100.0)
                         .otherwise(100.0 - 100.0 / (1 + F.col("_up") / F.nullif("_down", F.lit(0.0))))),
    }).drop("_diff", "_gain", "_loss", *MOMENTUM)
    return _average(d) if turnover else d


COLUMNS = ["price_days", "return_1m", "return_3m", "return_6m", "volume_ratio", "pos_52w",
           "disparity_20", "rsi_14"]


def _with_tv(prices: DataFrame) -> DataFrame:
    return prices.withColumn("_tv", F.col("close_adj") * F.col("volume"))


def _average(d: DataFrame) -> DataFrame:
    return d.withColumn("avg_tv", F.when(F.col("_n_tv") >= TURNOVER_MIN, _mean("_total", "_n_tv"))).drop("_tv", *TURNOVER)


def average_turnover(prices: DataFrame) -> DataFrame:
    """Rolling mean of close x volume over 60 rows; NULL until 20 values exist."""
    return _average(trailing(_with_tv(prices), TURNOVER))


def overheated() -> Column:
    """Array of the overheating signals that fire."""
    d, r, p = F.col("disparity_20"), F.col("rsi_14"), F.col("pos_52w")
    return F.array_compact(F.array(
        F.when(d >= 130, F.lit("disparity")), F.when(r >= 80, F.lit("rsi")),
        F.when((p >= 99) & (r >= 75), F.lit("high_52w"))))
