"""Monthly as-of panel of all dates in one plan.

Months are a column. Prices, filings and share counts each turn into (ticker, asof) rows by
exploding the validity interval of an observation, then meet by equality; ranks run once over
all months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import month_day5, weighted
from tidemark.operators.asof import forward_rows, latest_period_on_dates, on_dates, ordered_on_dates
from tidemark.operators.ranks import min_rank_desc
from tidemark.params import Params
from tidemark.plans import flags, metrics, momentum, strategies


def cohort_dates(prices: DataFrame, horizon: int = 63, warmup_days: int = 400) -> Column:
    """Month dates with a price warm-up behind and a forward horizon ahead."""
    start = F.date_add(F.min("date"), warmup_days)
    end = F.date_sub(F.max("date"), int(horizon * 1.5))
    return prices.agg(month_day5(start, end).alias("d")).scalar()


def versions(t: DataFrame) -> DataFrame:
    """Adds `ver`: NULL for tickers whose filings arrived in period order.

    A ticker with a filing received after a later period gets one copy of its visible rows per
    receipt date, so history features never read a row before it was received. Both arrays are
    bounded by the number of quarters of one ticker.
    """
    by_receipt = W.partitionBy("ticker").orderBy("rcept_dt", "period")
    seen = F.max("period").over(by_receipt.rowsBetween(W.unboundedPreceding, -1))
    ticker = W.partitionBy("ticker")
    d = t.where(F.col("rcept_dt").isNotNull()).withColumn("_late", F.coalesce(seen > F.col("period"), F.lit(False)))
    d = d.withColumn("_any", F.max("_late").over(ticker)).withColumn("_all", F.collect_set("rcept_dt").over(ticker))
    copies = F.when(F.col("_any"), F.filter("_all", lambda v: v >= F.col("rcept_dt"))).otherwise(
        F.array(F.lit(None).cast("date")))
    return d.withColumn("ver", F.explode(copies)).drop("_late", "_any", "_all")


def fundamentals_on_dates(t: DataFrame, dates: Column, p: Params) -> DataFrame:
    """Latest visible period of each (ticker, asof) with history features of visible rows only."""
    part = ["ticker", "ver"]
    d = metrics.history_features(versions(t), p, part)
    newest = F.max("period").over(W.partitionBy(*part))
    d = d.withColumn("_new", newest).where(F.col("ver").isNull() | (F.col("period") == F.col("_new")))
    d = d.withColumn("valid_from", F.coalesce("ver", "rcept_dt")).drop("_new", "ver")
    return latest_period_on_dates(d, ["ticker"], "period", "valid_from", dates).drop("valid_from")


def prices_on_dates(prices: DataFrame, dates: Column, horizon: int = 63) -> DataFrame:
    """Last price row per (ticker, asof) with momentum, turnover and forward return."""
    # features, turnover and slots are windows over one exchange by ticker; rows copied between windows are what they cost, so they share them
    d = momentum.features(forward_rows(prices, horizon), turnover=True)
    last_tv = F.last("avg_tv", ignorenulls=True).over(
        W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("avg_tv", last_tv)
    keep = ["ticker", "date", "close_adj", "avg_tv", f"fwd_{horizon}", *momentum.COLUMNS]
    return (ordered_on_dates(d.select(*keep), "ticker", "date", dates)
            .withColumnRenamed("date", "price_date").withColumnRenamed("close_adj", "price_asof"))


def shares_on_dates(snaps: DataFrame, dates: Column) -> DataFrame:
    """Share count last seen at or before each date; the last one decides, then it must be > 0."""
    obs = snaps.where("shares_out IS NOT NULL").select("ticker", F.col("asof_date").alias("_seen"), "shares_out")
    return on_dates(obs, "ticker", "_seen", dates).where("shares_out > 0").drop("_seen")


def cohorts(t: DataFrame, prices: DataFrame, snaps: DataFrame, tracks: DataFrame, p: Params, *,
            horizon: int = 63, fixed_shares: DataFrame | None = None, dates: Column | None = None) -> DataFrame:
    """Metrics per (ticker, asof) that has a price, shares and a visible filing; not yet graded.

    Grading reads this several times (peer sizes, ranks, result), so callers store it first.
    """
    dates = cohort_dates(prices, horizon) if dates is None else dates
    fin = fundamentals_on_dates(t, dates, p)
    px = prices_on_dates(prices, dates, horizon)
    d = fin.join(px, ["ticker", "asof"])
    if fixed_shares is None:
        d = d.join(shares_on_dates(snaps, dates), ["ticker", "asof"])
    else:
        d = d.join(fixed_shares.where("shares_out > 0").select("ticker", "shares_out"), "ticker")
    d = (d.join(tracks.select("ticker", "track", "sector"), "ticker", "left")
          .withColumn("track", F.coalesce("track", F.lit(spec.GENERAL)))
          .withColumn("market_cap", F.col("price_asof") * F.col("shares_out"))
          .withColumnRenamed("period", "fin_period"))
    return metrics.ratios(d, p).withColumn("name", F.col("ticker"))


def cohort_columns(horizon: int = 63) -> list[str]:
    """Columns of cohorts that grading or a job on graded rows reads; the statement amounts behind the metrics are not among them."""
    metric = [m for ms in (*spec.CATEGORIES.values(), *(x for t in spec.TRACK_CATEGORIES.values() for x in t.values())) for m, _, _ in ms]
    return list(dict.fromkeys([
        "asof", "ticker", "name", "track", "sector", "fin_period", "rcept_dt", "market_cap", "price_date", "price_asof", "avg_tv",
        f"fwd_{horizon}", "pos_52w", "rsi_14", "growth_acceleration", "peg", "normalized_per", *spec.FACT_METRICS,
        *[m for m, _ in spec.RAW_SIGNALS], *metric]))


def scored_columns(horizon: int = 63) -> list[str]:
    """Columns of graded rows that a job reads from the stored table: a metric whose only use is its grade is not written again."""
    read = ["asof", "ticker", "name", "track", "sector", "peer", "fin_period", "rcept_dt", "market_cap", "price_date", "price_asof", "avg_tv",
            f"fwd_{horizon}", "pos_52w", "rsi_14", "growth_acceleration", "peg", *spec.FACT_METRICS, *[m for m, _ in spec.RAW_SIGNALS],
            *strategies.FEATURES, *[f"{c}_{x}" for c in spec.CATEGORY_NAMES for x in ("score", "grade", "n")], "quality_score", "coverage", "scores_present"]
    return list(dict.fromkeys(read))


def with_strategies(panel: DataFrame, t: DataFrame, dates: Column, p: Params) -> DataFrame:
    """Every panel row once, with gate features as of receipt and an array `_s` of (strategy, score, gate_fails).

    No row depends on a later price: members of the newest month are scored like all others. This is the form to store:
    the wide columns are written once per panel row, and `by_strategy` repeats only those that a reader asks for.
    """
    feats = strategies.gate_features(t).where("rcept_dt IS NOT NULL")
    cols = ["period", *strategies.FEATURES]
    one = feats.groupBy("ticker", "rcept_dt").agg(F.max_by(F.struct(*cols), "period").alias("_f"))
    asof = on_dates(one, "ticker", "rcept_dt", dates).select("ticker", "asof", *[
        F.col(f"_f.{x}").alias(x) for x in strategies.FEATURES])
    d = panel.join(asof, ["ticker", "asof"], "left")
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), weighted(w).alias("score"),
                              strategies.failed_gates(s, p, "panel").alias("gate_fails"))
                     for s, w in spec.STRATEGY_WEIGHTS.items()])
    return d.withColumn("_s", rows)


def by_strategy(d: DataFrame) -> DataFrame:
    """One row per strategy of `with_strategies`, with score and pass flag."""
    rest = [c for c in d.columns if c != "_s"]
    d = d.select(*rest, F.explode("_s").alias("_s")).select(*rest, "_s.*")
    return d.withColumn("pass", F.size("gate_fails") == 0)


def scored_rows(panel: DataFrame, t: DataFrame, dates: Column, p: Params) -> DataFrame:
    """Every panel row per strategy with gate features as of receipt, score and pass flag."""
    return by_strategy(with_strategies(panel, t, dates, p))


def gate_panel(scored: DataFrame, horizon: int = 63) -> DataFrame:
    """Research rows: scored rows that have a forward return, with the month's mean and the excess over it."""
    fwd = f"fwd_{horizon}"
    known = scored.where(F.col(fwd).isNotNull())
    # rows come once per strategy, so the mean of one strategy's rows is the mean over tickers
    mkt = known.where(F.col("strategy") == min(spec.STRATEGY_WEIGHTS)).groupBy("asof").agg(F.avg(fwd).alias("mkt"))
    d = known.where("score IS NOT NULL").join(F.broadcast(mkt), "asof")  # one row per month
    return d.withColumn("excess", F.col(fwd) - F.col("mkt"))


def research_columns(horizon: int = 63) -> list[str]:
    """Columns of research rows that the jobs on prepared rows read; the ranks move no others."""
    return ["asof", "ticker", "strategy", "name", "score", "pass", "gate_fails", "rcept_dt", "market_cap", "price_date", "price_asof",
            "avg_tv", "per", "pbr", f"fwd_{horizon}", "mkt", "excess", *strategies.FEATURES, *[f"{c}_score" for c in spec.CATEGORY_NAMES]]


def prepare(gp: DataFrame, p: Params, horizon: int = 63) -> DataFrame:
    """Adds cap rank, realistic-universe flag, two benchmarks and excess over each."""
    fwd = f"fwd_{horizon}"
    d = min_rank_desc(gp, ["asof", "strategy"], "market_cap", "cap_rank")
    inside = ((F.col("market_cap") >= p.min_market_cap)
              & (F.coalesce("avg_tv", F.lit(0.0)) >= p.min_avg_trading_value)
              & (F.col("cap_rank") <= p.universe_size))
    d = d.withColumn("in_universe", F.coalesce(inside, F.lit(False)))
    # one row per (month, strategy)
    bench = d.where("in_universe").groupBy("asof", "strategy").agg(
        F.avg(fwd).alias("b_univ"),
        (F.sum(F.col(fwd) * F.col("market_cap")) / F.sum("market_cap")).alias("b_cap"))
    return (d.join(F.broadcast(bench), ["asof", "strategy"], "left")
            .withColumn("exc_univ", F.col(fwd) - F.col("b_univ"))
            .withColumn("exc_cap", F.col(fwd) - F.col("b_cap")))


def latest_metrics(asof, members: DataFrame, shares: DataFrame, tracks: DataFrame, t: DataFrame,
                   prices: DataFrame, p: Params) -> DataFrame:
    """Metrics of the current members at one date (inner on filings, shares and tracks)."""
    asof = F.to_date(F.lit(asof)) if isinstance(asof, str) else asof
    seen = t.where(F.col("rcept_dt") <= asof)
    feats = metrics.history_features(seen, p, ["ticker"])
    rest = [x for x in feats.columns if x != "ticker"]
    last = (feats.groupBy("ticker").agg(F.max_by(F.struct(*rest), "period").alias("_r"))
            .select("ticker", "_r.*"))
    sh = shares.select("ticker", F.col("market_cap_total").alias("market_cap"),
                       F.col("shares_outstanding").alias("shares_out"), "treasury_ratio")
    tr = tracks.select("ticker", "track", "sector", "stability_distorted")
    d = members.join(last, "ticker").join(sh, "ticker").join(tr, "ticker")
    d = metrics.mask_distorted(metrics.ratios(d.withColumn("_ocf", F.col("ocf_ttm")), p))
    streak = flags.loss_streak(seen.where("quarter = 4"))
    d = d.join(streak, "ticker", "left").fillna(0, subset=["loss_streak"])
    d = d.withColumn("loss_flag", flags.loss_flag(p, ocf="_ocf")).drop("_ocf")
    d = flags.with_reliability(d, flags.restructure_events(seen, p))
    mom = momentum.features(prices.where(F.col("date") <= asof))
    cols = ["date", "close_adj", *momentum.COLUMNS]
    mom = (mom.groupBy("ticker").agg(F.max_by(F.struct(*cols), "date").alias("_m"))
           .select("ticker", F.col("_m.close_adj").alias("price_asof"),
                   *[F.col(f"_m.{x}").alias(x) for x in momentum.COLUMNS]))
    return (d.join(mom, "ticker", "left").withColumn("asof", asof)
            .withColumnRenamed("year", "fin_year").withColumnRenamed("quarter", "fin_quarter"))
