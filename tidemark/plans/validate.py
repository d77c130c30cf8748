"""Signal validation: rank correlations, quantile tables, gate effects, market regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import finite, rank_correlation, t_stat, two_sided_p, weighted
from tidemark.operators.ranks import (exact_quantiles, quantile_bucket, ranked, row_positions,
                                      row_ranks, top_n)
from tidemark.params import Params
from tidemark.plans.strategies import gate_conditions


def signal_rows(d: DataFrame, signals: dict[str, Column], fwd: str, keep: list[str] | None = None) -> DataFrame:
    """Long (asof, ticker, signal, x, y) rows with both values present."""
    arr = F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("x")) for k, v in signals.items()])
    return (d.where(F.col(fwd).isNotNull())
             .select("asof", "ticker", *(keep or []), F.col(fwd).alias("y"), F.explode(arr).alias("r"))
             .select("asof", "ticker", *(keep or []), "y", "r.*").where("x IS NOT NULL"))


def category_signals() -> dict[str, Column]:
    return {c: F.col(f"{c}_score") for c in spec.CATEGORY_NAMES}


def raw_signals() -> dict[str, Column]:
    return {m: F.col(m) * float(s) for m, s in spec.RAW_SIGNALS}


def mix_signals() -> dict[str, Column]:
    return {f"{s}_mix": weighted(w) for s, w in spec.STRATEGY_WEIGHTS.items()}


def ic_by_month(rows: DataFrame, p: Params) -> DataFrame:
    """Spearman correlation per (signal, month): Pearson of average ranks of complete pairs.

    A pair moves to its rank by x and from there to its rank by y, as three numbers beside its group; values are not counted first.
    """
    keys = ["signal", "asof"]
    # as a number a signal is shorter than its name; a month has at most as many pairs of a signal as it has rows of all signals
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    group = W.orderBy(*keys)  # one row per (signal, month)
    sizes = sizes.withColumn("_group", F.row_number().over(group))
    d = rows.select(*keys, "x", "y").join(F.broadcast(sizes), keys).select("_group", "_size", "x", "y")
    twice = F.col("n_below") * 2 + F.col("n_equal") + 1
    pairs = d.where(ranked(d, "x"))
    d = row_ranks(d, ["_group"], "x", "_size").select("_group", "_size", "y", (twice / 2.0).alias("_rx"))
    d = row_ranks(d, ["_group"], "y", "_size", counted=pairs).select("_group", "_rx", (twice / 2.0).alias("_ry"))
    g = d.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), rank_correlation("_rx", "_ry").alias("ic"))
    g = g.where(F.col("n") >= p.ic_min_pairs).withColumn("ic", finite("ic")).where("ic IS NOT NULL")
    return g.join(F.broadcast(sizes), "_group").select(*keys, "n", "ic")


def ic_summary(monthly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median, positive share and months per signal, with a verbal strength."""
    by = by or ["signal"]
    g = monthly.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"), F.percentile("ic", 0.5).alias("median_ic"),  # one value per month
        (F.avg((F.col("ic") > 0).cast("double")) * 100.0).alias("positive_pct"), F.count(F.lit(1)).alias("months"))
    m, a = F.col("mean_ic"), F.abs("mean_ic")
    return g.withColumn("verdict", F.when(a < 0.02, "none").when((m < 0) & (a >= 0.03), "reversed")
                        .when(m < 0, "weakly reversed").when(a >= 0.10, "strong").when(a >= 0.05, "useful")
                        .otherwise("weak"))


def ic_halves(monthly: DataFrame, middle: Column) -> DataFrame:
    """Mean rank correlation before and from a middle month, and whether the signs agree."""
    g = monthly.groupBy("signal").agg(F.avg(F.when(F.col("asof") < middle, F.col("ic"))).alias("first_half"),
                                      F.avg(F.when(F.col("asof") >= middle, F.col("ic"))).alias("second_half"))
    g = g.where("first_half IS NOT NULL AND second_half IS NOT NULL")
    return g.withColumn("stable", F.col("first_half") * F.col("second_half") > 0)


def quantile_returns(rows: DataFrame, k: int = 5, min_rows: int = 500) -> DataFrame:
    """Mean forward return per quantile bucket of each month; small signals are skipped."""
    d = row_positions(rows, ["signal", "asof"], "x", "ticker", "_pos", keep_n="_n")
    d = d.withColumn("q", quantile_bucket("_pos", "_n", k))
    g = d.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.when(F.col("q") == i, F.col("y"))).alias(f"q{i}") for i in range(1, k + 1)])
    return (g.where(F.col("n") >= min_rows).withColumn("spread", F.col(f"q{k}") - F.col("q1"))
             .where("spread IS NOT NULL"))


def clustered(d: DataFrame, by: list[str], ret: str, excess: str) -> DataFrame:
    """Group means with a t statistic of the monthly means (rows of a month are not independent)."""
    month = d.groupBy(*by, "asof").agg(F.avg(excess).alias("_m"))
    t = month.groupBy(*by).agg(F.count("_m").alias("months"), F.avg("_m").alias("_mean"), F.stddev_samp("_m").alias("_sd"))
    t = t.withColumn("t", t_stat(F.col("_mean"), F.col("_sd"), F.col("months")))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_ret"), F.avg(excess).alias("mean_excess"),
                           (F.avg((F.col(ret) > 0).cast("double")) * 100.0).alias("win_rate"))
    return g.join(t.select(*by, "months", "t"), by).withColumn("p", two_sided_p(F.col("t")))


def gate_effect(gp: DataFrame, fwd: str = "fwd_63") -> DataFrame:
    """Passed against failed rows per strategy."""
    d = gp.withColumn("group", F.when(F.col("pass"), "pass").otherwise("fail"))
    return clustered(d, ["strategy", "group"], fwd, "excess")


def gate_topn(gp: DataFrame, n: int, fwd: str = "fwd_63") -> DataFrame:
    modes = F.array_compact(F.array(F.lit("off"), F.when(F.col("pass"), F.lit("on"))))
    d = top_n(gp.withColumn("gate", F.explode(modes)), ["strategy", "gate", "asof"], "score", n)
    return clustered(d, ["strategy", "gate"], fwd, "excess")


def gate_ablation(gp: DataFrame, p: Params, n: int) -> DataFrame:
    """Top-N excess with all gates and with each single gate left out, with pass rates.

    One row is repeated at most once per gate, then limited to N per month before the shuffle.
    """
    names = {s: list(gate_conditions(s, p, "panel")) for s in spec.STRATEGY_WEIGHTS}

    def variants(s: str) -> Column:
        one = [F.when(F.size("gate_fails") == 0, F.lit("none"))]
        one += [F.when(F.size(F.array_remove("gate_fails", g)) == 0, F.lit(g)) for g in names[s]]
        return F.array_compact(F.array(*one))

    first, second = list(spec.STRATEGY_WEIGHTS)
    arr = F.when(F.col("strategy") == first, variants(first)).otherwise(variants(second))
    d = gp.select("strategy", "asof", "ticker", "score", "excess", F.explode(arr).alias("skipped"))
    rows = gp.groupBy("strategy").agg(F.count(F.lit(1)).alias("_all"))
    rate = d.groupBy("strategy", "skipped").agg(F.count(F.lit(1)).alias("_pass")).join(F.broadcast(rows), "strategy")  # one row per strategy
    picks = top_n(d, ["strategy", "skipped", "asof"], "score", n)
    g = picks.groupBy("strategy", "skipped").agg(F.avg("excess").alias("mean_excess"), F.count(F.lit(1)).alias("n"))
    full = g.where("skipped = 'none'").select("strategy", F.col("mean_excess").alias("_full"))
    return (g.join(rate, ["strategy", "skipped"]).join(F.broadcast(full), "strategy", "left")
            .select("strategy", "skipped", "n", "mean_excess", (F.col("mean_excess") - F.col("_full")).alias("change"),
                    (F.col("_pass") / F.col("_all") * 100.0).alias("pass_rate")))


def _month_rank(x: str, part: list[str]) -> Column:
    """Average rank inside a month-level series (at most one row per month)."""
    w = W.partitionBy(*part).orderBy(x)
    ties = F.count(F.lit(1)).over(W.partitionBy(*part, x))
    return F.rank().over(w) + (ties - 1) / 2.0


def series_link(series: DataFrame, by: list[str], x: str, y: str, lo: float = 1 / 3, hi: float = 2 / 3,
                min_n: int = 0) -> DataFrame:
    """Rank correlation of two month-level series, its t and p, and mean y in the outer thirds of x.

    `by` groups hold one row per month.
    """
    d = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("_rx", _month_rank(x, by)).withColumn("_ry", _month_rank(y, by))
    edge = d.groupBy(*by).agg(F.percentile(x, F.array(F.lit(lo), F.lit(hi))).alias("_e"))
    d = d.join(edge, by)
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"), finite(rank_correlation("_rx", "_ry")).alias("_r"),
        F.avg(F.when(F.col(x) <= F.col("_e")[0], F.col(y))).alias("low_third"),
        F.avg(F.when(F.col(x) >= F.col("_e")[1], F.col(y))).alias("high_third"))
    g = g.withColumn("rank_corr", F.when(F.col("months") > min_n, F.col("_r"))).drop("_r")
    r, n = F.col("rank_corr"), F.col("months")
    t = F.when(n > 2, r * F.sqrt((n - 2) / F.greatest(F.lit(1e-9), 1 - r * r)))
    return g.withColumn("t", t).withColumn("p", two_sided_p(F.col("t")))


def pass_rates(gp: DataFrame) -> DataFrame:
    """Monthly pass rate per strategy with the market return that followed."""
    return gp.groupBy("strategy", "asof").agg(
        (F.avg(F.col("pass").cast("double")) * 100.0).alias("rate"), F.first("mkt").alias("mkt"),
        F.sum(F.col("pass").cast("int")).alias("n_pass"))


def pass_rate_bins(rates: DataFrame) -> DataFrame:
    """Months cut at the 20/40/60/80 percent points of the pass rate (right-closed bins)."""
    e = rates.groupBy("strategy").agg(F.percentile("rate", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).alias("_e"))
    d = rates.join(e, "strategy")
    b = F.lit(5)
    for i in (3, 2, 1, 0):
        b = F.when(F.col("rate") <= F.col("_e")[i], i + 1).otherwise(b)
    return d.withColumn("bin", b).groupBy("strategy", "bin").agg(
        F.count(F.lit(1)).alias("months"), F.min("rate").alias("lo"), F.max("rate").alias("hi"), F.avg("mkt").alias("mkt"))


def by_year(gp: DataFrame, n: int) -> DataFrame:
    """Per strategy and year: top-N excess with gates on and off, mean passing names a month."""
    modes = F.array_compact(F.array(F.lit("off"), F.when(F.col("pass"), F.lit("on"))))
    picks = top_n(gp.withColumn("gate", F.explode(modes)), ["strategy", "gate", "asof"], "score", n)
    g = picks.groupBy("strategy", F.year("asof").alias("year")).agg(
        F.avg(F.when(F.col("gate") == "on", F.col("excess"))).alias("on_excess"),
        F.avg(F.when(F.col("gate") == "off", F.col("excess"))).alias("off_excess"))
    passing = (gp.groupBy("strategy", "asof").agg(F.sum(F.col("pass").cast("int")).alias("_n"))
               .groupBy("strategy", F.year("asof").alias("year")).agg(F.avg("_n").alias("passing")))
    return g.join(passing, ["strategy", "year"]).withColumn("diff", F.col("on_excess") - F.col("off_excess"))


def by_cap_quintile(gp: DataFrame, fwd: str = "fwd_63") -> DataFrame:
    d = row_positions(gp.select("strategy", "asof", "ticker", "market_cap", "excess", fwd),
                      ["strategy", "asof"], "market_cap", "ticker", "_pos", keep_n="_n")
    d = d.withColumn("q", quantile_bucket("_pos", "_n", 5))
    med = exact_quantiles(d, ["strategy", "q"], "market_cap", {"median_cap": 0.5})
    g = d.groupBy("strategy", "q").agg(
        F.avg("excess").alias("mean_excess"), (F.avg((F.col(fwd) > 0).cast("double")) * 100.0).alias("win_rate"),
        F.count(F.lit(1)).alias("n"))
    return g.join(med, ["strategy", "q"])


def by_liquidity(gp: DataFrame, floors: list[float], n: int, fwd: str = "fwd_63") -> DataFrame:
    ok = F.array_compact(F.array(*[F.when(F.coalesce("avg_tv", F.lit(0.0)) >= f, F.lit(float(f))) for f in floors]))
    d = top_n(gp.withColumn("floor", F.explode(ok)), ["strategy", "floor", "asof"], "score", n)
    return clustered(d, ["strategy", "floor"], fwd, "excess")


def regimes(prepared: DataFrame) -> DataFrame:
    """Month label per strategy: market terciles of the universe return (right-closed)."""
    m = prepared.where("in_universe").groupBy("strategy", "asof").agg(F.first("b_univ").alias("b_univ"))
    e = m.groupBy("strategy").agg(F.percentile("b_univ", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_e"))
    d = m.join(e, "strategy")
    return d.select("strategy", "asof", F.when(F.col("b_univ") <= F.col("_e")[0], "down")
                    .when(F.col("b_univ") <= F.col("_e")[1], "flat").otherwise("up").alias("regime"))


def by_regime(prepared: DataFrame, n: int) -> DataFrame:
    """Gate on against gate off in falling, flat and rising markets, inside the universe."""
    # one row per (strategy, month)
    d = prepared.where("in_universe").join(F.broadcast(regimes(prepared)), ["strategy", "asof"])
    modes = F.array_compact(F.array(F.lit("off"), F.when(F.col("pass"), F.lit("on"))))
    picks = top_n(d.withColumn("gate", F.explode(modes)), ["strategy", "gate", "asof"], "score", n)
    g = picks.groupBy("strategy", "regime").agg(
        F.avg(F.when(F.col("gate") == "on", F.col("exc_univ"))).alias("on_excess"),
        F.avg(F.when(F.col("gate") == "off", F.col("exc_univ"))).alias("off_excess"))
    base = d.groupBy("strategy", "regime").agg(F.avg("b_univ").alias("universe"), F.countDistinct("asof").alias("months"))
    return g.join(base, ["strategy", "regime"])


def predictors(prepared: DataFrame) -> DataFrame:
    """Month series that may lead the market: pass rates and the revenue diffusion share."""
    u = prepared.where("in_universe")
    m = u.groupBy("asof").agg(
        F.avg(F.when(F.col("strategy") == "growth", F.col("pass").cast("double"))).alias("growth_pass"),
        F.avg(F.when(F.col("strategy") == "growth", F.coalesce(F.col("rev_growth_q_of_4") >= 3, F.lit(False)).cast("double"))).alias("diffusion"),
        F.avg(F.when(F.col("strategy") == "value", F.col("pass").cast("double"))).alias("value_pass"),
        F.max(F.when(F.col("strategy") == "growth", F.col("b_univ"))).alias("market"))
    arr = F.array(*[F.struct(F.lit(k).alias("predictor"), F.col(k).alias("x")) for k in ("growth_pass", "diffusion", "value_pass")])
    return m.select("asof", "market", F.explode(arr).alias("r")).select("asof", "market", "r.*")


def halves(series: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """First and second half of a month series (by position) as an extra group column."""
    d = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    rn = F.row_number().over(W.partitionBy(*by).orderBy("asof"))
    return d.withColumn("half", F.when(rn <= F.floor(n / 2), "first").otherwise("second"))
