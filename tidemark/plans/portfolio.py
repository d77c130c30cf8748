"""Monthly top-N performance and its summaries.

Stock-level work is aggregated to (run, month) first; everything ordered in time afterwards is a
window over months of one run, which the calendar bounds.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import t_stat, two_sided_p, weighted
from tidemark.operators.asof import on_dates
from tidemark.operators.ranks import average_rank_pct, top_n
from tidemark.params import Params


def monthly_returns(prices: DataFrame, asofs: Column, p: Params, haircut_pct: float = 0.0) -> DataFrame:
    """(asof, ticker, ret_m): return to the next month date; no row across a gap or a halt."""
    px = prices.where("close_adj IS NOT NULL").select("ticker", "date", "close_adj")
    d = on_dates(px, "ticker", "date", asofs)
    w = W.partitionBy("ticker").orderBy("asof")
    d = d.withColumn("_d1", F.lead("date").over(w)).withColumn("_c1", F.lead("close_adj").over(w))
    ok = (F.col("_d1") > F.col("date")) & (F.datediff("_d1", "date") <= p.return_gap_days)
    out = d.where(ok).select("asof", "ticker", ((F.col("_c1") / F.col("close_adj") - 1) * 100.0).alias("ret_m"))
    if not haircut_pct:
        return out
    dead = delisted(prices, p).select("ticker", F.lit(True).alias("_dead"))
    last = out.groupBy("ticker").agg(F.max("asof").alias("_last"))
    d = out.join(last.join(dead, "ticker"), "ticker", "left")
    cut = ((1 + F.col("ret_m") / 100.0) * (1 + haircut_pct / 100.0) - 1) * 100.0
    return d.select("asof", "ticker", F.when(F.col("asof") == F.col("_last"), cut)
                    .otherwise(F.col("ret_m")).alias("ret_m"))


def delisted(prices: DataFrame, p: Params) -> DataFrame:
    """Tickers whose prices end long before the end of the data, with their last day."""
    end = prices.agg(F.max("date")).scalar()
    return (prices.groupBy("ticker").agg(F.max("date").alias("last_date"))
            .where(F.datediff(end, F.col("last_date")) > p.delist_gap_days))


def legs(picks: DataFrame, rets: DataFrame) -> DataFrame:
    """Held positions: picks that have a return for the month."""
    return picks.join(rets.where("ret_m IS NOT NULL"), ["asof", "ticker"])


def simulate(picks: DataFrame, rets: DataFrame, asofs: Column, runs: DataFrame, run: list[str],
             cost_pct: float) -> DataFrame:
    """Per (run, month): n, gross, turnover, cost-net return and equity.

    A month without picks holds cash and empties the book; a month whose picks have no return
    holds cash and carries the book. `runs` lists the runs (a handful of rows); `picks` has at
    most N rows per run and month.
    """
    held = legs(picks, rets).groupBy(*run, "asof").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret_m").alias("gross"), F.collect_set("ticker").alias("members"))
    chosen = picks.groupBy(*run, "asof").agg(F.count(F.lit(1)).alias("_picked"))
    frame = runs.select(*run, F.explode(asofs).alias("asof"))
    d = frame.join(chosen, [*run, "asof"], "left").join(held, [*run, "asof"], "left")
    empty = F.array().cast("array<string>")
    state = F.when(F.col("_picked").isNull(), empty).otherwise(F.col("members"))
    w = W.partitionBy(*run).orderBy("asof")
    prev = F.last(state, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_prev", F.coalesce(prev, empty))
    bought = F.size(F.array_except("members", "_prev"))
    sold = F.size(F.array_except("_prev", "members"))
    n = F.col("n")
    d = d.withColumns({"turnover": F.when(n > 0, bought / n).otherwise(0.0),
                       "_fee": F.when(n > 0, cost_pct * (bought + sold) / n).otherwise(0.0),
                       "gross": F.coalesce("gross", F.lit(0.0))})
    d = d.withColumns({"ret": F.col("gross") - F.col("_fee"), "n": F.coalesce("n", F.lit(0))})
    run_all = w.rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("equity", F.product(1 + F.col("ret") / 100.0).over(run_all)).select(
        *run, "asof", "n", "gross", "turnover", "ret", "equity")


def bench_monthly(prepared: DataFrame, rets: DataFrame, asofs: Column) -> DataFrame:
    """Equal- and cap-weighted monthly return of the universe; months without any are zero."""
    members = prepared.where("in_universe").groupBy("asof", "ticker", "market_cap").agg(F.lit(1).alias("_1"))
    j = members.join(rets, ["asof", "ticker"])
    b = j.groupBy("asof").agg(F.avg("ret_m").alias("eq"),
                              (F.sum(F.col("ret_m") * F.col("market_cap")) / F.sum("market_cap")).alias("cw"))
    one = prepared.sparkSession.range(1).select(F.explode(asofs).alias("asof"))
    return one.join(b, "asof", "left").select("asof", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("eq", "cw")])


def _with_drawdown(m: DataFrame, part: list[str], equity: str) -> DataFrame:
    w = W.partitionBy(*part).orderBy("asof").rowsBetween(W.unboundedPreceding, 0)
    return m.withColumn("_dd", F.col(equity) / F.max(equity).over(w) - 1)


def summary(monthly: DataFrame, bench: DataFrame, run: list[str], years: bool = False) -> DataFrame:
    """Total, CAGR, maximum drawdown, win rate, excess over the equal-weight bench, t and p."""
    d = monthly.join(F.broadcast(bench), "asof")  # one bench row per month
    part = [*run, "year"] if years else run
    d = d.withColumn("year", F.year("asof"))
    w = W.partitionBy(*part).orderBy("asof").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_eq", F.product(1 + F.col("ret") / 100.0).over(w))
    d = _with_drawdown(d, part, "_eq")
    exc = F.col("ret") - F.col("eq")
    g = d.groupBy(*part).agg(
        F.count(F.lit(1)).alias("months"),
        ((F.product(1 + F.col("ret") / 100.0) - 1) * 100.0).alias("total"),
        ((F.product(1 + F.col("gross") / 100.0) - 1) * 100.0).alias("gross_total"),
        ((F.product(1 + F.col("eq") / 100.0) - 1) * 100.0).alias("bench_total"),
        (F.min("_dd") * 100.0).alias("mdd"),
        (F.avg((F.col("ret") > 0).cast("double")) * 100.0).alias("win_rate"),
        F.avg("turnover").alias("turnover"), F.avg(exc).alias("excess"),
        F.stddev_samp(exc).alias("_sd"))
    growth = F.pow(1 + F.col("total") / 100.0, 12.0 / F.col("months")) - 1
    g = g.withColumn("cagr", F.when(F.col("total") > -100, growth * 100.0))
    g = g.withColumn("t", t_stat(F.col("excess"), F.col("_sd"), F.col("months")))
    return g.withColumn("p", two_sided_p(F.col("t"))).drop("_sd")


def trade_stats(held: DataFrame, run: list[str]) -> DataFrame:
    win, ret = F.col("ret_m") > 0, F.col("ret_m")
    g = held.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(win.cast("double")) * 100.0).alias("win_rate"),
        F.avg(F.when(win, ret)).alias("avg_win"), F.avg(F.when(~win, ret)).alias("avg_loss"))
    loss = F.nullif("avg_loss", F.lit(0.0))
    spread = F.nullif(F.col("avg_win") - F.col("avg_loss"), F.lit(0.0))
    return g.withColumn("payoff", F.abs(F.col("avg_win") / loss)).withColumn(
        "breakeven", -F.col("avg_loss") / spread * 100.0)


def concentration(held: DataFrame, run: list[str], name: str = "ticker", drops=(1, 3, 5)) -> DataFrame:
    """Mean return per position without the top contributing names."""
    by = held.groupBy(*run, name).agg(F.sum("ret_m").alias("contrib"), F.count(F.lit(1)).alias("n"))
    by = by.withColumn("contrib", F.round("contrib", 8))
    allrows = by.groupBy(*run).agg(F.sum("contrib").alias("_s"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("names"))
    top = top_n(by, run, "contrib", max(drops), tie=name)
    cut = top.groupBy(*run).agg(*[x for k in drops for x in (
        F.sum(F.when(F.col("rank") <= k, F.col("contrib"))).alias(f"_s{k}"),
        F.sum(F.when(F.col("rank") <= k, F.col("n"))).alias(f"_n{k}"))])
    d = allrows.join(cut, run)
    rest = lambda k: F.when(F.col("_n") > F.col(f"_n{k}"),
                            (F.col("_s") - F.col(f"_s{k}")) / F.nullif(F.col("_n") - F.col(f"_n{k}"), F.lit(0)))
    return d.select(*run, F.col("_n").alias("n"), "names", (F.col("_s") / F.col("_n")).alias("base"),
                    *[rest(k).alias(f"without_{k}") for k in drops])


def factor_signals(d: DataFrame) -> DataFrame:
    """Ten ranking signals in long form (one row per stock, month and signal)."""
    pos = lambda x: F.when(F.col(x) > 0, F.col(x))
    d = d.withColumn("_pbr", pos("pbr")).withColumn("_per", pos("per"))
    d = average_rank_pct(d, ["asof"], "_pbr", "_pbr_pct")
    d = average_rank_pct(d, ["asof"], "_per", "_per_pct")
    sig = {"pbr": 100.0 - F.col("_pbr_pct"), "per": 100.0 - F.col("_per_pct")}
    sig.update({c: F.col(f"{c}_score") for c in ("valuation", "profitability", "growth", "stability")})
    for s, w in spec.STRATEGY_WEIGHTS.items():
        sig[f"{s}_mix"] = weighted(w)
        sig[f"{s}_mix_no_valuation"] = weighted({k: v for k, v in w.items() if k != "valuation"})
    arr = F.array(*[F.struct(F.lit(k).alias("signal"), F.round(v, 8).alias("score")) for k, v in sig.items()])
    return (d.select("asof", "ticker", F.explode(arr).alias("r")).select("asof", "ticker", "r.*")
             .where("score IS NOT NULL"))


def race_picks(signals: DataFrame, tops=(3, 5, 10, 20)) -> DataFrame:
    """Picks of every (signal, top) run from one ranking."""
    best = top_n(signals, ["signal", "asof"], "score", max(tops))
    member = F.array_compact(F.array(*[F.when(F.col("rank") <= t, t) for t in tops]))
    return best.withColumn("top", F.explode(member))


def race_eras(monthly: DataFrame, bench: DataFrame, run: list[str], split_year: int) -> DataFrame:
    """Total return before and from a year on, against the bench of the same months."""
    d = monthly.join(F.broadcast(bench), "asof")  # one bench row per month
    early = F.year("asof") < split_year

    def total(x: str, cond: Column) -> Column:
        return (F.coalesce(F.product(F.when(cond, 1 + F.col(x) / 100.0)), F.lit(1.0)) - 1) * 100.0

    g = d.groupBy(*run).agg(total("ret", early).alias("early"), total("ret", ~early).alias("late"),
                            total("eq", early).alias("bench_early"), total("eq", ~early).alias("bench_late"))
    e, l = F.col("early") > F.col("bench_early"), F.col("late") > F.col("bench_late")
    return g.withColumn("beats", F.when(e & l, "both").when(e, "early").when(l, "late").otherwise("none"))


def signal_turnover(picks: DataFrame, asofs: Column, runs: DataFrame, run: list[str]) -> DataFrame:
    """How much of a top list changes from month to month; an empty month keeps the last list."""
    sets = picks.groupBy(*run, "asof").agg(F.collect_set("ticker").alias("_cur"))
    d = runs.select(*run, F.explode(asofs).alias("asof")).join(sets, [*run, "asof"], "left")
    w = W.partitionBy(*run).orderBy("asof").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_prev", F.last("_cur", ignorenulls=True).over(w)).where("_prev IS NOT NULL AND _cur IS NOT NULL")
    kept = F.size(F.array_intersect("_cur", "_prev")) / F.size("_cur")
    fresh = F.size(F.array_except("_cur", "_prev"))
    ever = picks.groupBy(*run).agg(F.countDistinct("ticker").alias("names_ever"))
    g = d.groupBy(*run).agg((F.avg(kept) * 100.0).alias("kept_pct"), F.avg(fresh).alias("new_per_month"))
    return g.withColumn("new_per_year", F.col("new_per_month") * 12.0).join(ever, run)


def unit_nav(bench: DataFrame, contribution: float, initial: float, nav0: float = 1000.0,
             ret: str = "eq") -> DataFrame:
    """Value of a unitised account that buys the benchmark every month and never sells."""
    months = bench.withColumn("_k", F.lit(1))
    w = W.partitionBy("_k").orderBy("asof")  # one row per month
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = months.withColumn("nav", nav0 * F.product(1 + F.col(ret) / 100.0).over(upto))
    d = d.withColumn("_before", F.coalesce(F.lag("nav").over(w), F.lit(nav0)))
    d = d.withColumn("paid", contribution + F.when(F.row_number().over(w) == 1, initial).otherwise(0.0))
    d = d.withColumn("units", F.sum(F.col("paid") / F.col("_before")).over(upto))
    d = d.withColumn("paid_total", F.sum("paid").over(upto)).withColumn("value", F.col("units") * F.col("nav"))
    return _with_drawdown(d, ["_k"], "nav").select("asof", "nav", "units", "paid_total", "value",
                                                   (F.col("_dd") * 100.0).alias("drawdown"))


def first_touch(entries: DataFrame, prices: DataFrame, stop_pct: float, target_pct: float) -> DataFrame:
    """First later day on which an entry reaches its stop or its target.

    Month lows and highs of a ticker (one array entry per month) point at the month of the first
    touch, so each entry reads the prices of at most two months.
    """
    px = prices.select("ticker", "date", "close_adj").withColumn("_m", F.trunc("date", "month"))
    months = px.groupBy("ticker", "_m").agg(F.min("close_adj").alias("lo"), F.max("close_adj").alias("hi"))
    months = months.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_m").alias("m"), "lo", "hi"))).alias("_months"))
    stop, target = 1 - stop_pct / 100.0, 1 + target_pct / 100.0
    d = entries.join(months, "ticker", "left").withColumn("_em", F.trunc("entry_date", "month"))
    price = F.col("entry_price")
    touch = F.filter("_months", lambda x: (x["m"] > F.col("_em"))
                     & ((x["lo"] / price <= stop) | (x["hi"] / price >= target)))
    cand = F.array_compact(F.array(F.col("_em"), F.get(touch, F.lit(0))["m"]))
    keys = ["ticker", "entry_date"]
    hits = (d.select(*keys, "entry_price", F.explode(cand).alias("_m")).join(px, ["ticker", "_m"])
            .withColumn("_chg", F.col("close_adj") / F.col("entry_price"))
            .where((F.col("date") > F.col("entry_date")) & ((F.col("_chg") <= stop) | (F.col("_chg") >= target)))
            .groupBy(*keys).agg(F.min(F.struct("date", "close_adj", "_chg")).alias("_h")))
    out = entries.join(hits, keys, "left")
    return out.select(*entries.columns, F.col("_h.date").alias("exit_date"), F.col("_h.close_adj").alias("exit_price"),
                      F.when(F.col("_h").isNull(), None).when(F.col("_h._chg") <= stop, "stop")
                      .otherwise("target").alias("reason"))


def panel_diff(old: DataFrame, new: DataFrame, rets: DataFrame, n: int, cost_pct: float) -> DataFrame:
    """Two panels on the months that both have: months with other picks, mean replacements, and the performance of both.

    `old` and `new` are prepared panels. A month without picks on one side counts as an empty list.
    """
    run, spark = ["strategy", "gate"], new.sparkSession
    common = old.select("asof").intersect(new.select("asof"))
    asofs = common.agg(F.sort_array(F.collect_set("asof")).alias("a")).scalar()  # one entry per month
    picks = [gate_runs(d.join(common, "asof", "left_semi"), n) for d in (old, new)]
    a, b = (p.groupBy(*run, "asof").agg(F.collect_set("ticker").alias(c)) for p, c in zip(picks, ("_a", "_b")))
    frame = gate_run_list(spark).withColumn("asof", F.explode(asofs))
    d = frame.join(a, [*run, "asof"], "left").join(b, [*run, "asof"], "left")
    empty = F.array().cast("array<string>")
    x, y = F.coalesce("_a", empty), F.coalesce("_b", empty)
    gone, come = F.size(F.array_except(x, y)), F.size(F.array_except(y, x))
    out = d.groupBy(*run).agg(F.count(F.lit(1)).alias("months"), F.sum(((gone + come) > 0).cast("int")).alias("changed_months"), F.avg(come).alias("avg_replaced"))
    for name, panel, chosen in zip(("old", "new"), (old, new), picks):
        sim = simulate(chosen, rets, asofs, gate_run_list(spark), run, cost_pct)
        s = summary(sim, bench_monthly(panel, rets, asofs), run)
        out = out.join(s.select(*run, *[F.col(c).alias(f"{name}_{c}") for c in ("total", "excess", "mdd")]), run, "left")
    return out


def gate_runs(prepared: DataFrame, n: int) -> DataFrame:
    """Top-N picks in the realistic universe for each (strategy, gate on/off)."""
    u = prepared.where("in_universe").select("asof", "ticker", "name", "strategy", "score", "pass")
    modes = F.array_compact(F.array(F.lit("off"), F.when(F.col("pass"), F.lit("on"))))
    return top_n(u.withColumn("gate", F.explode(modes)), ["strategy", "gate", "asof"], "score", n)


def gate_run_list(spark) -> DataFrame:
    strategies = F.array(*[F.lit(s) for s in spec.STRATEGY_WEIGHTS])
    return (spark.range(1).select(F.explode(strategies).alias("strategy"))
            .select("strategy", F.explode(F.array(F.lit("on"), F.lit("off"))).alias("gate")))
