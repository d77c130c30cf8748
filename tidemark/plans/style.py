"""Style spread between value and growth baskets, market-breadth deferral and verdicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.operators.asof import previous_versions, slot_of
from tidemark.operators.ranks import row_positions
from tidemark.params import Params
from tidemark.plans.momentum import overheated
from tidemark.plans.strategies import penalties

STYLES = {"value": "valuation_score", "growth": "growth_score"}


# ---- style spread ---------------------------------------------------------------------------
def baskets(panel: DataFrame, p: Params) -> DataFrame:
    """(asof, style, ticker): best fifth of all rows by the style's score, at least five names."""
    sizes = panel.groupBy("asof").agg(F.count(F.lit(1)).alias("_rows"))
    out = []
    for style, score in STYLES.items():
        d = row_positions(panel.select("asof", "ticker", score), ["asof"], score, "ticker", "_pos",
                          descending=True, keep_n="_scored")
        d = d.join(F.broadcast(sizes), "asof")  # one row per month
        n = F.greatest(F.lit(p.style_min), F.floor(F.col("_rows") * p.style_top_pct))
        out.append(d.where((F.col("_scored") >= p.style_min_scored) & (F.col("_pos") <= n))
                    .select("asof", F.lit(style).alias("style"), "ticker"))
    return reduce(lambda a, b: a.unionByName(b), out)


def interval_returns(prices: DataFrame, asofs: Column, min_rows: int = 5) -> DataFrame:
    """(ticker, asof, ret): last over first close inside [asof, next asof], both days included."""
    # `_k` counts the dates up to the day
    slot = slot_of(prices, "date", asofs)
    d = prices.select("ticker", "date", "close_adj").withColumn("_cal", asofs).withColumn("_slot", slot)
    upto = F.col("_slot") + F.when(F.get("_cal", F.col("_slot")) == F.col("date"), 1).otherwise(0)
    d = d.withColumn("_k", F.when(F.col("_slot").isNull(), F.size("_cal")).otherwise(upto)).where((F.col("_k") > 0) & F.col("date").isNotNull())
    last = F.size("_cal")
    here = F.when(F.col("_k") < last, F.get("_cal", F.col("_k") - 1))
    edge = F.when((F.col("_k") > 1) & (F.get("_cal", F.col("_k") - 1) == F.col("date")), F.get("_cal", F.col("_k") - 2))
    d = d.select("ticker", "date", "close_adj", F.explode(F.array_compact(F.array(here, edge))).alias("asof"))
    g = d.groupBy("ticker", "asof").agg(F.count(F.lit(1)).alias("n"), F.min_by("close_adj", "date").alias("_p0"),
                                        F.max_by("close_adj", "date").alias("_p1"))
    return g.where((F.col("n") >= min_rows) & (F.col("_p0") > 0)).select(
        "ticker", "asof", (F.col("_p1") / F.col("_p0") - 1).alias("ret"))


def spread(panel: DataFrame, prices: DataFrame, asofs: Column, p: Params) -> DataFrame:
    """Per month interval: equal-weight return of both baskets fixed at its start, and the spread."""
    b = baskets(panel, p)
    r = b.join(interval_returns(prices, asofs), ["ticker", "asof"], "left")
    g = r.groupBy("asof").agg(*[x for s in STYLES for x in (
        (F.avg(F.when(F.col("style") == s, F.col("ret"))) * 100.0).alias(f"{s}_ret"),
        F.sum((F.col("style") == s).cast("int")).alias(f"n_{s}"))])
    frame = panel.sparkSession.range(1).select(F.explode(asofs).alias("asof"))
    w = W.partitionBy(F.lit(1)).orderBy("asof")  # one row per month
    frame = frame.withColumn("to", F.lead("asof").over(w)).where("to IS NOT NULL")
    return (frame.join(g, "asof", "left").fillna(0, subset=[f"n_{s}" for s in STYLES])
            .withColumn("spread", F.col("value_ret") - F.col("growth_ret")))


def regime(spreads: DataFrame, p: Params, months=(3, 6, 12)) -> DataFrame:
    """Label and allocation from the last k months that have a spread."""
    w = W.partitionBy(F.lit(1)).orderBy(F.col("asof").desc())  # one row per month
    d = spreads.where("spread IS NOT NULL").withColumn("_rn", F.row_number().over(w))
    d = d.withColumn("window", F.explode(F.array(*[F.lit(m) for m in months]))).where(F.col("_rn") <= F.col("window"))
    g = d.groupBy("window").agg(F.count(F.lit(1)).alias("months"), F.sum("spread").alias("spread"),
                                F.sum("value_ret").alias("value_ret"), F.sum("growth_ret").alias("growth_ret"))
    s = F.round("spread", 10)
    g = g.withColumn("tilt", F.when(s >= p.style_tilt_points, "value").when(s <= -p.style_tilt_points, "growth"))
    return allocation(g)


def allocation(d: DataFrame) -> DataFrame:
    """Allocation in percent; the favoured style gains ten points from the other."""
    # fixed values: base split and tilt
    base, tilt = {"value": 50, "growth": 35, "momentum": 15}, 10
    move = lambda up, down: F.when(F.col("tilt") == up, tilt).when(F.col("tilt") == down, -tilt).otherwise(0)
    return d.withColumns({"alloc_value": F.lit(base["value"]) + move("value", "growth"),
                          "alloc_growth": F.lit(base["growth"]) + move("growth", "value"),
                          "alloc_momentum": F.lit(base["momentum"])})


def spread_stats(spreads: DataFrame) -> DataFrame:
    return spreads.where("spread IS NOT NULL").agg(
        F.count(F.lit(1)).alias("months"), F.avg("spread").alias("mean_spread"),
        (F.avg((F.col("spread") > 0).cast("double")) * 100.0).alias("value_won_pct"))


# ---- deferral and verdict -----------------------------------------------------------------------
# fixed values: absolute metrics checked for real damage, with direction
CORE_METRICS = [("roe", 1), ("operating_margin", 1), ("ocf_to_ni", 1), ("debt_ratio", -1)]


def hurt_metrics(graded: DataFrame, p: Params) -> DataFrame:
    """Adds the array of core metrics that fell by more than the tolerance since the latest older date."""
    old = graded.select("ticker", F.col("asof").alias("_before"), *[F.col(m).alias(f"_p_{m}") for m, _ in CORE_METRICS])
    d = graded.join(previous_versions(graded, "asof", "_before"), "asof", "left").join(old, ["ticker", "_before"], "left")
    change = lambda m, s: F.when(F.col(f"_p_{m}") != 0, (F.col(m) - F.col(f"_p_{m}")) / F.abs(f"_p_{m}") * s)
    hurt = F.array_compact(F.array(*[F.when(change(m, s) < -p.fundamental_tol, F.lit(m)) for m, s in CORE_METRICS]))
    return d.withColumn("hurt", hurt).drop("_before", *[f"_p_{m}" for m, _ in CORE_METRICS])


def defer_sell(d: DataFrame, track_breadth: DataFrame, sector_breadth: DataFrame, p: Params) -> DataFrame:
    """Whether a sale is put off: broad falls in the track or sector, or intact fundamentals.

    `d` carries hurt and defer_months.
    """
    t = track_breadth.select("asof", "track", F.col("worse_share").alias("_t"))
    s = sector_breadth.select("asof", "sector", F.col("worse_share").alias("_s"))
    d = d.join(t, ["asof", "track"], "left").join(s, ["asof", "sector"], "left")
    months = F.coalesce("defer_months", F.lit(0))
    why = (F.when(months >= p.max_defer_months, None).when(F.col("_t") >= p.breadth_market, "market")
            .when(F.col("_s") >= p.breadth_sector, "sector").when(F.size("hurt") == 0, "fundamentals"))
    return d.withColumn("defer_reason", why).withColumn("defer", why.isNotNull()).drop("_t", "_s")


def verdict(p: Params) -> Column:
    """Verdict code from score, gate_pass, held and defer; holders keep what newcomers may not buy."""
    s = F.col("score")
    held = F.coalesce("held", F.lit(False))
    leave = lambda code: F.when(held & F.col("defer"), "defer").when(held, code).otherwise("out")
    return (F.when(s.isNull(), "na").when(~F.col("gate_pass"), leave("sell")).when(s >= p.score_buy, "buy")
             .when(s >= p.score_hold, F.when(held, "hold").otherwise("watch"))
             .when((s >= p.score_trim) & ~held, "watch").when(s >= p.score_trim, leave("trim"))
             .otherwise(leave("sell")))


def held_before(history: DataFrame) -> DataFrame:
    """Per (ticker, asof) from the verdicts of earlier dates: held after the newest one, and months of unbroken deferral.

    `history`: ticker, asof, code of every date, code NULL where none was given. A ticker has one row per date, and only
    rows with an earlier verdict come out.
    """
    w = W.partitionBy("ticker").orderBy("asof")
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    deferred = F.coalesce(F.col("code") == "defer", F.lit(False))
    d = history.withColumn("_n", F.sum(deferred.cast("int")).over(upto))
    stop = F.last(F.when(F.col("code").isNotNull() & ~deferred, F.col("_n")), ignorenulls=True).over(before)
    d = d.withColumns({"_last": F.last("code", ignorenulls=True).over(before),
                       "defer_months": F.max("_n").over(before) - F.coalesce(stop, F.lit(0))})
    # fixed values: a deferred sale is shown as a holding of its own kind, not as held
    return d.where("_last IS NOT NULL").select("asof", "ticker", F.col("_last").isin("buy", "hold", "trim").alias("held"), "defer_months")


# ---- report data -----------------------------------------------------------------------------------
def valuation_band(prices: DataFrame, t: DataFrame, shares: DataFrame, min_obs: int = 60) -> DataFrame:
    """Own-history price/earnings and price/book position of each ticker.

    Filings meet prices as of their receipt; a ticker has one price row per day, which bounds the
    quantile state of its group.
    """
    from tidemark.operators.asof import backward
    cols = ["net_income_parent_ttm", "equity_parent", "hybrid_capital"]
    one = t.where("rcept_dt IS NOT NULL").groupBy("ticker", "rcept_dt").agg(
        F.max_by(F.struct(*cols), "period").alias("_r")).select("ticker", "rcept_dt", "_r.*")
    d = backward(prices.select("ticker", "date", "close_adj"), one, "ticker", "date", "rcept_dt", cols)
    d = d.join(shares.where("shares_out > 0").select("ticker", "shares_out"), "ticker")
    cap = F.col("close_adj") * F.col("shares_out")
    d = d.withColumn("per", F.when(F.col("net_income_parent_ttm") != 0, cap / F.col("net_income_parent_ttm")))
    eq = F.col("equity_parent") - F.coalesce("hybrid_capital", F.lit(0.0))
    d = d.withColumn("pbr", F.when(eq != 0, cap / eq))
    cur = d.groupBy("ticker").agg(
        F.max_by("per", F.when(F.col("per").isNotNull(), F.col("date"))).alias("_per"),
        F.max_by("pbr", F.when(F.col("pbr").isNotNull(), F.col("date"))).alias("_pbr"))
    d = d.join(cur, "ticker")
    g = d.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days"), F.count("per").alias("_n"), F.count("pbr").alias("_m"),
        F.percentile("per", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        (F.avg((F.col("per") < F.col("_per")).cast("double")) * 100.0).alias("_pos"),
        (F.avg((F.col("pbr") < F.col("_pbr")).cast("double")) * 100.0).alias("_bpos"))
    ok, okb = F.col("_n") > min_obs, F.col("_m") > min_obs
    return g.select("ticker", "days", *[F.when(ok, F.col("_q")[i]).alias(n) for i, n in enumerate(("per_p25", "per_p50", "per_p75"))],
                    F.when(ok, F.col("_pos")).alias("per_pos"), F.when(okb, F.col("_bpos")).alias("pbr_pos"))


def exit_price(d: DataFrame) -> DataFrame:
    """Price at which the stock reaches the upper quartile of its own price/earnings band."""
    usable = (F.col("per") > 0) & (F.col("per_p75") != 0)
    return d.withColumn("exit_price", F.when(usable, F.col("price_asof") * F.col("per_p75") / F.col("per")))


def evidence(d: DataFrame, strategy: str, p: Params) -> DataFrame:
    """Pros and cons of each ticker as ranked rows: (ticker, side, rank, kind, item, score).

    Cons are filled up from the weakest categories and facts until they match the pros in number.
    `d` holds the grades, flags, and the strategy's coverage; each ticker has a few dozen items.
    """
    cat_of = {m: c for c, ms in spec.CATEGORIES.items() for m, _, _ in ms}
    entry = lambda k, o, kind, item: F.struct(k.alias("k"), F.lit(o).alias("o"), F.lit(kind).alias("kind"), F.lit(item).alias("item"))

    def facts(sign: int, keep: Callable[[str], Column] = lambda m: F.lit(True)) -> Column:
        """Facts in the order of their category's score, falling where `sign` is -1, then in their fixed order."""
        score = lambda m: F.col(f"{cat_of[m]}_score")
        return F.sort_array(F.array_compact(F.array(*[
            F.when(F.col(m).isNotNull() & score(m).isNotNull() & keep(m), entry(score(m) * sign, i, "fact", m))
            for i, m in enumerate(spec.FACT_METRICS) if m in cat_of])))

    def cats(sign: int) -> Column:
        return F.sort_array(F.array_compact(F.array(*[
            F.when(F.col(f"{c}_score").isNotNull(), entry(F.col(f"{c}_score") * sign, i, "category", c))
            for i, c in enumerate(spec.CATEGORY_NAMES)])))

    # scores fall along these arrays, so the strong ones stand first
    strong = lambda a, n: [F.when(F.get(a, F.lit(i))["k"] <= -70, F.get(a, F.lit(i))) for i in range(n)]
    risk = lambda cond, item: F.when(F.coalesce(cond, F.lit(False)), entry(F.lit(None).cast("double"), 0, "risk", item))
    d = d.withColumns({"_fd": facts(-1), "_cd": cats(-1), "_ca": cats(1)})
    d = d.withColumn("_pros", F.slice(F.array_compact(F.array(*strong(F.col("_fd"), 3), *strong(F.col("_cd"), 2))), 1, 4))
    d = d.withColumn("_pros", F.when(F.size("_pros") > 0, F.col("_pros")).otherwise(F.slice("_fd", 1, 3)))
    negative = {n: c for n, (c, v) in penalties(strategy).items()}
    risks = F.array_compact(F.array(
        *[risk(c, "penalty_" + n) for n, c in negative.items()],
        risk(~F.col("ttm_reliable"), "restructured"), risk(F.col("loss_streak") > 0, "loss_streak"),
        risk(F.col("stability_distorted"), "stability_distorted"), risk(F.size(overheated()) > 0, "overheated"),
        risk(F.col("weighted_present") < 4, "thin_coverage")))
    # no fact has the name of a category
    d = d.withColumns({"_risks": risks, "_quota": F.greatest(F.lit(3), F.size("_pros")), "_taken": F.col("_pros.item")})
    fill = F.concat(F.col("_ca"), facts(1, lambda m: ~F.array_contains("_taken", m)))
    room = F.greatest(F.col("_quota") - F.size("_risks"), F.lit(0))
    d = d.withColumn("_cons", F.slice(F.concat(F.col("_risks"), F.slice(fill, F.lit(1), room)), F.lit(1),
                                      F.greatest(F.lit(3), F.least(F.size("_pros"), F.lit(4)))))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(arr).alias("es")) for side, arr in (("pro", "_pros"), ("con", "_cons"))])
    x = d.select("asof", "ticker", F.explode(sides).alias("_s")).select("asof", "ticker", "_s.side", F.posexplode("_s.es").alias("rank", "e"))
    return x.select("asof", "ticker", "side", (F.col("rank") + 1).alias("rank"), "e.kind", "e.item",
                    F.when(F.col("side") == "pro", -F.col("e.k")).otherwise(F.col("e.k")).alias("score"))
