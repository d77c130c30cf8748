"""Gate features, gates, penalties and strategy scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import present, weighted
from tidemark.operators.ranks import top_n
from tidemark.params import Params

FEATURES = ["op_loss_years_3y", "fcf_pos_years_3y", "annual_count", "rev_growth_q_of_4",
            "revenue_decline_3y", "ocf_quality_bad_2y"]


def gate_features(t: DataFrame, part: list[str] | None = None) -> DataFrame:
    """History features of every filing, over the rows of `part` up to its period.

    The last three annual rows are carried to every filing as one array built by a window over
    a ticker's filings (four a year); growth counts look four rows back.
    """
    part = part or ["ticker"]
    w = W.partitionBy(*part).orderBy("period")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    year_row = F.when(F.col("quarter") == 4, F.struct(
        F.col("operating_income_ttm").alias("op"), F.col("fcf_ttm").alias("fcf"),
        F.col("revenue_ttm").alias("rev"), F.col("ocf_ttm").alias("ocf"),
        F.col("net_income_ttm").alias("ni")))
    prev = F.lag("revenue_ttm", 4).over(w)
    grew = F.when((prev > 0) & (F.col("revenue_ttm") > prev), 1).otherwise(0)
    d = t.withColumn("_years", F.collect_list(year_row).over(upto)).withColumn("_grew", grew)
    three = F.slice("_years", F.greatest(F.size("_years") - 2, F.lit(1)), 3)
    two = F.slice("_three", F.greatest(F.size("_three") - 1, F.lit(1)), 2)
    d = d.withColumn("_three", three).withColumn("_two", two)
    revs = F.filter(F.transform("_three", lambda s: s["rev"]), lambda x: x.isNotNull())
    count = lambda arr, cond: F.size(F.filter(arr, cond))
    return d.withColumn("_revs", revs).withColumns({
        "op_loss_years_3y": count("_three", lambda s: s["op"] < 0),
        "fcf_pos_years_3y": count("_three", lambda s: s["fcf"] > 0),
        "annual_count": F.size("_three"),
        "rev_growth_q_of_4": F.sum("_grew").over(w.rowsBetween(-3, 0)).cast("int"),
        "revenue_decline_3y": F.coalesce(
            (F.size("_revs") >= 3) & (F.get("_revs", F.lit(1)) < F.get("_revs", F.lit(0)))
            & (F.get("_revs", F.lit(2)) < F.get("_revs", F.lit(1))), F.lit(False)),
        "ocf_quality_bad_2y": count(
            "_two", lambda s: (s["ni"] > 0) & (s["ocf"] / F.nullif(s["ni"], F.lit(0.0)) < 0.5)) >= 2,
    }).drop("_years", "_grew", "_three", "_two", "_revs")


def gate_conditions(strategy: str, p: Params, null_policy: str = "lenient") -> dict[str, Column]:
    """Failing conditions by name. A NULL metric does not fail, except where stated.

    `panel` is the variant used for whole history: missing feature counts are read as zero
    annual rows, nine positive years, zero growth quarters; a missing market value is zero.
    """
    col = F.col
    fails = lambda x: F.coalesce(x, F.lit(False))
    panel = null_policy == "panel"
    years = F.coalesce(col("annual_count"), F.lit(0)) if panel else col("annual_count")
    cap = F.coalesce(col("market_cap"), F.lit(0.0)) if panel else col("market_cap")
    growth_q = F.coalesce(col("rev_growth_q_of_4"), F.lit(0)) if panel else col("rev_growth_q_of_4")
    fcf_years = F.coalesce(col("fcf_pos_years_3y"), F.lit(9)) if panel else col("fcf_pos_years_3y")
    if strategy == "value":
        return {
            "op_loss": fails((years >= 3) & (col("op_loss_years_3y") > 1)),
            "debt_ratio": fails(col("debt_ratio") > 200),
            "fcf_years": fails((years >= 3) & (fcf_years < 2)),
            "roe": fails(col("roe") < 8),
            "market_cap": fails(cap < p.value_cap_floor),
            "valuation": fails(col("valuation_score") < 60),
            "quality": fails(col("quality_score") < 50),
        }
    return {
        "growth_score": fails(col("growth_score").isNull() | (col("growth_score") < 80)),
        "growth_quarters": fails(growth_q < 3),
        "current_ratio": fails(col("current_ratio") < 100),
        "market_cap": fails(cap < p.growth_cap_floor),
    }


def failed_gates(strategy: str, p: Params, null_policy: str = "lenient") -> Column:
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(name)) for name, cond in gate_conditions(strategy, p, null_policy).items()]))


def penalties(strategy: str) -> dict[str, tuple[Column, float]]:
    col = F.col
    out: dict[str, tuple[Column, float]] = {}
    if strategy == "value":
        out["revenue_decline"] = (col("revenue_decline_3y"), -15.0)
        out["cash_quality"] = (col("ocf_quality_bad_2y"), -15.0)
        out["value_trap"] = ((col("pbr") < 0.5) & (col("roe") < 5), -20.0)
    else:
        out["slowdown"] = (col("growth_acceleration") < -10, -15.0)
        out["peg_high"] = (col("peg") >= 3, -20.0)
        out["peg_low"] = (col("peg") <= 1.0, 5.0)
    out["restructured"] = (~col("ttm_reliable"), -10.0)
    return out


def score(d: DataFrame, p: Params, *, only: list[str] | None = None, null_policy: str = "lenient",
          extra: list[str] | None = None) -> DataFrame:
    """One row per input row and strategy: base score, penalty, score, gate result with reasons,
    coverage. Both strategies come from one pass over the input."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = []
    for s in only or spec.STRATEGY_WEIGHTS:
        w, pens = spec.STRATEGY_WEIGHTS[s], penalties(s)
        total = reduce(lambda a, b: a + b, [F.when(yes(c), v).otherwise(0.0) for c, v in pens.values()])
        why = F.array_compact(F.array(*[F.when(yes(c), F.lit(n)) for n, (c, _) in pens.items()]))
        rows.append(F.struct(F.lit(s).alias("strategy"), weighted(w).alias("base_score"), total.alias("penalty"),
                             failed_gates(s, p, null_policy).alias("gate_fails"), why.alias("penalty_why"),
                             present([f"{c}_score" for c in w]).alias("coverage")))
    keep = [x for x in ("asof", "ticker", "name", "track", *(extra or [])) if x in d.columns]
    out = d.select(*keep, F.explode(F.array(*rows)).alias("_s")).select(*keep, "_s.*")
    return (out.withColumn("score", F.col("base_score") + F.col("penalty"))
               .withColumn("gate_pass", F.size("gate_fails") == 0))


def best_strategy(scores: DataFrame) -> DataFrame:
    """Passed strategy with the highest score per date and ticker (value first on a tie), and how many passed."""
    passed = scores.where("gate_pass AND score IS NOT NULL")
    rank = F.struct(F.col("score"), F.when(F.col("strategy") == "value", 1).otherwise(0))
    return passed.groupBy("asof", "ticker").agg(
        F.max_by("strategy", rank).alias("strategy"), F.max("score").alias("score"),
        F.count(F.lit(1)).alias("n_passed"))


def duplicates(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Keys passing the gates of more than one strategy, with all their scores."""
    passed = scores.where("gate_pass")
    many = passed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return passed.join(many, keys, "left_semi")


def contributions(d: DataFrame, strategy: str) -> DataFrame:
    """Points of each weighted category: score x weight / 100, not renormalised."""
    w = spec.STRATEGY_WEIGHTS[strategy]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(float(v)).alias("weight"),
                              F.col(f"{c}_score").alias("score")) for c, v in w.items()])
    return (d.select("asof", "ticker", F.explode(rows).alias("r")).select("asof", "ticker", "r.*")
             .withColumn("points", F.col("score") * F.col("weight") / 100.0))


def sector_ranking(best: DataFrame, sectors: DataFrame, n: int = 5, min_members: int = 3) -> DataFrame:
    """The n sectors with the best mean score of each date, with their top member."""
    d = best.join(sectors, "ticker", "left")
    top = F.max_by("name", F.struct(F.col("score"), F.col("name")))
    g = (d.groupBy("asof", F.coalesce("sector_name", F.lit(spec.UNKNOWN_SECTOR)).alias("sector_name"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"),
              top.alias("top_name"), F.max("score").alias("top_score"))
         .where(F.col("n") >= min_members).withColumn("_mean", F.round("mean_score", 10)))
    return top_n(g, ["asof"], "_mean", n, tie="sector_name").drop("_mean")


def sector_name(industry: Column) -> Column:
    code = F.substring(F.coalesce(industry, F.lit("")), 1, 2)
    names = F.create_map(*[F.lit(x) for kv in spec.SECTOR_NAMES.items() for x in kv])
    return F.when(code == "", spec.UNKNOWN_SECTOR).otherwise(
        F.coalesce(names[code], F.concat(F.lit("KSIC "), code)))


def track_of(industry: Column, debt_ratio: Column, name: Column, p: Params) -> Column:
    """Struct (track, reason) before the finance-asset check."""
    code = F.trim(F.coalesce(industry, F.lit("")))
    two = F.substring(code, 1, 2)
    t = lambda track, why: F.struct(F.lit(track).alias("track"), F.lit(why).alias("reason"))
    holding = code.startswith(spec.HOLDING_INDUSTRY)
    return (F.when(holding & (debt_ratio > p.holding_finance_debt_ratio), t(spec.FINANCE, "holding_debt"))
             .when(holding & debt_ratio.isNull() & F.coalesce(name, F.lit("")).rlike(spec.FINANCE_NAME),
                   t(spec.FINANCE, "holding_name"))
             .when(holding, t(spec.HOLDING, "holding"))
             .when(two.isin(*spec.FINANCE_INDUSTRIES), t(spec.FINANCE, "finance"))
             .when(two.isin(*spec.PHARMA_INDUSTRIES), t(spec.PHARMA, "pharma"))
             .when(debt_ratio > 2 * p.holding_finance_debt_ratio, t(spec.FINANCE, "debt_override"))
             .when(code == "", t(spec.GENERAL, "no_code"))
             .otherwise(t(spec.GENERAL, "industry")))


def assign_tracks(companies: DataFrame, annual: DataFrame, finance_assets: DataFrame, p: Params) -> DataFrame:
    """Track per company from industry code, latest annual balance and finance-like assets.

    `companies`: ticker, corp_name, induty_code; `annual`: ticker, assets, liabilities, equity;
    `finance_assets`: ticker, finance_assets. Companies without an annual row stay.
    """
    d = (companies.join(annual.select("ticker", "assets", "liabilities", "equity"), "ticker", "left")
         .join(finance_assets, "ticker", "left"))
    d = d.withColumn("debt_ratio", F.when(F.col("equity") > 0,
                                          F.col("liabilities") / F.col("equity") * 100.0))
    ratio = F.when(F.col("assets") != 0,
                   F.coalesce("finance_assets", F.lit(0.0)) / F.col("assets"))
    d = d.withColumn("finance_asset_ratio", F.coalesce(ratio, F.lit(0.0)))
    has_fin = F.col("finance_asset_ratio") >= p.finance_segment_min_ratio
    d = d.withColumn("_t", track_of(F.col("induty_code"), F.col("debt_ratio"), F.col("corp_name"), p))
    revert = (F.col("_t.reason") == "debt_override") & ~has_fin
    d = d.withColumn("track", F.when(revert, spec.GENERAL).otherwise(F.col("_t.track")))
    d = d.withColumn("track_reason", F.when(revert, "no_finance_assets").otherwise(F.col("_t.reason")))
    d = d.withColumn("has_finance_segment", has_fin & (F.col("track") == spec.GENERAL))
    distorted = F.col("has_finance_segment") & (F.col("debt_ratio") > p.stability_distort_debt_ratio)
    return (d.withColumn("stability_distorted", F.coalesce(distorted, F.lit(False)))
             .select("ticker", "corp_name", "induty_code", "track", "track_reason", "debt_ratio",
                     "has_finance_segment", "stability_distorted", "finance_asset_ratio"))


def finance_asset_sum(rows: DataFrame) -> DataFrame:
    """Sum of finance-like asset lines per (ticker, year) of annual balance sheets."""
    from tidemark.functions.exprs import parse_amount
    amount = F.abs(parse_amount("thstrm_amount"))
    hit = F.trim("account_nm").rlike(spec.FINANCE_ASSET)
    return (rows.where((F.col("sj_div") == "BS") & (F.col("reprt_code") == spec.ANNUAL_REPORT))
            .groupBy("ticker", F.col("bsns_year").alias("year"))
            .agg(F.coalesce(F.sum(F.when(hit, amount)), F.lit(0.0)).alias("finance_assets")))


def latest_annual(q: DataFrame) -> DataFrame:
    """The last fiscal-year row of each company (its own last year)."""
    a = q.where("quarter = 4")
    rest = [x for x in a.columns if x != "ticker"]
    return (a.groupBy("ticker").agg(F.max_by(F.struct(*rest), "year").alias("_r"))
             .select("ticker", "_r.*").select(*q.columns))
