"""Registered queries: one per operator or job, each over whole tables.

Every query names its output columns with a type letter, so results are rounded and typed the
same way on both sides of a comparison: f rounded double, i long, s string, b boolean,
d ISO date text, a joined array, e nine significant digits as text (for compounded totals).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import adapters, spec
from tidemark.functions.exprs import rebalance_days
from tidemark.operators import asof, ranks
from tidemark.operators.dedupe import union_by_priority
from tidemark.plans import (consensus, flags, grading, ledger, mentions, metrics, momentum, panel, portfolio, quality,
                            statements, strategies, style, universe, validate)
from tidemark.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
COLUMNS: dict[str, list[tuple[str, str]]] = {}


def rounded(x):
    """Six decimals, fewer for large values. The cut points sit a little beside the middle, so a
    value that ends exactly on a five is not decided by the last bit of a sum."""
    x = x.cast("double")
    a = F.abs(x)
    return (F.when(a < 1e5, F.round(x + 3.1e-8, 6)).when(a < 1e9, F.round(x + 3.1e-4, 2))
             .otherwise(F.round(x + 31.0, -3))) + F.lit(0.0)


def shape(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    def one(name: str, kind: str):
        x = F.col(name)
        x = {"f": lambda: rounded(x), "i": lambda: x.cast("long"),
             "d": lambda: F.date_format(x, "yyyy-MM-dd"), "b": lambda: x.cast("boolean"),
             "a": lambda: F.array_join(x, "|"), "e": lambda: F.format_string("%.8e", x.cast("double"))}.get(kind, lambda: x.cast("string"))()
        return x.alias(name)
    return df.select(*[one(n, k) for n, k in columns])


def query(name: str, columns: str):
    cols = [tuple(x.split(":")) for x in columns.split()]

    def register(fn: Callable[[Workspace], DataFrame]):
        COLUMNS[name] = cols
        QUERIES[name] = lambda spark, folder: shape(fn(workspace(spark, folder)), cols)
        return fn
    return register


# ---- sources ------------------------------------------------------------------------------------
@query("keep_last_union", "ticker:s date:d close_adj:f volume:f")
def _(w):
    hist, cur = adapters.price_stores(w.prices)
    return union_by_priority([hist, cur], ["ticker", "date"])


# ---- statements -----------------------------------------------------------------------------------
@query("amount_parse", "ticker:s bsns_year:i n_rows:i n_null:i n_negative:i total:f")
def _(w):
    from tidemark.functions.exprs import parse_amount
    d = w.raw_statements.withColumn("x", parse_amount("thstrm_amount"))
    return d.groupBy("ticker", "bsns_year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("x").isNull().cast("int")).alias("n_null"),
        F.sum((F.col("x") < 0).cast("int")).alias("n_negative"), F.sum("x").alias("total"))


@query("account_map", "ticker:s bsns_year:i reprt_code:s fs_div:s currency:s " + " ".join(
    f"{x}:f" for x in spec.FLOW_FIELDS + spec.STOCK_FIELDS))
def _(w):
    return statements.wide_reports(w.raw_statements, w.stored)


@query("fin_quarterly", "ticker:s year:i quarter:i period:i reprt_code:s fs_div:s rcept_dt:d currency:s revenue:f operating_income:f net_income:f ocf:f capex_tangible:f assets:f equity:f")
def _(w):
    q = w.fin_quarterly
    return statements.fin_quarterly(w.raw_statements, adapters.filing_list(q), w.stored)


@query("ttm", "ticker:s period:i rcept_dt:d " + " ".join(f"{x}_ttm:f" for x in spec.FLOW_FIELDS)
       + " equity_avg:f equity_parent_avg:f assets_avg:f capex_ttm:f fcf_ttm:f da_ttm:f")
def _(w):
    return statements.ttm(w.fin_quarterly)


@query("single_quarter", "ticker:s period:i revenue_q:f operating_income_q:f net_income_q:f ocf_q:f")
def _(w):
    return statements.single_quarter(w.fin_quarterly)


@query("share_rollup", "ticker:s shares_common:i shares_total:i market_cap_common:f market_cap_total:f has_preferred:b treasury:i treasury_known:b shares_outstanding:i treasury_ratio:f")
def _(w):
    return w.shares


# ---- universe -----------------------------------------------------------------------------------------
@query("universe_snapshots", "asof_date:d price_date:d ticker:s name:s market:s close:f market_cap:f shares_out:i trading_value:f avg_trading_value:f cap_rank:i included:b excluded_reason:s")
def _(w):
    return universe.snapshots(w.market, adapters.rebalance_dates(w.prices), w.p)


@query("ever_included", "ticker:s")
def _(w):
    return universe.ever_included(w.snapshots)


@query("prev_settled", "asof:d price_date:d")
def _(w):
    return universe.previous_settled(universe.settled_days(w.market), adapters.rebalance_dates(w.prices), "KOSPI", w.p)


# ---- prices ----------------------------------------------------------------------------------------------
@query("momentum_asof", "ticker:s asof:d price_date:d price_asof:f avg_tv:f " + " ".join(
    f"{x}:{'i' if x == 'price_days' else 'f'}" for x in momentum.COLUMNS))
def _(w):
    return panel.prices_on_dates(w.prices, w.dates)


@query("overheated", "ticker:s date:d signals:a")
def _(w):
    return momentum.features(w.prices).withColumn("signals", momentum.overheated()).where(F.size("signals") > 0)


@query("rolling_turnover", "ticker:s date:d avg_tv:f")
def _(w):
    return momentum.average_turnover(w.prices).where("avg_tv IS NOT NULL")


@query("fwd_returns", "ticker:s asof:d fwd_21:f fwd_63:f fwd_126:f")
def _(w):
    d = w.prices
    for h in (21, 63, 126):
        d = asof.forward_rows(d, h)
    return asof.on_dates(d, "ticker", "date", w.dates).where("close_adj > 0")


@query("asof_price", "mention_id:i ticker:s pub:s ratio:f kept:b")
def _(w):
    from tidemark.plans import consensus
    return consensus.band_filter(w.mentions, consensus.event_prices(w), w.p, keep_all=True)


# ---- metrics and flags ---------------------------------------------------------------------------------------
@query("growth_metrics", "ticker:s period:i revenue_growth_yoy:f op_growth_yoy:f ni_growth_yoy:f revenue_cagr_3y:f eps_cagr_3y:f growth_volatility:f growth_acceleration:f norm_margin:f")
def _(w):
    return metrics.history_features(w.ttm, w.p, ["ticker"]).withColumnRenamed("_norm_margin", "norm_margin")


LATEST = ["roe", "roa", "operating_margin", "net_margin", "gp_to_assets", "net_debt", "roic", "debt_ratio", "current_ratio",
          "equity_ratio", "ocf_to_ni", "fcf_to_ni", "ebitda", "net_debt_ebit", "net_debt_ebitda", "per", "pbr", "psr", "ev",
          "ev_ebit", "ev_ebitda", "eps", "bps", "fcf_yield", "normalized_income", "normalized_per", "peg",
          "revenue_growth_yoy", "growth_volatility", "return_3m", "disparity_20"]


def _latest(w: Workspace) -> DataFrame:
    members = universe.ever_included(w.snapshots)
    return panel.latest_metrics(w.newest, members, w.shares, w.tracks, w.ttm, w.prices, w.p)


@query("metric_core", "ticker:s track:s fin_year:i fin_quarter:i currency:s loss_streak:i loss_flag:s ttm_reliable:b " + " ".join(f"{x}:f" for x in LATEST))
def _(w):
    return _latest(w)


@query("null_rates", "track:s n:i per:f pbr:f roe:f operating_margin:f debt_ratio:f fcf_to_ni:f revenue_growth_yoy:f ev_ebit:f")
def _(w):
    return metrics.null_rates(_latest(w), "track", ["per", "pbr", "roe", "operating_margin", "debt_ratio", "fcf_to_ni", "revenue_growth_yoy", "ev_ebit"])


@query("winsorized", "asof:d ticker:s per:f per_w:f")
def _(w):
    return metrics.winsorize(w.panel.select("asof", "ticker", "per"), "per", "per_w", w.p, ["asof"])


@query("loss_streak", "ticker:s loss_streak:i")
def _(w):
    return flags.loss_streak(w.ttm.where("quarter = 4"))


@query("cash_runway", "ticker:s period:i runway:f grade:s")
def _(w):
    t = w.ttm.withColumn("runway", flags.cash_runway(F.col("cash"), -F.col("ocf_ttm") / 4.0))
    return t.where("runway IS NOT NULL").withColumn("grade", flags.runway_grade(F.col("runway"), w.p))


@query("restructure", "ticker:s period:i carried:i equity_change:f assets_change:f")
def _(w):
    return flags.restructure_events(w.ttm, w.p)


@query("load_report", "ticker:s rows:i ttm_rows:i loss_streak:i restructure:i status:s")
def _(w):
    corp = adapters.company_list(w.spark, w.folder).select("ticker", "corp_code")
    members = universe.ever_included(w.snapshots).join(corp, "ticker", "left")
    streaks = flags.loss_streak(w.ttm.where("quarter = 4"))
    return statements.load_report(members, w.fin_quarterly, w.ttm, streaks, flags.restructure_events(w.ttm, w.p))


@query("track_assignment", "ticker:s track:s track_reason:s debt_ratio:f has_finance_segment:b stability_distorted:b finance_asset_ratio:f")
def _(w):
    # one company in five is shown with six times its liabilities
    heavy = F.col("corp_code").cast("long") % 5 == 1
    annual = strategies.latest_annual(w.fin_quarterly).withColumn(
        "liabilities", F.when(heavy, F.col("liabilities") * 6.0).otherwise(F.col("liabilities")))
    # lines named like finance assets: one in six companies books half its assets there
    rows = adapters.finance_lines(w.fin_quarterly)
    fin = strategies.finance_asset_sum(rows).join(annual.select("ticker", "year"), ["ticker", "year"]).select("ticker", "finance_assets")
    return strategies.assign_tracks(adapters.company_list(w.spark, w.folder), annual, fin, w.p)


@query("latest_annual", "ticker:s year:i revenue:f operating_income:f")
def _(w):
    return strategies.latest_annual(w.fin_quarterly)


@query("latest_received", "ticker:s period:i rcept_dt:d revenue_ttm:f")
def _(w):
    return asof.latest_received(w.ttm.select("ticker", "period", "rcept_dt", "revenue_ttm"), F.to_date(F.lit("1999-06-05")))


# ---- grades and scores -----------------------------------------------------------------------------------------
GRADES = " ".join(f"{c}_score:f {c}_grade:s {c}_n:f" for c in spec.CATEGORY_NAMES)


@query("panel", "asof:d ticker:s track:s sector:s peer:s fin_period:i rcept_dt:d market_cap:f price_asof:f per:f pbr:f roe:f roic:f debt_ratio:f psr:f ev_ebit:f fcf_yield:f peg:f normalized_per:f growth_volatility:f growth_acceleration:f revenue_cagr_3y:f return_3m:f rsi_14:f fwd_63:f quality_score:f coverage:i scores_present:i " + " ".join(f"{c}_score:f" for c in spec.CATEGORY_NAMES))
def _(w):
    return grading.grade(w.stored_cohorts("panel_query"), w.p)


@query("grades", "asof:d ticker:s track:s peer:s " + GRADES)
def _(w):
    return grading.grade(w.cohorts, w.p)


@query("average_rank", "asof:d ticker:s pct:f cap_rank:i")
def _(w):
    d = ranks.average_rank_pct(w.panel.select("asof", "ticker", "pbr", "market_cap"), ["asof"], "pbr", "pct")
    return ranks.min_rank_desc(d, ["asof"], "market_cap", "cap_rank")


@query("missing_sector", "asof:d n:i missing_share:f warn:b")
def _(w):
    return grading.missing_sector(w.panel, w.p, "asof")


@query("gate_features", "ticker:s period:i op_loss_years_3y:i fcf_pos_years_3y:i annual_count:i rev_growth_q_of_4:i revenue_decline_3y:b ocf_quality_bad_2y:b")
def _(w):
    return strategies.gate_features(w.ttm)


def _scored(w: Workspace) -> DataFrame:
    g = w.scored.where("strategy = 'value'")
    return strategies.score(flags.with_reliability(g.withColumn("period", F.col("fin_period")), flags.restructure_events(w.ttm, w.p)), w.p)


@query("strategy_scores", "asof:d ticker:s strategy:s base_score:f penalty:f score:f gate_pass:b gate_fails:a penalty_why:a coverage:i")
def _(w):
    return _scored(w)


@query("gate_panel", "asof:d ticker:s strategy:s score:f pass:b gate_fails:a mkt:f excess:f op_loss_years_3y:i annual_count:i rev_growth_q_of_4:i")
def _(w):
    return w.gate_panel


@query("prepared_panel", "asof:d ticker:s strategy:s avg_tv:f cap_rank:i in_universe:b b_univ:f b_cap:f exc_univ:f exc_cap:f")
def _(w):
    return panel.prepare(w.gate_panel.select(*panel.research_columns()), w.p)


# ---- validation --------------------------------------------------------------------------------------------------
def _ic_rows(w: Workspace) -> DataFrame:
    return validate.signal_rows(w.panel, {**validate.category_signals(), **{"raw_" + k: v for k, v in validate.raw_signals().items()}, **validate.mix_signals()}, "fwd_63")


@query("ic_by_month", "signal:s asof:d n:i ic:f")
def _(w):
    return validate.ic_by_month(_ic_rows(w), w.p)


@query("ic_summary", "signal:s mean_ic:f median_ic:f positive_pct:f months:i verdict:s")
def _(w):
    return validate.ic_summary(validate.ic_by_month(_ic_rows(w), w.p))


@query("ic_halves", "signal:s first_half:f second_half:f stable:b")
def _(w):
    months = w.panel.where("fwd_63 IS NOT NULL").agg(F.sort_array(F.collect_set("asof")).alias("a"))
    mid = months.select(F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("m")).scalar()
    rows = validate.signal_rows(w.panel, validate.category_signals(), "fwd_63")
    return validate.ic_halves(validate.ic_by_month(rows, w.p), mid)


@query("quintiles", "signal:s n:i q1:f q2:f q3:f q4:f q5:f spread:f")
def _(w):
    return validate.quantile_returns(validate.signal_rows(w.panel, validate.category_signals(), "fwd_63"))


@query("gate_effect", "strategy:s group:s n:i mean_ret:f mean_excess:f win_rate:f months:i t:f p:f")
def _(w):
    return validate.gate_effect(w.gate_panel)


@query("gate_topn", "strategy:s gate:s n:i mean_ret:f mean_excess:f win_rate:f months:i t:f p:f")
def _(w):
    return validate.gate_topn(w.gate_panel, w.p.top_n)


@query("gate_ablation", "strategy:s skipped:s n:i mean_excess:f change:f pass_rate:f")
def _(w):
    return validate.gate_ablation(w.gate_panel, w.p, w.p.top_n)


@query("pass_rate_link", "strategy:s months:i rank_corr:f t:f p:f low_third:f high_third:f")
def _(w):
    return validate.series_link(validate.pass_rates(w.gate_panel), ["strategy"], "rate", "mkt", 0.33, 0.67, 5)


@query("pass_rate_bins", "strategy:s bin:i months:i lo:f hi:f mkt:f")
def _(w):
    return validate.pass_rate_bins(validate.pass_rates(w.gate_panel))


@query("gate_by_year", "strategy:s year:i on_excess:f off_excess:f diff:f passing:f")
def _(w):
    return validate.by_year(w.gate_panel, w.p.top_n)


@query("cap_quintiles", "strategy:s q:i median_cap:f mean_excess:f win_rate:f n:i")
def _(w):
    return validate.by_cap_quintile(w.gate_panel)


@query("liquidity_floors", "strategy:s floor:f n:i mean_ret:f mean_excess:f win_rate:f months:i t:f p:f")
def _(w):
    return validate.by_liquidity(w.gate_panel, [0.0, 1e4, 2e4, 3e4, 5e4, 1e5], w.p.top_n)


@query("gate_by_regime", "strategy:s regime:s universe:f on_excess:f off_excess:f months:i")
def _(w):
    return validate.by_regime(w.prepared, w.p.top_n)


@query("predictors", "predictor:s months:i rank_corr:f t:f p:f low_third:f high_third:f")
def _(w):
    return validate.series_link(validate.predictors(w.prepared), ["predictor"], "x", "market")


@query("predictor_halves", "half:s months:i rank_corr:f")
def _(w):
    d = validate.predictors(w.prepared).where("predictor = 'diffusion'")
    return validate.series_link(validate.halves(d, ["predictor"], "x", "market"), ["half"], "x", "market")


# ---- portfolio -----------------------------------------------------------------------------------------------------
@query("monthly_returns", "asof:d ticker:s ret_m:f")
def _(w):
    return portfolio.monthly_returns(w.prices, w.asofs, w.p)


@query("haircut_returns", "asof:d ticker:s ret_m:f")
def _(w):
    return portfolio.monthly_returns(w.prices, w.asofs, w.p, haircut_pct=-50.0)


@query("delisted", "ticker:s last_date:d")
def _(w):
    return portfolio.delisted(w.prices, w.p)


@query("benchmarks", "asof:d eq:f cw:f")
def _(w):
    return portfolio.bench_monthly(w.prepared, w.monthly_returns, w.asofs)


def _runs(w: Workspace, n: int | None = None):
    picks = portfolio.gate_runs(w.prepared, n or w.p.top_n)
    return picks, portfolio.simulate(picks, w.monthly_returns, w.asofs, portfolio.gate_run_list(w.spark), ["strategy", "gate"], w.p.cost_pct)


@query("topn_performance", "strategy:s gate:s asof:d n:i gross:f turnover:f ret:f equity:f")
def _(w):
    return _runs(w)[1]


PERF = "months:i total:f gross_total:f bench_total:f mdd:f win_rate:f turnover:f excess:f cagr:f t:f p:f"


@query("performance_summary", "strategy:s gate:s " + PERF)
def _(w):
    bench = portfolio.bench_monthly(w.prepared, w.monthly_returns, w.asofs)
    return portfolio.summary(_runs(w)[1], bench, ["strategy", "gate"])


@query("performance_by_year", "strategy:s gate:s year:i " + PERF)
def _(w):
    bench = portfolio.bench_monthly(w.prepared, w.monthly_returns, w.asofs)
    return portfolio.summary(_runs(w)[1], bench, ["strategy", "gate"], years=True)


@query("trade_stats", "strategy:s gate:s n:i win_rate:f avg_win:f avg_loss:f payoff:f breakeven:f")
def _(w):
    return portfolio.trade_stats(portfolio.legs(portfolio.gate_runs(w.prepared, w.p.top_n), w.monthly_returns), ["strategy", "gate"])


@query("concentration", "strategy:s gate:s n:i names:i base:f without_1:f without_3:f without_5:f")
def _(w):
    return portfolio.concentration(portfolio.legs(portfolio.gate_runs(w.prepared, w.p.top_n), w.monthly_returns), ["strategy", "gate"])


def _race(w: Workspace):
    d = w.prepared.where("strategy = 'value' AND in_universe")
    picks = portfolio.race_picks(portfolio.factor_signals(d))
    names = ["pbr", "per", "valuation", "profitability", "growth", "stability", "value_mix", "value_mix_no_valuation", "growth_mix", "growth_mix_no_valuation"]
    runs = (w.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("signal"))
            .select("signal", F.explode(F.array(*[F.lit(x) for x in (3, 5, 10, 20)])).alias("top")))
    return picks, portfolio.simulate(picks, w.monthly_returns, w.asofs, runs, ["signal", "top"], w.p.cost_pct)


@query("factor_race", "signal:s top:i " + PERF)
def _(w):
    bench = portfolio.bench_monthly(w.prepared, w.monthly_returns, w.asofs)
    return portfolio.summary(_race(w)[1], bench, ["signal", "top"])


@query("race_eras", "signal:s top:i early:f late:f bench_early:f bench_late:f beats:s")
def _(w):
    bench = portfolio.bench_monthly(w.prepared, w.monthly_returns, w.asofs)
    return portfolio.race_eras(_race(w)[1], bench, ["signal", "top"], 1999)


@query("race_concentration", "signal:s top:i n:i names:i base:f without_1:f without_3:f without_5:f")
def _(w):
    return portfolio.concentration(portfolio.legs(_race(w)[0], w.monthly_returns), ["signal", "top"])


@query("signal_turnover", "strategy:s gate:s kept_pct:f new_per_month:f new_per_year:f names_ever:i")
def _(w):
    return portfolio.signal_turnover(portfolio.gate_runs(w.prepared, w.p.top_n), w.asofs, portfolio.gate_run_list(w.spark), ["strategy", "gate"])


@query("unit_nav", "asof:d nav:f units:f paid_total:f value:f drawdown:f")
def _(w):
    return portfolio.unit_nav(portfolio.bench_monthly(w.prepared, w.monthly_returns, w.asofs), 500.0, 20000.0)


@query("first_touch", "ticker:s entry_date:d entry_price:f exit_date:d exit_price:f reason:s")
def _(w):
    entries = (w.prepared.where("strategy = 'growth' AND in_universe")
               .select("ticker", F.col("price_date").alias("entry_date"), F.col("price_asof").alias("entry_price")).distinct())
    return portfolio.first_touch(entries, w.prices, 30.0, 60.0)


@query("panel_diff", "strategy:s gate:s months:i changed_months:i avg_replaced:f " + " ".join(f"{side}_{x}:f" for side in ("old", "new") for x in ("total", "excess", "mdd")))
def _(w):
    # the earlier panel knew a universe half as large
    old = w.prepared.withColumn("in_universe", F.col("in_universe") & (F.col("cap_rank") <= w.p.universe_size // 2))
    return portfolio.panel_diff(old, w.prepared, w.monthly_returns, w.p.top_n, w.p.cost_pct)


# ---- sources ----------------------------------------------------------------------------------------------
@query("statement_json", "ticker:s bsns_year:i reprt_code:s n_rows:i last_ord:i first_name:s")
def _(w):
    from tidemark.sources.tables import statement_rows
    rows = statement_rows(adapters.statement_docs(w.raw_statements))
    return rows.groupBy("ticker", "bsns_year", "reprt_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("ord").alias("last_ord"), F.min_by("account_nm", "ord").alias("first_name"))


@query("news_pages", "query:s article:s title:s")
def _(w):
    from tidemark.sources.tables import news_articles
    return news_articles(adapters.news_pages(adapters.articles(w.spark, w.folder)))


@query("report_csv", "ticker:s broker:s date:d target:f")
def _(w):
    from tidemark.sources import tables
    d = adapters.reports(w.mentions).select(F.col("ticker").alias("ticker"), F.col("broker").alias("증권사"), F.col("date").alias("날짜"), F.format_number("target", 0).alias("목표주가"))
    path = f"{w.scratch}/reports.csv"
    tables.write_csv(d, path)
    return tables.read_reports(w.spark, path)


@query("company_profiles", "corp_code:s induty_code:s")
def _(w):
    from tidemark.sources.tables import company_profiles
    status = F.when(F.col("corp_code").cast("long") % 11 == 5, "013").otherwise("000")
    return company_profiles(adapters.company_list(w.spark, w.folder).withColumn("status", status))


@query("market_projection", "ticker:s source:s n:i close:f market_cap:f shares_out:i")
def _(w):
    from tidemark.sources.tables import SNAPSHOT_NAMES, project
    back = {v: k for k, v in SNAPSHOT_NAMES.items()}
    raw = w.market.select(*[F.col(c).alias(back[c]) for c in w.market.columns if c in back])
    d = project(raw, SNAPSHOT_NAMES, source="market")
    return d.groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close"), F.max("market_cap").alias("market_cap"), F.max("shares_out").alias("shares_out"))


# ---- style and verdicts ----------------------------------------------------------------------------------------
def _spread(w: Workspace, rows: DataFrame | None = None) -> DataFrame:
    rows = w.panel if rows is None else rows
    months = rows.agg(F.sort_array(F.collect_set("asof")).alias("a")).scalar()
    return style.spread(rows, w.prices, months, w.p)


@query("style_spread", "asof:d to:d value_ret:f growth_ret:f spread:f n_value:i n_growth:i")
def _(w):
    return _spread(w)


@query("style_regime", "window:i months:i spread:f value_ret:f growth_ret:f tilt:s alloc_value:i alloc_growth:i alloc_momentum:i")
def _(w):
    return style.regime(_spread(w), w.p)


@query("style_stats", "months:i mean_spread:f value_won_pct:f")
def _(w):
    return style.spread_stats(_spread(w))


@query("style_spread_fixed", "asof:d to:d value_ret:f growth_ret:f spread:f n_value:i n_growth:i")
def _(w):
    return _spread(w, w.fixed_panel)


@query("style_stats_by_shares", "shares:s months:i mean_spread:f value_won_pct:f")
def _(w):
    both = (("as seen", w.panel), ("fixed", w.fixed_panel))
    return reduce(DataFrame.unionByName, [style.spread_stats(_spread(w, d)).withColumn("shares", F.lit(n)) for n, d in both])


@query("style_baskets", "asof:d style:s ticker:s")
def _(w):
    return style.baskets(w.panel, w.p)


@query("breadth", "asof:d track:s sector:s worse_share:f n:i")
def _(w):
    by = lambda keys: grading.breadth(w.panel, w.p, keys)
    blank = F.lit(None).cast("string")
    return (by(["track"]).withColumn("sector", blank).unionByName(by(["sector"]).withColumn("track", blank))
            .unionByName(by([]).withColumn("track", blank).withColumn("sector", blank)))


def _held(w: Workspace) -> DataFrame:
    return style.held_before(adapters.verdict_history(w.scored))


@query("held_before", "asof:d ticker:s held:b defer_months:i")
def _(w):
    return _held(w)


@query("verdicts", "asof:d ticker:s score:f gate_pass:b held:b defer_months:i hurt:a defer:b defer_reason:s code:s")
def _(w):
    scores = _scored(w).where("strategy = 'growth'")
    d = style.hurt_metrics(w.panel, w.p).select("asof", "ticker", "track", "sector", "hurt").join(
        scores.select("asof", "ticker", "score", "gate_pass"), ["asof", "ticker"])
    d = d.join(_held(w), ["asof", "ticker"], "left")
    d = style.defer_sell(d, grading.breadth(w.panel, w.p, ["track"]), grading.breadth(w.panel, w.p, ["sector"]), w.p)
    return d.withColumn("code", style.verdict(w.p)).withColumn("held", F.coalesce("held", F.lit(False)))


@query("value_counts", "asof:d column:s value:s n:i rank:i")
def _(w):
    d = w.scored.where("strategy = 'value'").withColumn("pass", F.when(F.col("score").isNotNull(), F.col("pass")))
    cols = ("track", "sector", "growth_grade", "pass")
    return reduce(DataFrame.unionByName, [grading.value_counts(d, c, ["asof"]).withColumn("column", F.lit(c)) for c in cols])


@query("valuation_band", "ticker:s days:i per_p25:f per_p50:f per_p75:f per_pos:f pbr_pos:f exit_price:f")
def _(w):
    px = w.prices.where(F.col("date") <= w.newest)
    latest = _latest(w)
    band = style.valuation_band(px, w.ttm, latest.select("ticker", "shares_out"))
    return style.exit_price(band.join(latest.select("ticker", "per", "price_asof"), "ticker"))


@query("evidence", "asof:d ticker:s side:s rank:i kind:s item:s score:f")
def _(w):
    g = w.scored.where("strategy = 'value'")
    g = flags.with_reliability(g.withColumn("period", F.col("fin_period")), flags.restructure_events(w.ttm, w.p))
    g = g.join(flags.loss_streak(w.ttm.where("quarter = 4")), "ticker", "left").join(w.tracks.select("ticker", "stability_distorted"), "ticker", "left")
    from tidemark.functions.exprs import present
    g = g.withColumn("weighted_present", present([f"{c}_score" for c in spec.STRATEGY_WEIGHTS["value"]]))
    return style.evidence(g, "value", w.p)


@query("contributions", "asof:d ticker:s category:s weight:f score:f points:f")
def _(w):
    return strategies.contributions(w.panel, "value")


@query("best_strategy", "asof:d ticker:s strategy:s score:f n_passed:i")
def _(w):
    return strategies.best_strategy(_scored(w))


@query("strategy_duplicates", "asof:d ticker:s strategy:s score:f")
def _(w):
    return strategies.duplicates(_scored(w), ["asof", "ticker"])


@query("sector_ranking", "asof:d sector_name:s n:i mean_score:f top_name:s top_score:f rank:i")
def _(w):
    s = _scored(w).where((F.col("strategy") == "value") & F.col("score").isNotNull())
    firms = adapters.company_list(w.spark, w.folder).select("ticker", strategies.sector_name(F.col("induty_code")).alias("sector_name"))
    return strategies.sector_ranking(s.select("asof", "ticker", "score", F.col("ticker").alias("name")), firms)


# ---- consensus -----------------------------------------------------------------------------------------------------
@query("mention_dedupe", "mention_id:i ticker:s broker:s target:f pub:s copies:i")
def _(w):
    return consensus.dedupe(w.mentions, w.p, store=w.stored)


@query("representatives", "mention_id:i ticker:s broker:s target:f direction:s copies:i")
def _(w):
    return consensus.representatives(consensus.dedupe(w.mentions, w.p, store=w.stored), w.news_asof, w.p)


@query("consensus", "ticker:s n_brokers:i n_foreign:i median_target:f upside:f dispersion:f revision:f")
def _(w):
    obs = consensus.dedupe(w.mentions, w.p, store=w.stored)
    return consensus.aggregate(obs, consensus.last_price(consensus.event_prices(w)), w.news_asof, w.p)


def _batch(w: Workspace) -> DataFrame:
    obs = w.mentions.withColumn("link", F.concat(F.lit("n"), F.floor(F.col("mention_id") / 3).cast("string")))
    members = adapters.companies(w.spark, w.folder).unionByName(w.spark.range(1).select(F.lit("999999").alias("ticker"), F.lit("none").alias("name")))
    return consensus.batch(members, obs, consensus.event_prices(w), w.news_asof, w.p, w.stored)


@query("consensus_batch", "ticker:s name:s articles:i span_days:i reports:i band_drop:i single:i price:f n_brokers:i n_foreign:i median_target:f upside:f dispersion:f revision:f")
def _(w):
    return _batch(w)


@query("upside_percentile", "ticker:s upside:f upside_pct:f pool_median:f")
def _(w):
    return consensus.upside_percentile(_batch(w), w.p)


@query("report_summary", "ticker:s n:i brokers:s target_mean:f target_min:f target_max:f latest:d upside:f spread:f")
def _(w):
    return consensus.report_summary(adapters.reports(w.mentions), consensus.last_price(consensus.event_prices(w)), w.p)


@query("rank_gap", "asof:d strategy:s ticker:s rank:i score:f upside:f rank_score:i rank_upside:i gap:i note:s")
def _(w):
    keys = ["asof", "strategy"]
    picks = ranks.top_n(_scored(w), keys, "score", w.p.top_n)
    return consensus.rank_gap(picks.join(_batch(w).select("ticker", "upside"), "ticker", "left"), w.p, keys)


@query("mention_extract", "article_id:i ticker:s broker:s foreign:b target:f prev_target:f direction:s pub:s link:s from_title:b")
def _(w):
    firms = adapters.companies(w.spark, w.folder)
    return mentions.extract(adapters.articles(w.spark, w.folder), mentions.name_dictionary(firms, adapters.listed_names(firms)),
                            mentions.name_table(firms), w.stored)


@query("name_dictionary", "ticker:s name:s own:a tails:a affiliate:s")
def _(w):
    firms = adapters.companies(w.spark, w.folder)
    d = mentions.name_dictionary(firms, adapters.listed_names(firms))
    return d.withColumn("tails", F.coalesce(F.sort_array(F.col("longer")[F.col("name")]), F.array().cast("array<string>")))


# ---- ledger ------------------------------------------------------------------------------------------------------------
def _selections(w: Workspace) -> DataFrame:
    return ledger.selections(ledger.rule_scores(adapters.rule_inputs(w.scored), w.p), w.p.top_n)


@query("rule_selections", "asof:d rule:s rank:i ticker:s score:f")
def _(w):
    return _selections(w)


def _book(w: Workspace) -> DataFrame:
    return ledger.book(_selections(w), w.prices, w.runs, w.p)


LEDGER = "asof:d rule:s rank:i ticker:s score:f entry_price:f exit_asof:d exit_price:f ret_pct:f"


@query("ledger_cycle", LEDGER)
def _(w):
    return _book(w)


@query("run_dates", "asof:d price_date:d lag:i fresh:b next_run:d exit_run:d")
def _(w):
    return w.runs


def _months(w: Workspace) -> DataFrame:
    return ledger.months(w.stored(_book(w), "book"), w.prices, w.runs, w.panel.select("asof", "ticker", "market_cap"), _diffusion(w))


@query("month_close", "asof:d exit_asof:d days:i bench_eq:f bench_cap:f diffusion:f n_universe:i " + " ".join(f"{r}:f" for r in ledger.RULES))
def _(w):
    return _months(w)


@query("stored_months", "asof:d exit_asof:d days:i bench_eq:f bench_cap:f diffusion:f n_universe:i " + " ".join(f"{r}:f" for r in ledger.RULES))
def _(w):
    # all months first without the diffusion index, then the later half of them again with it
    rows = w.stored(_months(w), "months")
    w.store.put(rows.withColumn("diffusion", F.lit(None).cast("double")), "months")
    days = rows.agg(F.sort_array(F.collect_set("asof")).alias("a"))
    middle = days.select(F.get("a", F.floor(F.size("a") / 2).cast("int"))).scalar()
    w.store.put(rows.where(F.col("asof") >= middle), "months")
    return w.store.dated("months")


@query("published_panel", "asof:d ticker:s track:s quality_score:f")
def _(w):
    w.store.publish(w.panel.select("asof", "ticker", "track", "quality_score"), "panel", ["asof", "ticker"])
    return w.store.published("panel")


def _diffusion(w: Workspace) -> DataFrame:
    return ledger.diffusion_index(w.scored.where("strategy = 'growth'"))


@query("diffusion", "asof:d diffusion:f n:i")
def _(w):
    return _diffusion(w)


@query("scoreboard", "rule:s cumulative:e mean:f vs_bench:f wins:i months:i best:f worst:f")
def _(w):
    return ledger.scoreboard(_months(w))


# ---- data quality -----------------------------------------------------------------------------------------------------------
@query("coverage_check", "month:d tickers:i peak:i bad:b")
def _(w):
    return quality.coverage(w.prices)


@query("staleness_check", "asof:d stale_share:f n:i bad:b")
def _(w):
    return quality.staleness(w.prepared, w.p)


@query("completeness", "ticker:s name:s first_in:d last_in:d fin_year:i px_last:d has_track:b stale:b")
def _(w):
    return quality.completeness(w.snapshots, w.ttm, w.prices, w.tracks)


@query("missing_dates", "asof_date:d")
def _(w):
    # wanted from a year before the first price on
    wanted = w.prices.agg(rebalance_days(F.add_months(F.min("date"), -12), F.max("date")).alias("d")).scalar()
    return quality.missing_dates(wanted, w.snapshots)


@query("needs_extension", "ticker:s last_date:d")
def _(w):
    return quality.needs_extension(w.prices, w.prices.agg(F.max("date")).scalar(), w.p.extension_days)


@query("price_upsert", "ticker:s n:i total:f")
def _(w):
    hist, cur = adapters.price_stores(w.prices)
    return quality.upsert_prices(hist, cur).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("close_adj").alias("total"))


@query("reconcile", "field:s n:i within:i median_err:f")
def _(w):
    d = _latest(w).select("ticker", "eps", "bps", "pbr")
    k = F.col("ticker").cast("long")
    ext = d.select("ticker", *[(F.col(x) * (1 + (k / 10 % 7) / 25.0) * F.when(k % 90 == 0, 0.0).otherwise(1.0)).alias(x) for x in ("eps", "bps", "pbr")])
    return quality.reconcile(d, ext, ["eps", "bps", "pbr"])
