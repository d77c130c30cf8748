"""Derived metrics of one (ticker, filing, as-of) row, and history features per filing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import div, nonzero_or, null_double, pct
from tidemark.operators.ranks import exact_quantiles
from tidemark.params import Params


def effective_tax_rate(tax, pretax, p: Params) -> Column:
    r = div(tax, pretax)
    return F.when(r.between(p.tax_rate_low, p.tax_rate_high), r).otherwise(p.default_tax_rate)


def history_features(t: DataFrame, p: Params, part: list[str]) -> DataFrame:
    """Growth, volatility, normalised margin of each filing from earlier periods of `part`.

    Lags are by period, so a missing quarter gives NULL instead of a wrong neighbour.
    """
    w = W.partitionBy(*part).orderBy("period")
    at = lambda x, k: F.max(x).over(w.rangeBetween(-k, -k))

    def yoy(col: str) -> Column:
        prev = at(col, 4)
        return F.when(prev > 0, F.col(col) / prev - 1)

    def cagr(col: str) -> Column:
        prev = at(col, 12)
        return pct(F.when((prev > 0) & (F.col(col) > 0), F.pow(F.col(col) / prev, F.lit(1.0 / 3.0)) - 1))

    d = t.withColumns({
        "_yoy": yoy("revenue_ttm"),
        "op_growth_yoy": pct(yoy("operating_income_ttm")),
        "ni_growth_yoy": pct(yoy("net_income_ttm")),
        "revenue_cagr_3y": cagr("revenue_ttm"),
        "eps_cagr_3y": cagr("net_income_parent_ttm"),
        "_margin": F.when(F.col("revenue_ttm") != 0, F.col("operating_income_ttm") / F.col("revenue_ttm")),
    })
    vol = w.rangeBetween(-(p.growth_vol_quarters - 1), 0)
    norm = w.rangeBetween(-(p.normalize_quarters - 1), 0)
    y = [F.col("_yoy")] + [at("_yoy", k) for k in (1, 2, 3)]
    enough = F.count("_yoy").over(vol) >= p.growth_vol_min
    d = d.withColumns({
        "revenue_growth_yoy": pct(F.col("_yoy")),
        "growth_volatility": pct(F.when(enough, F.stddev_pop("_yoy").over(vol))),
        "growth_acceleration": pct(F.when(enough, (y[0] + y[1]) / 2.0 - (y[2] + y[3]) / 2.0)),
        "_norm_margin": F.when(F.count("_margin").over(norm) >= p.normalize_min, F.avg("_margin").over(norm)),
    })
    return d.drop("_yoy", "_margin")


def ratios(d: DataFrame, p: Params) -> DataFrame:
    """Metrics of rows carrying TTM columns, history features, market_cap, shares_out, track."""
    col = F.col
    d = d.withColumns({
        "_ni": col("net_income_ttm"),
        "_nip": nonzero_or("net_income_parent_ttm", "net_income_ttm"),
        "_eqp": nonzero_or("equity_parent", "equity"),
        "_eq_avg": nonzero_or("equity_avg", "equity"),
        "_tax": effective_tax_rate("tax_expense_ttm", "pretax_income_ttm", p),
        "_assets_avg": nonzero_or("assets_avg", "assets"),
        "_op": col("operating_income_ttm"),
        "_rev": col("revenue_ttm"),
    })
    d = d.withColumn("_eqp_avg", nonzero_or("equity_parent_avg", "_eqp"))
    d = d.withColumn("net_debt", F.when(col("equity").isNotNull(),
                                        col("liabilities") - F.coalesce("cash", F.lit(0.0))))
    d = d.withColumn("ebitda", col("_op") + col("da_ttm"))
    d = d.withColumn("equity_common", col("_eqp") - F.coalesce("hybrid_capital", F.lit(0.0)))
    d = d.withColumn("ev", col("market_cap") + col("net_debt"))
    invested = col("equity") + F.greatest(col("net_debt"), F.lit(0.0))
    norm_ni = col("_norm_margin") * col("_rev") * (1 - col("_tax"))
    d = d.withColumns({
        "roe": pct(div("_nip", "_eqp_avg")),
        "roa": pct(div("_ni", "_assets_avg")),
        "operating_margin": pct(div("_op", "_rev")),
        "net_margin": pct(div("_ni", "_rev")),
        "gp_to_assets": pct(div("gross_profit_ttm", "assets")),
        "roic": pct(div(col("_op") * (1 - col("_tax")), F.when(col("net_debt").isNotNull(), invested))),
        "debt_ratio": pct(div("liabilities", "equity")),
        "current_ratio": pct(div("current_assets", "current_liabilities")),
        "equity_ratio": pct(div("equity", "assets")),
        "ocf_to_ni": pct(div("ocf_ttm", "_nip")),
        "fcf_to_ni": pct(div("fcf_ttm", "_nip")),
        "ebit": col("_op"),
        "net_debt_ebit": div("net_debt", "_op"),
        "net_debt_ebitda": div("net_debt", "ebitda"),
        "per": div("market_cap", "_nip"),
        "hybrid_capital": F.nullif("hybrid_capital", F.lit(0.0)),
        "pbr": div("market_cap", "equity_common"),
        "psr": div("market_cap", "_rev"),
        "ev_ebit": div("ev", "_op"),
        "ev_ebitda": div("ev", "ebitda"),
        "eps": div("_nip", "shares_out"),
        "bps": div("equity_common", "shares_out"),
        "fcf_yield": pct(div("fcf_ttm", "market_cap")),
        "normalized_income": norm_ni,
    })
    d = d.withColumns({
        "normalized_per": div("market_cap", "normalized_income"),
        "peg": F.when(col("eps_cagr_3y") > 0, col("per") / col("eps_cagr_3y")),
        "currency": F.coalesce(F.nullif(F.upper(F.trim("currency")), F.lit("")), F.lit("KRW")),
    })
    d = d.drop("_ni", "_nip", "_eqp", "_eq_avg", "_tax", "_assets_avg", "_op", "_rev", "_eqp_avg",
               "_norm_margin")
    return mask_tracks(mask_currency(d))


def mask_currency(d: DataFrame) -> DataFrame:
    """Ratios of market value to foreign-currency statements are unknown, not wrong."""
    return d.withColumns({m: F.when(F.col("currency") == "KRW", F.col(m))
                          for m in spec.MIXED_UNIT_METRICS})


def mask_tracks(d: DataFrame) -> DataFrame:
    hidden: dict[str, list[str]] = {}
    for track, names in spec.TRACK_NULL_METRICS.items():
        for m in names:
            hidden.setdefault(m, []).append(track)
    return d.withColumns({m: F.when(~F.col("track").isin(*tracks), F.col(m))
                          for m, tracks in hidden.items() if m in d.columns})


def mask_distorted(d: DataFrame) -> DataFrame:
    return d.withColumns({m: F.when(~F.coalesce("stability_distorted", F.lit(False)), F.col(m))
                          for m in spec.DISTORTED_METRICS})


def winsorize(df: DataFrame, value: str, out: str, p: Params, keys: list[str] | None = None) -> DataFrame:
    """Clip to the outer percentiles of the group; groups below the minimum stay as they are."""
    keys = keys or []
    base = df if keys else df.withColumn("_all", F.lit(1))
    ks = keys or ["_all"]
    edges = exact_quantiles(base, ks, value, {"_lo": p.winsor_pct, "_hi": 1 - p.winsor_pct})
    n = base.groupBy(*ks).agg(F.count(value).alias("_n"))
    # one row per group; AQE broadcasts it when it is small
    d = base.join(edges.join(n, ks), ks, "left")
    clipped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    return (d.withColumn(out, F.when(F.col(value).isNotNull() & (F.col("_n") >= p.winsor_min), clipped)
                         .otherwise(F.col(value)))
             .drop("_lo", "_hi", "_n", "_all"))


def null_rates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.col(x).isNull().cast("double")).alias(x) for x in columns])


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


__all__ = ["history_features", "ratios", "winsorize", "null_rates", "mask_distorted", "null_double"]
