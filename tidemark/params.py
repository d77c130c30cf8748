"""All thresholds of the library in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # -- fixed values: universe --------------------------------------------
    universe_size: int = 200
    min_market_cap: float = 5.0e11
    min_avg_trading_value: float = 5.0e9
    liquidity_days: int = 5
    liquidity_calendar_days: int = 20
    business_day_lookback: int = 12
    # -- fixed values: tax, normalisation, volatility -------------------------
    default_tax_rate: float = 0.22
    tax_rate_low: float = 0.0
    tax_rate_high: float = 0.50
    normalize_quarters: int = 20
    normalize_min: int = 8
    growth_vol_quarters: int = 8
    growth_vol_min: int = 4
    winsor_pct: float = 0.01
    winsor_min: int = 20
    # -- fixed values: loss and cash flags --------------------------------------
    loss_doubt: int = 2
    loss_fail: int = 3
    critical_debt_ratio: float = 200.0
    runway_danger: float = 4.0
    runway_warn: float = 8.0
    restructure_drop: float = 0.20
    restructure_rise: float = 0.50
    restructure_explained: float = 1.2
    restructure_carry: int = 3
    # -- fixed values: tracks ---------------------------------------------------
    holding_finance_debt_ratio: float = 500.0
    finance_segment_min_ratio: float = 0.10
    stability_distort_debt_ratio: float = 150.0
    # -- fixed values: grading --------------------------------------------------
    min_peers: int = 8
    min_peers_finance: int = 4
    min_ranked: int = 3
    missing_sector_warn: float = 0.05
    # -- fixed values: gates ------------------------------------------------------
    value_cap_floor: float = 5.0e11
    growth_cap_floor: float = 3.0e11
    # -- fixed values: verdicts and deferral -------------------------------------
    score_buy: float = 78.0
    score_hold: float = 62.0
    score_trim: float = 52.0
    breadth_drop: float = 5.0
    breadth_market: float = 0.40
    breadth_sector: float = 0.50
    fundamental_tol: float = 0.25
    max_defer_months: int = 6
    # -- fixed values: portfolio ----------------------------------------------------
    top_n: int = 5
    cost_pct: float = 0.35
    extension_days: int = 20  # a ticker whose prices end earlier is fetched again
    delist_gap_days: int = 180
    return_gap_days: int = 120
    turnover_rows: int = 60
    turnover_min_rows: int = 20
    stale_months: float = 18.0
    stale_share: float = 0.10
    ic_min_pairs: int = 20
    # -- fixed values: style --------------------------------------------------------
    style_top_pct: float = 0.20
    style_min: int = 5
    style_min_scored: int = 10
    style_tilt_points: float = 3.0
    # -- fixed values: text consensus ------------------------------------------------
    mention_window_days: int = 90
    mention_dedupe_days: int = 14
    min_brokers: int = 3
    min_pool: int = 10
    band_low: float = 0.5
    band_high: float = 3.0
    consensus_months: int = 6
    gap_rank: int = 2
    # -- fixed values: ledger ---------------------------------------------------------
    min_hold_days: int = 15
    max_price_lag_days: int = 7

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
