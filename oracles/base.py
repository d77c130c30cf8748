"""Common table expressions shared by the SQL of all queries, and their assembly."""

from __future__ import annotations

import re

from tidemark import spec
from tidemark.adapters import BROKERS, PARAMS as P

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(query: str) -> str:
    """Prefixes a query with the expressions it needs, in dependency order."""
    order: list[str] = []

    def need(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", sql)):
            if word in CTES and word not in order:
                if word in busy:
                    continue
                busy.add(word)
                need(CTES[word])
                order.append(word)

    busy: set[str] = set()
    need(query)
    sql = query.strip()
    if order:
        stored = lambda n: "" if re.search(rf"\b{n}\b", CTES[n]) else "MATERIALIZED "
        sql = "WITH RECURSIVE " + ",\n".join(f"{n} AS {stored(n)}(\n{CTES[n]}\n)" for n in order) + "\n" + sql
    return re.sub(r'(?<!")\basof\b(?!")', '"asof"', sql)  # a keyword in DuckDB


def r(expr: str, n: int = 6, name: str | None = None) -> str:
    """Rounded double; adding zero removes a negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {n}) + 0e0" + (f" AS {name}" if name else "")


def rs(*names: str, n: int = 6, prefix: str = "") -> str:
    return ", ".join(r(prefix + x, n, x) for x in names)


def ticker(k: str) -> str:
    pad = lambda x: f"CASE WHEN length(CAST({x} AS VARCHAR)) >= 5 THEN CAST({x} AS VARCHAR) ELSE lpad(CAST({x} AS VARCHAR), 5, '0') END"
    return f"CASE WHEN {k} % 10 = 3 THEN ({pad(f'({k}-1)')}) || '5' ELSE ({pad(k)}) || '0' END"


def d_iso(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d')" + (f" AS {name}" if name else "")


cte("px_all", """
SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice), 2) AS tv, sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2
""")
cte("prices", f"""
SELECT {ticker('k')} AS ticker, k AS key, date, tv / volume AS close_adj, volume, tv AS trading_value
FROM px_all
""")
cte("fq0", """
SELECT l_suppkey AS k, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter,
       round(sum(l_extendedprice), 2) AS q_ext,
       round(sum(l_extendedprice * (0.015e0 - l_discount + l_tax)), 6) AS q_op
FROM lineitem GROUP BY 1, 2, 3
""")
cte("fq1", """
SELECT *, year * 4 + quarter AS period,
       round(sum(q_ext) OVER (PARTITION BY k, year ORDER BY quarter), 2) AS ext,
       round(sum(q_op) OVER (PARTITION BY k, year ORDER BY quarter), 6) AS op,
       round(sum(q_op) OVER (PARTITION BY k ORDER BY year, quarter), 6) AS run_op
FROM fq0
""")
cte("fq2", """
SELECT f.*, s_nationkey AS nation,
       0.95e0 * op + 0.002e0 * ext AS pretax_income,
       (200000e0 + 10e0 * s_acctbal + 2e0 * run_op) * (CASE WHEN k % 6 = 1 AND period >= 1998*4+3 THEN 0.6e0
            WHEN k % 8 = 3 AND period >= 1999*4+2 THEN 1.8e0 ELSE 1e0 END) AS equity
FROM fq1 f JOIN supplier ON s_suppkey = k
""")
cte("fq3", """
SELECT *, pretax_income * ((10 + k % 60) / 100e0) AS tax_expense, equity * ((4 + 3 * (k % 8)) / 10e0) AS liabilities FROM fq2
""")
cte("fq4", """
SELECT *, pretax_income - tax_expense AS net_income, equity + liabilities AS assets FROM fq3
""")
cte("fin_quarterly", f"""
SELECT {ticker('k')} AS ticker, k, CAST(k AS VARCHAR) AS corp_code, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter,
  CAST(period AS INTEGER) AS period,
  CASE quarter WHEN 1 THEN '11013' WHEN 2 THEN '11012' WHEN 3 THEN '11014' ELSE '11011' END AS reprt_code,
  CAST(last_day(make_date(year, quarter * 3, 1)) + CAST(CASE WHEN k % 15 = 8 AND period = 1998*4+1 THEN 400 WHEN quarter = 4 THEN 90 ELSE 45 END AS INTEGER) AS DATE) AS rcept_dt,
  CASE nation % 7 WHEN 0 THEN 'USD' WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN 'krw' ELSE 'KRW' END AS currency,
  ext AS revenue, 0.3e0 * ext + 0.5e0 * op AS gross_profit, op AS operating_income, pretax_income, tax_expense, net_income,
  CASE WHEN k % 11 = 0 THEN 0e0 WHEN k % 13 = 1 THEN NULL ELSE 0.9e0 * net_income END AS net_income_parent,
  1.1e0 * net_income + 0.004e0 * ext AS ocf,
  CASE WHEN k % 9 <> 4 THEN 0.003e0 * ext END AS capex_tangible,
  CASE WHEN k % 4 = 2 THEN 0.0005e0 * ext END AS capex_intangible,
  CASE WHEN k % 5 = 0 THEN 0.01e0 * ext END AS depreciation,
  CASE WHEN k % 5 = 0 THEN 0e0 END AS amortization,
  assets, 0.4e0 * assets AS current_assets, liabilities, liabilities * ((3 + k % 5) / 10e0) AS current_liabilities, equity,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 0e0 ELSE 0.95e0 * equity END AS equity_parent,
  0.1e0 * assets AS cash, CASE WHEN k % 4 = 1 THEN 0.05e0 * equity END AS hybrid_capital
FROM fq4
""")

FLOW = spec.FLOW_FIELDS
STOCK = spec.STOCK_FIELDS
cte("ttm0", f"""
SELECT c.*, {', '.join(f"CASE WHEN c.quarter = 4 THEN c.{f} ELSE c.{f} + a.{f} - s.{f} END AS {f}_ttm" for f in FLOW)},
  row_number() OVER (PARTITION BY c.ticker ORDER BY c.period) AS rn
FROM fin_quarterly c
LEFT JOIN fin_quarterly a ON a.ticker = c.ticker AND a.year = c.year - 1 AND a.quarter = 4
LEFT JOIN fin_quarterly s ON s.ticker = c.ticker AND s.year = c.year - 1 AND s.quarter = c.quarter
""")
cte("ttm1", f"""
SELECT t.*, coalesce((t.equity + b.equity) / 2e0, t.equity) AS equity_avg,
  coalesce((t.equity_parent + b.equity_parent) / 2e0, t.equity_parent) AS equity_parent_avg,
  coalesce((t.assets + b.assets) / 2e0, t.assets) AS assets_avg,
  nullif(coalesce(t.capex_tangible_ttm, 0e0) + coalesce(t.capex_intangible_ttm, 0e0), 0e0) AS capex_ttm,
  nullif(coalesce(t.depreciation_ttm, 0e0) + coalesce(t.amortization_ttm, 0e0), 0e0) AS da_ttm
FROM ttm0 t LEFT JOIN ttm0 b ON b.ticker = t.ticker AND b.rn = t.rn - 4
""")
cte("ttm", "SELECT *, ocf_ttm - capex_ttm AS fcf_ttm FROM ttm1")

cte("tracks", f"""
SELECT {ticker('s_suppkey')} AS ticker, s_name AS name,
  CASE n_regionkey WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T4' ELSE 'T1' END AS track,
  lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS sector, s_suppkey % 14 = 6 AS stability_distorted
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
cte("market", """
SELECT ticker, 'C' || CAST(key AS VARCHAR) AS name, CASE WHEN key % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, date,
  CASE WHEN day(date) <> 13 THEN close_adj ELSE 0e0 END AS close,
  CASE WHEN day(date) <> 13 THEN close_adj * (1000 + 100 * (key % 50)) ELSE 0e0 END AS market_cap,
  1000 + 100 * (key % 50) AS shares_out, volume,
  CASE WHEN day(date) <> 13 THEN trading_value ELSE 0e0 END AS trading_value
FROM prices
""")
cte("rebal", """
SELECT make_date(y, m, d) AS asof FROM (SELECT unnest(range(year(min(date)), year(max(date)) + 1)) AS y, min(date) AS d0, max(date) AS d1 FROM prices),
 (VALUES (4, 5), (5, 20), (8, 20), (11, 20)) v(m, d) WHERE make_date(y, m, d) BETWEEN d0 AND d1
""")
cte("settled", """
SELECT market, date FROM market GROUP BY 1, 2 HAVING avg(CASE WHEN coalesce(close, 0) > 0 THEN 1e0 ELSE 0e0 END) > 0.5
""")
cte("price_days", f"""
SELECT asof, max(date) AS price_date FROM rebal JOIN settled ON market = 'KOSPI' AND date <= asof AND asof - date < {P.business_day_lookback} GROUP BY 1
""")
cte("liq_days", f"""
SELECT * FROM (SELECT asof, market, date, row_number() OVER (PARTITION BY asof, market ORDER BY date DESC) AS rn
  FROM rebal JOIN settled ON date <= asof AND asof - date < {P.liquidity_calendar_days}) WHERE rn <= {P.liquidity_days}
""")
cte("liq", """
SELECT asof, ticker, avg(trading_value) AS avg_trading_value FROM market JOIN liq_days USING (market, date) GROUP BY 1, 2
""")
cte("snap0", f"""
SELECT p.asof, p.price_date, m.*, avg_trading_value,
  CASE WHEN NOT m.ticker LIKE '%0' THEN 'preferred' WHEN market_cap IS NULL OR market_cap <= 0 THEN 'no_cap'
       WHEN market_cap < {P.min_market_cap}e0 THEN 'low_cap'
       WHEN avg_trading_value IS NULL OR avg_trading_value < {P.min_avg_trading_value}e0 THEN 'low_turnover' END AS reason,
  rank() OVER (PARTITION BY p.asof ORDER BY market_cap DESC NULLS LAST) AS cap_rank
FROM price_days p JOIN market m ON m.date = p.price_date LEFT JOIN liq l ON l.asof = p.asof AND l.ticker = m.ticker
""")
cte("snapshots", f"""
SELECT asof AS asof_date, price_date, ticker, name, market, close, market_cap, shares_out, volume, trading_value, avg_trading_value, cap_rank,
  reason IS NULL AND pos <= {P.universe_size} AS included,
  CASE WHEN reason IS NULL AND pos > {P.universe_size} THEN 'out_of_top' ELSE reason END AS excluded_reason
FROM (SELECT *, row_number() OVER (PARTITION BY asof, reason IS NULL ORDER BY market_cap DESC, ticker) AS pos FROM snap0)
""")

# ---- panel: every (ticker, month) by definition ------------------------------------------------
cte("months", """
SELECT CAST(d AS DATE) AS asof FROM (
  SELECT unnest(generate_series(date_trunc('month', min(date) + 400) + INTERVAL 4 DAY, date_trunc('month', max(date) - 94) + INTERVAL 4 DAY, INTERVAL 1 MONTH)) AS d FROM prices)
""")
cte("momo0", """
SELECT ticker, date, close_adj, volume, row_number() OVER w AS rn,
  lag(close_adj, 21) OVER w AS l21, lag(close_adj, 63) OVER w AS l63, lag(close_adj, 126) OVER w AS l126,
  avg(volume) OVER (w ROWS 4 PRECEDING) AS v5, avg(volume) OVER (w ROWS 59 PRECEDING) AS v60,
  max(close_adj) OVER (w ROWS 251 PRECEDING) AS hi, avg(close_adj) OVER (w ROWS 19 PRECEDING) AS ma,
  close_adj - lag(close_adj) OVER w AS diff, lead(close_adj, 63) OVER w AS f63,
  count(close_adj * volume) OVER (w ROWS 59 PRECEDING) AS n_tv, avg(close_adj * volume) OVER (w ROWS 59 PRECEDING) AS m_tv
FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)
""")
cte("momo1", """
SELECT *, avg(greatest(diff, 0e0)) OVER (w ROWS 13 PRECEDING) AS up, avg(greatest(-diff, 0e0)) OVER (w ROWS 13 PRECEDING) AS dn
FROM momo0 WINDOW w AS (PARTITION BY ticker ORDER BY date)
""")
cte("momo", """
SELECT ticker, date, close_adj, volume, rn AS price_days,
  CASE WHEN l21 > 0 THEN (close_adj / l21 - 1) * 100e0 END AS return_1m,
  CASE WHEN l63 > 0 THEN (close_adj / l63 - 1) * 100e0 END AS return_3m,
  CASE WHEN l126 > 0 THEN (close_adj / l126 - 1) * 100e0 END AS return_6m,
  CASE WHEN rn >= 60 AND v60 > 0 THEN v5 / v60 END AS volume_ratio,
  CASE WHEN rn >= 252 AND hi > 0 THEN close_adj / hi * 100e0 END AS pos_52w,
  CASE WHEN rn >= 20 AND ma > 0 THEN close_adj / ma * 100e0 END AS disparity_20,
  CASE WHEN rn >= 15 THEN CASE WHEN dn = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1 + up / dn) END END AS rsi_14,
  CASE WHEN close_adj > 0 THEN (f63 / close_adj - 1) * 100e0 END AS fwd_63,
  CASE WHEN n_tv >= 20 THEN m_tv END AS avg_tv
FROM momo1
""")
cte("px_asof", "SELECT m.asof, p.* FROM (SELECT asof, ticker FROM months, (SELECT DISTINCT ticker FROM prices)) m ASOF JOIN momo p ON m.ticker = p.ticker AND m.asof >= p.date")
cte("shares_asof", """
SELECT m.asof, s.ticker, s.shares_out FROM (SELECT asof, ticker FROM months, (SELECT DISTINCT ticker FROM snapshots)) m
ASOF JOIN (SELECT * FROM snapshots WHERE shares_out IS NOT NULL) s ON m.ticker = s.ticker AND m.asof >= s.asof_date WHERE s.shares_out > 0
""")


def history(src: str, part: str, order_filter: str = "") -> str:
    """History features of the latest period per partition, computed over that partition only."""
    yo = lambda c: f"CASE WHEN last(b4.{c}) > 0 THEN 1 END"  # noqa: E731, F841
    return f"""
SELECT * FROM (
 SELECT *, max(period) OVER (PARTITION BY {part}) AS newest,
   stddev_pop(yoy) OVER vol AS vol_sd, count(yoy) OVER vol AS vol_n,
   avg(margin) OVER norm AS norm_avg, count(margin) OVER norm AS norm_n,
   max(yoy) OVER (wp RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS y1,
   max(yoy) OVER (wp RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS y2,
   max(yoy) OVER (wp RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS y3
 FROM (
  SELECT v.*, CASE WHEN b.revenue_ttm > 0 THEN v.revenue_ttm / b.revenue_ttm - 1 END AS yoy,
   CASE WHEN b.operating_income_ttm > 0 THEN v.operating_income_ttm / b.operating_income_ttm - 1 END AS op_yoy,
   CASE WHEN b.net_income_ttm > 0 THEN v.net_income_ttm / b.net_income_ttm - 1 END AS ni_yoy,
   CASE WHEN c.revenue_ttm > 0 AND v.revenue_ttm > 0 THEN pow(v.revenue_ttm / c.revenue_ttm, 1e0 / 3e0) - 1 END AS rev_cagr,
   CASE WHEN c.net_income_parent_ttm > 0 AND v.net_income_parent_ttm > 0 THEN pow(v.net_income_parent_ttm / c.net_income_parent_ttm, 1e0 / 3e0) - 1 END AS eps_cagr,
   CASE WHEN v.revenue_ttm <> 0 THEN v.operating_income_ttm / v.revenue_ttm END AS margin
  FROM {src} v
  LEFT JOIN {src} b ON {' AND '.join(f'b.{x.strip()} = v.{x.strip()}' for x in part.split(','))} AND b.period = v.period - 4
  LEFT JOIN {src} c ON {' AND '.join(f'c.{x.strip()} = v.{x.strip()}' for x in part.split(','))} AND c.period = v.period - 12)
 WINDOW wp AS (PARTITION BY {part} ORDER BY period),
   vol AS (PARTITION BY {part} ORDER BY period RANGE BETWEEN {P.growth_vol_quarters - 1} PRECEDING AND CURRENT ROW),
   norm AS (PARTITION BY {part} ORDER BY period RANGE BETWEEN {P.normalize_quarters - 1} PRECEDING AND CURRENT ROW))
"""


cte("visible", "SELECT m.asof, t.* FROM months m JOIN ttm t ON t.rcept_dt <= m.asof")
cte("hist", history("visible", "asof, ticker") + "WHERE period = newest")


def ratio_sql(src: str) -> str:
    """Metrics of rows with TTM and history columns plus market_cap, shares_out, track."""
    m = {
        "roe": "CASE WHEN eqp_avg > 0 THEN nip / eqp_avg * 100e0 END",
        "roa": "CASE WHEN as_avg > 0 THEN net_income_ttm / as_avg * 100e0 END",
        "operating_margin": "CASE WHEN revenue_ttm > 0 THEN operating_income_ttm / revenue_ttm * 100e0 END",
        "net_margin": "CASE WHEN revenue_ttm > 0 THEN net_income_ttm / revenue_ttm * 100e0 END",
        "gp_to_assets": "CASE WHEN assets > 0 THEN gross_profit_ttm / assets * 100e0 END",
        "net_debt": "nd",
        "roic": "CASE WHEN nd IS NOT NULL AND equity + greatest(nd, 0e0) > 0 THEN operating_income_ttm * (1 - tax) / (equity + greatest(nd, 0e0)) * 100e0 END",
        "debt_ratio": "CASE WHEN equity > 0 THEN liabilities / equity * 100e0 END",
        "current_ratio": "CASE WHEN current_liabilities > 0 THEN current_assets / current_liabilities * 100e0 END",
        "equity_ratio": "CASE WHEN assets > 0 THEN equity / assets * 100e0 END",
        "ocf_to_ni": "CASE WHEN nip > 0 THEN ocf_ttm / nip * 100e0 END",
        "fcf_to_ni": "CASE WHEN nip > 0 THEN fcf_ttm / nip * 100e0 END",
        "ebitda": "operating_income_ttm + da_ttm",
        "net_debt_ebit": "CASE WHEN operating_income_ttm > 0 THEN nd / operating_income_ttm END",
        "net_debt_ebitda": "CASE WHEN operating_income_ttm + da_ttm > 0 THEN nd / (operating_income_ttm + da_ttm) END",
        "per": "CASE WHEN nip > 0 THEN market_cap / nip END",
        "pbr": "CASE WHEN eqc > 0 THEN market_cap / eqc END",
        "psr": "CASE WHEN revenue_ttm > 0 THEN market_cap / revenue_ttm END",
        "ev": "market_cap + nd",
        "ev_ebit": "CASE WHEN operating_income_ttm > 0 THEN (market_cap + nd) / operating_income_ttm END",
        "ev_ebitda": "CASE WHEN operating_income_ttm + da_ttm > 0 THEN (market_cap + nd) / (operating_income_ttm + da_ttm) END",
        "eps": "CASE WHEN shares_out > 0 THEN nip / shares_out END",
        "bps": "CASE WHEN shares_out > 0 THEN eqc / shares_out END",
        "fcf_yield": "CASE WHEN market_cap > 0 THEN fcf_ttm / market_cap * 100e0 END",
        "revenue_growth_yoy": "yoy * 100e0", "op_growth_yoy": "op_yoy * 100e0", "ni_growth_yoy": "ni_yoy * 100e0",
        "revenue_cagr_3y": "rev_cagr * 100e0", "eps_cagr_3y": "eps_cagr * 100e0",
        "growth_volatility": f"CASE WHEN vol_n >= {P.growth_vol_min} THEN vol_sd * 100e0 END",
        "growth_acceleration": f"CASE WHEN vol_n >= {P.growth_vol_min} THEN ((yoy + y1) / 2e0 - (y2 + y3) / 2e0) * 100e0 END",
        "normalized_income": "nni",
        "normalized_per": "CASE WHEN nni > 0 THEN market_cap / nni END",
        "peg": "CASE WHEN eps_cagr > 0 AND nip > 0 THEN market_cap / nip / (eps_cagr * 100e0) END",
    }
    for x in spec.MIXED_UNIT_METRICS:
        m[x] = f"CASE WHEN cur = 'KRW' THEN {m[x]} END"
    for track, names in spec.TRACK_NULL_METRICS.items():
        for x in names:
            if x in m:
                m[x] = f"CASE WHEN track <> '{track}' THEN {m[x]} END"
    return f"""
SELECT b.* EXCLUDE (currency, hybrid_capital), {', '.join(f'{v} AS {k}' for k, v in m.items())}, cur AS currency, nullif(hybrid_capital, 0e0) AS hybrid_capital
FROM (
 SELECT a.*, coalesce(nullif(equity_parent_avg, 0e0), eqp) AS eqp_avg, eqp - coalesce(hybrid_capital, 0e0) AS eqc,
   CASE WHEN norm_n >= {P.normalize_min} THEN norm_avg END * revenue_ttm * (1 - tax) AS nni
 FROM (
  SELECT s.*, coalesce(nullif(net_income_parent_ttm, 0e0), net_income_ttm) AS nip,
    coalesce(nullif(equity_parent, 0e0), equity) AS eqp, coalesce(nullif(assets_avg, 0e0), assets) AS as_avg,
    CASE WHEN pretax_income_ttm > 0 AND tax_expense_ttm / pretax_income_ttm BETWEEN 0 AND 0.5e0 THEN tax_expense_ttm / pretax_income_ttm ELSE 0.22e0 END AS tax,
    CASE WHEN equity IS NOT NULL THEN liabilities - coalesce(cash, 0e0) END AS nd,
    coalesce(nullif(upper(trim(currency)), ''), 'KRW') AS cur
  FROM {src} s) a) b
"""


cte("panel_in", """
SELECT h.*, p.close_adj AS price_asof, p.date AS price_date, p.price_days, p.return_1m, p.return_3m, p.return_6m, p.volume_ratio,
  p.pos_52w, p.disparity_20, p.rsi_14, p.fwd_63, p.avg_tv, s.shares_out, p.close_adj * s.shares_out AS market_cap,
  coalesce(t.track, 'T1') AS track, coalesce(t.sector, '00') AS sector
FROM hist h JOIN px_asof p ON p.asof = h.asof AND p.ticker = h.ticker
JOIN shares_asof s ON s.asof = h.asof AND s.ticker = h.ticker LEFT JOIN tracks t ON t.ticker = h.ticker
""")
cte("ratios", ratio_sql("panel_in"))


def grade_sql(src: str, date: str = "asof") -> dict[str, str]:
    """Peer groups, long metric ranks and category scores over `src`; returns named steps."""
    def members(track: str | None) -> list[tuple[str, str, float, int]]:
        cats = {**spec.CATEGORIES, **spec.TRACK_CATEGORIES.get(track, {})}
        return [(c, m, w, s) for c, ms in cats.items() for m, w, s in ms]

    longs = []
    for track, cond in (("T2", "track = 'T2'"), ("T3", "track = 'T3'"), ("T4", "track = 'T4'"),
                        (None, "track NOT IN ('T2', 'T3', 'T4')")):
        for c, m, w, s in members(track):
            longs.append(f"SELECT {date}, ticker, track, peer, '{c}' AS cat, '{m}' AS metric, {w}e0 AS w, {s} AS sign, CAST({m} AS DOUBLE) AS v FROM {{peers}} WHERE {cond} AND {m} IS NOT NULL")
    peers = f"""
SELECT *, CASE WHEN count(*) OVER (PARTITION BY {date}, track, sector) >= CASE WHEN track = 'T2' THEN {P.min_peers_finance} ELSE {P.min_peers} END
  THEN sector ELSE '__TRACK__' END AS peer FROM {src}
"""
    ranked = f"""
SELECT *, CASE WHEN sign > 0 THEN p ELSE 100e0 - p END AS pct FROM (
 SELECT *, (rank() OVER (PARTITION BY {date}, track, peer, metric ORDER BY v) + (count(*) OVER (PARTITION BY {date}, track, peer, metric, v) - 1) / 2e0)
   / count(*) OVER (PARTITION BY {date}, track, peer, metric) * 100e0 AS p,
   count(*) OVER (PARTITION BY {date}, track, peer, metric) AS n FROM {{long}}) WHERE n >= {P.min_ranked}
"""
    cols = ", ".join(f"round(sum(CASE WHEN cat = '{c}' THEN pct * w END) / sum(CASE WHEN cat = '{c}' THEN w END), 10) AS {c}_score, "
                     f"round(coalesce(sum(CASE WHEN cat = '{c}' THEN w END), 0), 2) AS {c}_n" for c in spec.CATEGORY_NAMES)
    letter = lambda x: f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} >= {c} THEN '{g}'" for c, g in spec.GRADE_CUTS) + " ELSE 'D' END"
    final = f"""
SELECT q.*, {', '.join(f's.{c}_score, coalesce(s.{c}_n, 0e0) AS {c}_n, {letter(f"s.{c}_score")} AS {c}_grade' for c in spec.CATEGORY_NAMES)},
  round(coalesce((s.profitability_score + s.stability_score) / 2e0, s.profitability_score, s.stability_score), 10) AS quality_score, 5 AS coverage,
  {' + '.join(f'CASE WHEN s.{c}_score IS NOT NULL THEN 1 ELSE 0 END' for c in spec.CATEGORY_NAMES)} AS scores_present
FROM {{peers}} q LEFT JOIN (SELECT {date}, ticker, {cols} FROM {{ranked}} GROUP BY 1, 2) s ON s.{date} = q.{date} AND s.ticker = q.ticker
"""
    return {"peers": peers, "long": "\nUNION ALL ".join(longs), "ranked": ranked, "final": final}


_g = grade_sql("ratios")
cte("pn_peers", _g["peers"])
cte("pn_long", _g["long"].format(peers="pn_peers"))
cte("pn_ranked", _g["ranked"].format(long="pn_long"))
cte("panel", _g["final"].format(peers="pn_peers", ranked="pn_ranked"))


def mix(w: dict[str, float], prefix: str = "") -> str:
    num = " + ".join(f"coalesce({prefix}{c}_score, 0e0) * {float(v)}e0" for c, v in w.items())
    den = " + ".join(f"CASE WHEN {prefix}{c}_score IS NOT NULL THEN {float(v)}e0 ELSE 0e0 END" for c, v in w.items())
    return f"round(CASE WHEN {den} > 0 THEN ({num}) / ({den}) END, 10)"


# ---- gates --------------------------------------------------------------------------------------
cte("gf0", """
SELECT t.*, lag(revenue_ttm, 4) OVER (PARTITION BY ticker ORDER BY period) AS rev_l4,
  sum(CASE WHEN quarter = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY period) AS yr_no FROM ttm t
""")


def gate_feature_sql(src: str, part: str) -> str:
    """Features of every filing by joining its last three annual rows."""
    on = " AND ".join(f"y.{x.strip()} = f.{x.strip()}" for x in part.split(","))
    keys = ", ".join(f"f.{x.strip()}" for x in part.split(","))
    return f"""
SELECT {keys}, f.period, any_value(f.rcept_dt) AS rcept_dt,
  CAST(count(*) FILTER (WHERE y.operating_income_ttm < 0) AS INTEGER) AS op_loss_years_3y,
  CAST(count(*) FILTER (WHERE y.fcf_ttm > 0) AS INTEGER) AS fcf_pos_years_3y,
  CAST(count(y.period) AS INTEGER) AS annual_count,
  any_value(f.gq) AS rev_growth_q_of_4,
  count(y.revenue_ttm) >= 3 AND max(CASE WHEN y.yr_no = f.yr_no - 1 THEN y.revenue_ttm END) < max(CASE WHEN y.yr_no = f.yr_no - 2 THEN y.revenue_ttm END)
    AND max(CASE WHEN y.yr_no = f.yr_no THEN y.revenue_ttm END) < max(CASE WHEN y.yr_no = f.yr_no - 1 THEN y.revenue_ttm END) AS revenue_decline_3y,
  count(*) FILTER (WHERE y.yr_no >= f.yr_no - 1 AND y.net_income_ttm > 0 AND y.ocf_ttm / y.net_income_ttm < 0.5e0) >= 2 AS ocf_quality_bad_2y
FROM (SELECT *, CAST(sum(CASE WHEN rev_l4 > 0 AND revenue_ttm > rev_l4 THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY period ROWS 3 PRECEDING) AS INTEGER) AS gq FROM {src}) f
LEFT JOIN {src} y ON {on} AND y.quarter = 4 AND y.yr_no BETWEEN f.yr_no - 2 AND f.yr_no AND y.yr_no > 0
GROUP BY {keys}, f.period
"""


cte("gate_feats", gate_feature_sql("gf0", "ticker"))
cte("gate_asof", """
SELECT m.asof, g.* FROM (SELECT asof, ticker FROM months, (SELECT DISTINCT ticker FROM ttm)) m
ASOF JOIN (SELECT * FROM gate_feats QUALIFY row_number() OVER (PARTITION BY ticker, rcept_dt ORDER BY period DESC) = 1) g
ON m.ticker = g.ticker AND m.asof >= g.rcept_dt
""")


def fails(strategy: str, policy: str, p: str = "") -> dict[str, str]:
    panel = policy == "panel"
    yrs = f"coalesce({p}annual_count, 0)" if panel else f"{p}annual_count"
    cap = f"coalesce({p}market_cap, 0)" if panel else f"{p}market_cap"
    gq = f"coalesce({p}rev_growth_q_of_4, 0)" if panel else f"{p}rev_growth_q_of_4"
    fy = f"coalesce({p}fcf_pos_years_3y, 9)" if panel else f"{p}fcf_pos_years_3y"
    if strategy == "value":
        d = {"op_loss": f"{yrs} >= 3 AND {p}op_loss_years_3y > 1", "debt_ratio": f"{p}debt_ratio > 200",
             "fcf_years": f"{yrs} >= 3 AND {fy} < 2", "roe": f"{p}roe < 8", "market_cap": f"{cap} < {P.value_cap_floor}e0",
             "valuation": f"{p}valuation_score < 60", "quality": f"{p}quality_score < 50"}
    else:
        d = {"growth_score": f"{p}growth_score IS NULL OR {p}growth_score < 80", "growth_quarters": f"{gq} < 3",
             "current_ratio": f"{p}current_ratio < 100", "market_cap": f"{cap} < {P.growth_cap_floor}e0"}
    return {k: f"coalesce({v}, false)" for k, v in d.items()}


def fail_list(strategy: str, policy: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in fails(strategy, policy).items()) + "], lambda x: x IS NOT NULL)"


cte("feat_in", """
SELECT p.*, g.op_loss_years_3y, g.fcf_pos_years_3y, g.annual_count, g.rev_growth_q_of_4, g.revenue_decline_3y, g.ocf_quality_bad_2y
FROM panel p LEFT JOIN (SELECT asof AS g_asof, ticker AS g_ticker, * EXCLUDE (asof, ticker, period, rcept_dt) FROM gate_asof) g ON g_asof = asof AND g_ticker = ticker
""")
cte("gp_in", "SELECT *, avg(fwd_63) OVER (PARTITION BY asof) AS mkt FROM feat_in WHERE fwd_63 IS NOT NULL")
cte("cur0", "\nUNION ALL ".join(f"SELECT *, '{s}' AS strategy, {mix(w)} AS score, {fail_list(s, 'panel')} AS gate_fails FROM feat_in" for s, w in spec.STRATEGY_WEIGHTS.items()))
cte("current_rows", "SELECT *, len(gate_fails) = 0 AS pass FROM cur0")
cte("gp0", "\nUNION ALL ".join(
    f"SELECT *, fwd_63 - mkt AS excess, '{s}' AS strategy, {mix(w)} AS score, {fail_list(s, 'panel')} AS gate_fails FROM gp_in"
    for s, w in spec.STRATEGY_WEIGHTS.items()))
cte("gate_panel", "SELECT *, len(gate_fails) = 0 AS pass FROM gp0 WHERE score IS NOT NULL")
cte("prep0", f"""
SELECT *, rank() OVER (PARTITION BY asof, strategy ORDER BY market_cap DESC) AS cap_rank FROM gate_panel
""")
cte("prep1", f"""
SELECT *, coalesce(market_cap >= {P.min_market_cap}e0 AND coalesce(avg_tv, 0) >= {P.min_avg_trading_value}e0 AND cap_rank <= {P.universe_size}, false) AS in_universe FROM prep0
""")
cte("bench3", "SELECT asof, strategy, avg(fwd_63) AS b_univ, sum(fwd_63 * market_cap) / sum(market_cap) AS b_cap FROM prep1 WHERE in_universe GROUP BY 1, 2")
cte("prepared", "SELECT p.*, b_univ, b_cap, fwd_63 - b_univ AS exc_univ, fwd_63 - b_cap AS exc_cap FROM prep1 p LEFT JOIN bench3 b ON b.asof = p.asof AND b.strategy = p.strategy")
cte("asofs", "SELECT DISTINCT asof FROM prepared")
cte("ret_asof", "SELECT m.asof, p.ticker, p.date, p.close_adj, lead(m.asof) OVER (PARTITION BY m.ticker ORDER BY m.asof) AS nxt FROM (SELECT asof, ticker FROM asofs, (SELECT DISTINCT ticker FROM prices)) m ASOF JOIN prices p ON m.ticker = p.ticker AND m.asof >= p.date")
cte("ret0", "SELECT *, lead(date) OVER w AS d1, lead(close_adj) OVER w AS c1 FROM ret_asof WINDOW w AS (PARTITION BY ticker ORDER BY asof)")
cte("monthly_returns", f"SELECT asof, ticker, (c1 / close_adj - 1) * 100e0 AS ret_m FROM ret0 WHERE d1 > date AND d1 - date <= {P.return_gap_days}")


def two_sided(t: str) -> str:
    """Two-sided normal p-value by the published Chebyshev fit of erfc."""
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = f"(abs({t}) / sqrt(2e0))"
    u = f"(1e0 / (1e0 + 0.5e0 * {z}))"
    poly = f"{c[-1]}e0"
    for a in reversed(c[:-1]):
        poly = f"({a}e0 + {u} * {poly})"
    return f"({u} * exp(-{z} * {z} + {poly}))"


__all__ = ["cte", "with_ctes", "r", "rs", "ticker", "d_iso", "BROKERS", "P"]
