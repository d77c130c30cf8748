"""SQL of each registered query. Bodies name their columns; shaping is shared."""

from __future__ import annotations

from oracles.base import P, cte, fail_list, grade_sql, history, mix, ratio_sql, two_sided, with_ctes
from tidemark import spec
from tidemark.adapters import RAW_ACCOUNTS
from tidemark.catalog import COLUMNS

BODY: dict[str, str] = {}


def _rounded(x: str) -> str:
    return (f"CASE WHEN abs({x}) < 1e5 THEN round({x} + 3.1e-8, 6) WHEN abs({x}) < 1e9 THEN round({x} + 3.1e-4, 2) "
            f"ELSE round({x} + 31e0, -3) END + 0e0")


def shape_sql(name: str, body: str) -> str:
    def one(col: str, kind: str) -> str:
        q = f'"{col}"'
        x = {"f": _rounded(f"CAST({q} AS DOUBLE)"), "i": f"CAST({q} AS BIGINT)", "d": f"strftime({q}, '%Y-%m-%d')",
             "b": f"CAST({q} AS BOOLEAN)", "a": f"array_to_string({q}, '|')", "e": f"printf('%.8e', CAST({q} AS DOUBLE))"}.get(kind, f"CAST({q} AS VARCHAR)")
        return f"{x} AS {q}"
    return with_ctes(f"SELECT {', '.join(one(c, k) for c, k in COLUMNS[name])} FROM (\n{body.strip()}\n)")


def oracle_sql() -> dict[str, str]:
    return {name: shape_sql(name, body) for name, body in BODY.items() if name in COLUMNS}


# ---- sources and statements -------------------------------------------------------------------
BODY["keep_last_union"] = """
SELECT * FROM (SELECT ticker, date, close_adj, volume, 0 AS store FROM prices WHERE date < DATE '2001-01-01'
 UNION ALL SELECT ticker, date, close_adj * 1.01e0, volume, 1 FROM prices WHERE date >= DATE '1999-01-01')
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY store DESC) = 1
"""


def _text(f: str) -> str:
    n = f"round({f}, 0)"
    body = f"format('{{:,.0f}}', abs({n}))"
    return f"CASE WHEN {n} IS NULL THEN '-' WHEN {n} < 0 AND quarter % 2 = 0 THEN '(' || {body} || ')' WHEN {n} < 0 THEN '-' || {body} ELSE {body} END"


def _raw_line(i: int, field: str, sj: str, aid: str, nm: str) -> str:
    flow = field in spec.FLOW_FIELDS
    full, half = _text(field), _text(f"{field} / 2e0")
    this = f"CASE WHEN quarter = 4 THEN {full} ELSE {half} END" if flow else full
    add = f"CASE WHEN quarter = 4 THEN '' ELSE {full} END" if flow else "''"
    return (f"SELECT ticker, corp_code, year AS bsns_year, quarter, reprt_code, CASE WHEN corp_code LIKE '%9' THEN 'OFS' ELSE 'CFS' END AS fs_div, currency, "
            f"{i} AS ord, '{sj}' AS sj_div, '{aid}' AS account_id, '{nm}' AS account_nm, {this} AS this_amt, {add} AS add_amt FROM fin_quarterly")


def _parse(x: str) -> str:
    v = f"TRY_CAST(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN trim({x}) IN ('', '-', '--', 'nan', 'None') THEN NULL WHEN {x} LIKE '(%)' THEN -{v} ELSE {v} END"


cte("raw_rows", "\nUNION ALL ".join(_raw_line(i, *a) for i, a in enumerate(RAW_ACCOUNTS)))
BODY["amount_parse"] = f"""
SELECT ticker, bsns_year, count(*) AS n_rows, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE x < 0) AS n_negative, sum(x) AS total
FROM (SELECT ticker, bsns_year, {_parse('this_amt')} AS x FROM raw_rows) GROUP BY 1, 2
"""
_ids = " ".join(f"WHEN '{a}' THEN '{f}'" for a, f in spec.ACCOUNT_IDS.items())
_home = " ".join(f"WHEN '{f}' THEN sj_div IN ({', '.join(repr(s) for s in sj)})" for f, sj, _ in spec.ACCOUNT_NAMES)
_names = " ".join(f"WHEN sj_div IN ({', '.join(repr(s) for s in sj)}) AND ({' OR '.join(f'regexp_matches(nm, {chr(39)}{p}{chr(39)})' for p in pats)}) THEN '{f}'"
                  for f, sj, pats in spec.ACCOUNT_NAMES)
cte("acc0", f"SELECT *, CASE account_id {_ids} END AS by_id, regexp_replace(account_nm, '[\\s()]', '', 'g') AS nm, {_parse('this_amt')} AS a0, {_parse('add_amt')} AS a1 FROM raw_rows")
cte("acc1", f"""
SELECT *, CASE WHEN by_id IS NOT NULL THEN CASE WHEN CASE by_id {_home} END THEN by_id END
  WHEN regexp_matches(account_id, '{spec.EXCLUDED_ID_TOKENS}') OR regexp_matches(nm, '{spec.EXCLUDED_NAMES}') THEN NULL
  ELSE CASE {_names} END END AS field FROM acc0
""")
cte("acc", f"""
SELECT *, CASE WHEN field IN ({', '.join(repr(s) for s in spec.STOCK_FIELDS)}) THEN a0 WHEN field IS NULL THEN NULL
  WHEN reprt_code = '11011' THEN a0 ELSE coalesce(a1, a0) END AS val FROM acc1
""")
_pick = ", ".join(
    (f"sum(abs(val)) FILTER (WHERE field = '{f}') AS {f}" if f in spec.CAPEX_FIELDS else
     f"first(val ORDER BY ord) FILTER (WHERE field = '{f}' AND val IS NOT NULL) AS {f}") for f in spec.FLOW_FIELDS + spec.STOCK_FIELDS)
cte("wide", f"""
SELECT ticker, corp_code, bsns_year, quarter, reprt_code, fs_div, coalesce(min(nullif(trim(currency), '')), 'KRW') AS currency, {_pick}
FROM acc GROUP BY ALL
""")
BODY["account_map"] = "SELECT * FROM wide"
BODY["fin_quarterly"] = """
SELECT w.*, w.bsns_year AS year, q.period, q.rcept_dt FROM wide w JOIN fin_quarterly q ON q.ticker = w.ticker AND q.year = w.bsns_year AND q.quarter = w.quarter
"""
BODY["ttm"] = "SELECT * FROM ttm"
BODY["single_quarter"] = """
SELECT c.ticker, c.period, """ + ", ".join(
    f"CASE WHEN c.quarter = 1 THEN c.{f} ELSE c.{f} - p.{f} END AS {f}_q" for f in ("revenue", "operating_income", "net_income", "ocf")) + """
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY quarter) AS rn FROM fin_quarterly) c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY quarter) AS rn FROM fin_quarterly) p ON p.ticker = c.ticker AND p.year = c.year AND p.rn = c.rn - 1
"""
cte("snap_last", f"""
SELECT * FROM snapshots WHERE asof_date <= (SELECT max(asof) FROM months) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY asof_date DESC) = 1
""")
cte("corps", "SELECT DISTINCT corp_code, ticker, k FROM (SELECT CAST(s_suppkey AS VARCHAR) AS corp_code, s_suppkey AS k FROM supplier) JOIN (SELECT DISTINCT k AS k2, ticker FROM fin_quarterly) ON k2 = k")
cte("shares_net", """
SELECT c.ticker, c.shares_out AS shares_common, a.st AS shares_total, c.market_cap AS market_cap_common, a.mt AS market_cap_total,
  a.st > c.shares_out AS has_preferred, coalesce(tr, 0) AS treasury, tr IS NOT NULL AS treasury_known,
  greatest(a.st - coalesce(tr, 0), 1) AS shares_outstanding, coalesce(tr, 0) / CAST(a.st AS DOUBLE) AS treasury_ratio
FROM snap_last c JOIN (SELECT substr(ticker, 1, length(ticker) - 1) AS root, sum(shares_out) AS st, sum(market_cap) AS mt FROM snap_last GROUP BY 1) a
  ON a.root = substr(c.ticker, 1, length(c.ticker) - 1)
LEFT JOIN (SELECT ticker, CASE WHEN k % 3 <> 0 THEN (k * 7) % 2000 END AS tr FROM corps) t ON t.ticker = c.ticker
WHERE c.ticker LIKE '%0'
""")
BODY["share_rollup"] = "SELECT * FROM shares_net"

# ---- universe ------------------------------------------------------------------------------------
BODY["universe_snapshots"] = "SELECT * FROM snapshots"
BODY["ever_included"] = "SELECT DISTINCT ticker FROM snapshots WHERE included"
BODY["prev_settled"] = "SELECT asof, price_date FROM price_days"

# ---- prices --------------------------------------------------------------------------------------
BODY["momentum_asof"] = "SELECT asof, * EXCLUDE (asof), close_adj AS price_asof, date AS price_date FROM px_asof"
BODY["overheated"] = """
SELECT ticker, date, list_filter([CASE WHEN disparity_20 >= 130 THEN 'disparity' END, CASE WHEN rsi_14 >= 80 THEN 'rsi' END,
  CASE WHEN pos_52w >= 99 AND rsi_14 >= 75 THEN 'high_52w' END], lambda x: x IS NOT NULL) AS signals FROM momo
WHERE disparity_20 >= 130 OR rsi_14 >= 80 OR (pos_52w >= 99 AND rsi_14 >= 75)
"""
BODY["rolling_turnover"] = "SELECT ticker, date, avg_tv FROM momo WHERE avg_tv IS NOT NULL"
BODY["fwd_returns"] = """
SELECT m.asof, m.ticker, """ + ", ".join(f"(c{h} / b.close_adj - 1) * 100e0 AS fwd_{h}" for h in (21, 63, 126)) + """
FROM (SELECT asof, ticker FROM months, (SELECT DISTINCT ticker FROM prices)) m
ASOF JOIN (SELECT ticker, date, close_adj, """ + ", ".join(f"lead(close_adj, {h}) OVER (PARTITION BY ticker ORDER BY date) AS c{h}" for h in (21, 63, 126)) + """ FROM momo0) b
  ON m.ticker = b.ticker AND m.asof >= b.date
WHERE b.close_adj > 0
"""

# ---- metrics and flags -----------------------------------------------------------------------------
cte("ttm_one", "SELECT *, 1 AS one FROM ttm")
cte("hist_all", history("ttm_one", "ticker, one"))
BODY["growth_metrics"] = f"""
SELECT ticker, period, yoy * 100e0 AS revenue_growth_yoy, op_yoy * 100e0 AS op_growth_yoy, ni_yoy * 100e0 AS ni_growth_yoy,
  rev_cagr * 100e0 AS revenue_cagr_3y, eps_cagr * 100e0 AS eps_cagr_3y, CASE WHEN vol_n >= {P.growth_vol_min} THEN vol_sd * 100e0 END AS growth_volatility,
  CASE WHEN vol_n >= {P.growth_vol_min} THEN ((yoy + y1) / 2e0 - (y2 + y3) / 2e0) * 100e0 END AS growth_acceleration,
  CASE WHEN norm_n >= {P.normalize_min} THEN norm_avg END AS norm_margin FROM hist_all
"""


def streak_sql(src: str) -> str:
    return f"""
SELECT a.ticker, count(*) FILTER (WHERE a.year > coalesce(s.stop, -1)) AS loss_streak FROM {src} a
LEFT JOIN (SELECT ticker, max(year) AS stop FROM {src} WHERE operating_income_ttm IS NULL OR operating_income_ttm >= 0 GROUP BY 1) s ON s.ticker = a.ticker GROUP BY 1
"""


def restructure_sql(src: str) -> str:
    return f"""
SELECT ticker, period + c AS period, c AS carried, CASE WHEN c = 0 THEN chg END AS equity_change, CASE WHEN c = 0 THEN achg END AS assets_change
FROM (SELECT *, equity - pe AS delta, (equity - pe) / abs(pe) AS chg, (assets - pa) / abs(pa) AS achg FROM (
  SELECT ticker, period, equity, assets, net_income_ttm, lag(equity) OVER w AS pe, lag(assets) OVER w AS pa FROM {src} WINDOW w AS (PARTITION BY ticker ORDER BY period))),
  (SELECT unnest([0, 1, 2, 3]) AS c)
WHERE achg * chg > 0 AND abs(achg) > 0.1e0 AND (chg < -0.2e0 OR (chg > 0.5e0 AND NOT coalesce(delta <= abs(net_income_ttm) * 1.2e0, false)))
"""


cte("ttm_annual", "SELECT * FROM ttm WHERE quarter = 4")
cte("streaks", streak_sql("ttm_annual"))
cte("events_rs", restructure_sql("ttm"))
BODY["loss_streak"] = "SELECT * FROM streaks"
BODY["restructure"] = "SELECT * FROM events_rs"
BODY["cash_runway"] = """
SELECT ticker, period, cash / (-ocf_ttm / 4e0) AS runway, CASE WHEN cash / (-ocf_ttm / 4e0) < 4 THEN 'D' WHEN cash / (-ocf_ttm / 4e0) < 8 THEN 'C' END AS grade
FROM ttm WHERE -ocf_ttm / 4e0 > 0 AND cash IS NOT NULL
"""
BODY["load_report"] = """
SELECT m.ticker, coalesce(q.n, 0) AS rows, coalesce(t.n, 0) AS ttm_rows, coalesce(s.loss_streak, 0) AS loss_streak, coalesce(e.n, 0) AS restructure,
  CASE WHEN c.corp_code IS NULL THEN 'skip' WHEN q.n IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT DISTINCT ticker FROM snapshots WHERE included) m LEFT JOIN corps c ON c.ticker = m.ticker
LEFT JOIN (SELECT ticker, count(*) AS n FROM fin_quarterly GROUP BY 1) q ON q.ticker = m.ticker
LEFT JOIN (SELECT ticker, count(*) AS n FROM ttm GROUP BY 1) t ON t.ticker = m.ticker
LEFT JOIN streaks s ON s.ticker = m.ticker LEFT JOIN (SELECT ticker, count(*) AS n FROM events_rs WHERE carried = 0 GROUP BY 1) e ON e.ticker = m.ticker
"""
cte("annual_last", "SELECT * FROM fin_quarterly WHERE quarter = 4 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY year DESC) = 1")
BODY["latest_annual"] = "SELECT * FROM annual_last"
BODY["latest_received"] = """
SELECT ticker, period, rcept_dt, revenue_ttm FROM ttm WHERE rcept_dt <= DATE '1999-06-05' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY rcept_dt DESC, period) = 1
"""
BODY["track_assignment"] = f"""
SELECT *, fa >= 0.1e0 AND track = 'T1' AS has_finance_segment, coalesce(fa >= 0.1e0 AND track = 'T1' AND debt_ratio > 150, false) AS stability_distorted, fa AS finance_asset_ratio
FROM (SELECT *, CASE WHEN code LIKE '64992%' AND debt_ratio > 500 THEN 'T2' WHEN code LIKE '64992%' AND debt_ratio IS NULL AND regexp_matches(s_name, '{spec.FINANCE_NAME}') THEN 'T2'
   WHEN code LIKE '64992%' THEN 'T4' WHEN substr(code, 1, 2) IN ('64', '65', '66') THEN 'T2' WHEN substr(code, 1, 2) = '21' THEN 'T3'
   WHEN debt_ratio > 1000 AND fa >= 0.1e0 THEN 'T2' ELSE 'T1' END AS track,
   CASE WHEN code LIKE '64992%' AND debt_ratio > 500 THEN 'holding_debt' WHEN code LIKE '64992%' AND debt_ratio IS NULL AND regexp_matches(s_name, '{spec.FINANCE_NAME}') THEN 'holding_name'
   WHEN code LIKE '64992%' THEN 'holding' WHEN substr(code, 1, 2) IN ('64', '65', '66') THEN 'finance' WHEN substr(code, 1, 2) = '21' THEN 'pharma'
   WHEN debt_ratio > 1000 AND fa >= 0.1e0 THEN 'debt_override' WHEN debt_ratio > 1000 THEN 'no_finance_assets' WHEN code = '' THEN 'no_code' ELSE 'industry' END AS track_reason
 FROM (SELECT c.ticker, s.s_name, coalesce(CASE s.s_suppkey % 8 WHEN 0 THEN '64992' WHEN 1 THEN '651' WHEN 2 THEN '21101' WHEN 3 THEN '26110' WHEN 4 THEN '' WHEN 5 THEN NULL
     ELSE CAST(20 + s.s_suppkey % 12 AS VARCHAR) || '111' END, '') AS code,
   CASE WHEN a.equity > 0 THEN a.liabilities * CASE WHEN s.s_suppkey % 5 = 1 THEN 6e0 ELSE 1e0 END / a.equity * 100e0 END AS debt_ratio,
   coalesce(CASE WHEN s.s_suppkey % 6 = 0 THEN (round(abs(a.assets * 0.5e0), 0) + round(abs(a.assets * 0.1e0), 0)) ELSE 0 END / nullif(a.assets, 0), 0e0) AS fa
  FROM supplier s JOIN corps c ON c.k = s.s_suppkey LEFT JOIN annual_last a ON a.ticker = c.ticker))
"""
cte("lm_vis", f"SELECT *, 1 AS one FROM ttm WHERE rcept_dt <= (SELECT max(asof) FROM months)")
cte("lm_hist", "SELECT * FROM (" + history("lm_vis", "ticker, one") + ") WHERE period = newest")
cte("lm_px", f"SELECT * FROM momo WHERE date <= (SELECT max(asof) FROM months) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
cte("lm_in", """
SELECT h.*, s.market_cap_total AS market_cap, s.shares_outstanding AS shares_out, s.treasury_ratio, t.track, t.sector, t.stability_distorted
FROM lm_hist h JOIN (SELECT DISTINCT ticker FROM snapshots WHERE included) m ON m.ticker = h.ticker
JOIN shares_net s ON s.ticker = h.ticker JOIN tracks t ON t.ticker = h.ticker
""")
cte("lm_ratio", ratio_sql("lm_in"))
cte("lm_annual", "SELECT * FROM lm_vis WHERE quarter = 4")
cte("lm_streak", streak_sql("lm_annual"))
cte("lm_rs", restructure_sql("lm_vis"))
_masked = ", ".join(f"CASE WHEN NOT stability_distorted THEN {x} END AS {x}" for x in spec.DISTORTED_METRICS)
cte("lm_mask", f"SELECT * REPLACE ({_masked}) FROM lm_ratio")
cte("metrics_latest", f"""
SELECT r.*, r.year AS fin_year, r.quarter AS fin_quarter, coalesce(k.loss_streak, 0) AS loss_streak,
  CASE WHEN track = 'T3' OR coalesce(k.loss_streak, 0) = 0 THEN NULL WHEN debt_ratio > 200 AND ocf_ttm < 0 THEN 'CRITICAL'
    WHEN k.loss_streak >= 3 THEN 'STRUCT_FAIL' WHEN k.loss_streak >= 2 THEN 'STRUCT_DOUBT' ELSE 'TEMP_LOSS' END AS loss_flag,
  NOT EXISTS (SELECT 1 FROM lm_rs e WHERE e.ticker = r.ticker AND e.period = r.period) AS ttm_reliable,
  p.return_3m, p.disparity_20, p.return_1m, p.return_6m, p.volume_ratio, p.rsi_14, p.pos_52w, p.close_adj AS price_asof
FROM lm_mask r LEFT JOIN lm_streak k ON k.ticker = r.ticker LEFT JOIN lm_px p ON p.ticker = r.ticker
""")
BODY["metric_core"] = "SELECT * FROM metrics_latest"
BODY["null_rates"] = "SELECT track, count(*) AS n, " + ", ".join(
    f"avg(CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END) AS {x}" for x in ("per", "pbr", "roe", "operating_margin", "debt_ratio", "fcf_to_ni", "revenue_growth_yoy", "ev_ebit")) + " FROM metrics_latest GROUP BY 1"
BODY["winsorized"] = f"""
SELECT p.asof, p.ticker, per, CASE WHEN per IS NOT NULL AND n >= {P.winsor_min} THEN least(greatest(per, lo), hi) ELSE per END AS per_w FROM panel p
JOIN (SELECT asof AS a, count(per) AS n, quantile_cont(per, 0.01) AS lo, quantile_cont(per, 0.99) AS hi FROM panel GROUP BY 1) e ON e.a = p.asof
"""

# ---- grades and scores ------------------------------------------------------------------------------
BODY["panel"] = "SELECT *, period AS fin_period FROM panel"
BODY["grades"] = "SELECT * FROM panel"
BODY["average_rank"] = """
SELECT asof, ticker, CASE WHEN pbr IS NOT NULL THEN (rank() OVER (PARTITION BY asof, pbr IS NULL ORDER BY pbr) + (count(*) OVER (PARTITION BY asof, pbr) - 1) / 2e0) / count(pbr) OVER (PARTITION BY asof) * 100e0 END AS pct,
  rank() OVER (PARTITION BY asof ORDER BY market_cap DESC) AS cap_rank FROM panel
"""
BODY["missing_sector"] = "SELECT *, missing_share > 0.05e0 AS warn FROM (SELECT asof, count(*) AS n, avg(CASE WHEN sector = '00' THEN 1e0 ELSE 0e0 END) AS missing_share FROM panel GROUP BY 1)"
BODY["gate_features"] = "SELECT * FROM gate_feats"


def score_sql(src: str) -> str:
    pens = {"value": [("revenue_decline", "revenue_decline_3y", -15), ("cash_quality", "ocf_quality_bad_2y", -15), ("value_trap", "pbr < 0.5e0 AND roe < 5", -20)],
            "growth": [("slowdown", "growth_acceleration < -10", -15), ("peg_high", "peg >= 3", -20), ("peg_low", "peg <= 1", 5)]}
    out = []
    for s, w in spec.STRATEGY_WEIGHTS.items():
        rules = [*pens[s], ("restructured", "NOT ttm_reliable", -10)]
        pen = " + ".join(f"CASE WHEN coalesce({c}, false) THEN {v}e0 ELSE 0e0 END" for _, c, v in rules)
        why = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in rules) + "], lambda x: x IS NOT NULL)"
        cov = " + ".join(f"CASE WHEN {c}_score IS NOT NULL THEN 1 ELSE 0 END" for c in w)
        out.append(f"SELECT * EXCLUDE (score, strategy, gate_fails), '{s}' AS strategy, {mix(w)} AS base_score, {pen} AS penalty, {mix(w)} + {pen} AS score, "
                   f"{fail_list(s, 'lenient')} AS gate_fails, {why} AS penalty_why, {cov} AS wcov FROM {src}")
    return "SELECT * EXCLUDE (wcov, coverage), wcov AS coverage, len(gate_fails) = 0 AS gate_pass FROM (" + "\nUNION ALL ".join(out) + ")"


cte("sc_in", "SELECT p.*, NOT EXISTS (SELECT 1 FROM events_rs e WHERE e.ticker = p.ticker AND e.period = p.period) AS ttm_reliable FROM current_rows p WHERE strategy = 'value'")
cte("scored", score_sql("sc_in"))
BODY["strategy_scores"] = "SELECT * FROM scored"
BODY["gate_panel"] = "SELECT * FROM gate_panel"
BODY["prepared_panel"] = "SELECT * FROM prepared"

# ---- validation -----------------------------------------------------------------------------------------
_sig = [(c, f"{c}_score") for c in spec.CATEGORY_NAMES] + [("raw_" + m, f"{m} * {float(s)}e0") for m, s in spec.RAW_SIGNALS] + [
    (f"{s}_mix", mix(w)) for s, w in spec.STRATEGY_WEIGHTS.items()]
cte("ic_rows", "\nUNION ALL ".join(f"SELECT asof, ticker, '{n}' AS signal, CAST({x} AS DOUBLE) AS x, fwd_63 AS y FROM panel WHERE fwd_63 IS NOT NULL AND {x} IS NOT NULL" for n, x in _sig))
cte("ic_ranks", """
SELECT *, rank() OVER (PARTITION BY signal, asof ORDER BY x) + (count(*) OVER (PARTITION BY signal, asof, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY signal, asof ORDER BY y) + (count(*) OVER (PARTITION BY signal, asof, y) - 1) / 2e0 AS ry FROM ic_rows
""")
cte("ics", f"SELECT * FROM (SELECT signal, asof, count(*) AS n, corr(rx, ry) AS ic FROM ic_ranks GROUP BY 1, 2 HAVING count(*) >= {P.ic_min_pairs} AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1)")
BODY["ic_by_month"] = "SELECT * FROM ics"
BODY["ic_summary"] = """
SELECT *, CASE WHEN abs(mean_ic) < 0.02e0 THEN 'none' WHEN mean_ic < 0 AND abs(mean_ic) >= 0.03e0 THEN 'reversed' WHEN mean_ic < 0 THEN 'weakly reversed'
  WHEN mean_ic >= 0.1e0 THEN 'strong' WHEN mean_ic >= 0.05e0 THEN 'useful' ELSE 'weak' END AS verdict
FROM (SELECT signal, avg(ic) AS mean_ic, median(ic) AS median_ic, avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) * 100e0 AS positive_pct, count(*) AS months FROM ics GROUP BY 1)
"""
cte("mid", "SELECT asof AS m FROM (SELECT asof, row_number() OVER (ORDER BY asof) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT asof FROM panel WHERE fwd_63 IS NOT NULL)) WHERE i = n // 2")
BODY["ic_halves"] = f"""
SELECT *, first_half * second_half > 0 AS stable FROM (SELECT signal, avg(ic) FILTER (WHERE asof < m) AS first_half, avg(ic) FILTER (WHERE asof >= m) AS second_half
FROM ics, mid WHERE signal IN ({', '.join(repr(c) for c in spec.CATEGORY_NAMES)}) GROUP BY 1) WHERE first_half IS NOT NULL AND second_half IS NOT NULL
"""
BODY["quintiles"] = f"""
SELECT *, q5 - q1 AS spread FROM (SELECT signal, count(*) AS n, {', '.join(f'avg(y) FILTER (WHERE q = {i}) AS q{i}' for i in range(1, 6))} FROM (
 SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(5 * (pos - 1) / CAST(n - 1 AS DOUBLE))) END AS q FROM (
  SELECT *, row_number() OVER (PARTITION BY signal, asof ORDER BY x, ticker) AS pos, count(*) OVER (PARTITION BY signal, asof) AS n FROM ic_rows
  WHERE signal IN ({', '.join(repr(c) for c in spec.CATEGORY_NAMES)}))) GROUP BY 1 HAVING count(*) >= 500) WHERE q5 - q1 IS NOT NULL
"""


def clustered_sql(src: str, by: str, ret: str, exc: str) -> str:
    keys = [x.strip() for x in by.split(",")]
    on = " AND ".join(f"g.{k} = m.{k}" for k in keys)
    return f"""
SELECT *, {two_sided('t')} AS p FROM (
 SELECT g.*, months, CASE WHEN months >= 3 AND sd > 0 THEN mm / (sd / sqrt(CAST(months AS DOUBLE))) END AS t
 FROM (SELECT {by}, count(*) AS n, avg({ret}) AS mean_ret, avg({exc}) AS mean_excess, avg(CASE WHEN {ret} > 0 THEN 1e0 ELSE 0e0 END) * 100e0 AS win_rate FROM {src} GROUP BY {by}) g
 JOIN (SELECT {by}, count(mx) AS months, avg(mx) AS mm, stddev_samp(mx) AS sd FROM (SELECT {by}, asof, avg({exc}) AS mx FROM {src} GROUP BY {by}, asof) GROUP BY {by}) m ON {on})
"""


def topn(src: str, by: str, n: int = P.top_n, score: str = "score") -> str:
    return f"SELECT * FROM {src} WHERE {score} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {by}, asof ORDER BY {score} DESC, ticker) <= {n}"


cte("ge", "SELECT *, CASE WHEN pass THEN 'pass' ELSE 'fail' END AS \"group\" FROM gate_panel")
BODY["gate_effect"] = clustered_sql("ge", 'strategy, "group"', "fwd_63", "excess")
cte("gmodes", "SELECT *, 'off' AS gate FROM gate_panel UNION ALL SELECT *, 'on' FROM gate_panel WHERE pass")
cte("gtop", topn("gmodes", "strategy, gate"))
BODY["gate_topn"] = clustered_sql("gtop", "strategy, gate", "fwd_63", "excess")
_gates = {"value": ["op_loss", "debt_ratio", "fcf_years", "roe", "market_cap", "valuation", "quality"], "growth": ["growth_score", "growth_quarters", "current_ratio", "market_cap"]}
cte("abl", "\nUNION ALL ".join(f"SELECT *, '{g}' AS skipped FROM gate_panel WHERE strategy = '{s}' AND len(list_filter(gate_fails, lambda x: x <> '{g}')) = 0"
                               for s, gs in _gates.items() for g in ["none", *gs]))
cte("abl_top", topn("abl", "strategy, skipped"))
BODY["gate_ablation"] = """
SELECT a.strategy, a.skipped, a.n, a.mean_excess, a.mean_excess - f.mean_excess AS change, r.c * 100e0 / t.c AS pass_rate
FROM (SELECT strategy, skipped, count(*) AS n, avg(excess) AS mean_excess FROM abl_top GROUP BY 1, 2) a
JOIN (SELECT strategy, skipped, count(*) AS c FROM abl GROUP BY 1, 2) r ON r.strategy = a.strategy AND r.skipped = a.skipped
JOIN (SELECT strategy, count(*) AS c FROM gate_panel GROUP BY 1) t ON t.strategy = a.strategy
LEFT JOIN (SELECT strategy, avg(excess) AS mean_excess FROM abl_top WHERE skipped = 'none' GROUP BY 1) f ON f.strategy = a.strategy
"""
cte("rates", "SELECT strategy, asof, avg(CASE WHEN pass THEN 1e0 ELSE 0e0 END) * 100e0 AS rate, any_value(mkt) AS mkt FROM gate_panel GROUP BY 1, 2")


def link_sql(src: str, by: str, x: str, y: str, lo: str, hi: str, min_n: int = 0) -> str:
    return f"""
SELECT *, {two_sided('t')} AS p FROM (SELECT *, CASE WHEN months > 2 THEN rank_corr * sqrt((months - 2) / greatest(1e-9, 1 - rank_corr * rank_corr)) END AS t FROM (
 SELECT {by}, count(*) AS months, CASE WHEN count(*) > {min_n} AND count(DISTINCT {x}) > 1 AND count(DISTINCT {y}) > 1 THEN corr(rx, ry) END AS rank_corr,
  avg({y}) FILTER (WHERE {x} <= e0) AS low_third, avg({y}) FILTER (WHERE {x} >= e1) AS high_third
 FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0 AS rx,
   rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2e0 AS ry,
   quantile_cont({x}, {lo}) OVER (PARTITION BY {by}) AS e0, quantile_cont({x}, {hi}) OVER (PARTITION BY {by}) AS e1
  FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {by}))
"""


BODY["pass_rate_link"] = link_sql("rates", "strategy", "rate", "mkt", "0.33", "0.67", 5)
BODY["pass_rate_bins"] = """
SELECT strategy, bin, count(*) AS months, min(rate) AS lo, max(rate) AS hi, avg(mkt) AS mkt FROM (
 SELECT *, CASE WHEN rate <= e[1] THEN 1 WHEN rate <= e[2] THEN 2 WHEN rate <= e[3] THEN 3 WHEN rate <= e[4] THEN 4 ELSE 5 END AS bin
 FROM (SELECT *, quantile_cont(rate, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY strategy) AS e FROM rates)) GROUP BY 1, 2
"""
BODY["gate_by_year"] = """
SELECT p.strategy, p.year, t.on_excess, t.off_excess, t.on_excess - t.off_excess AS diff, p.passing
FROM (SELECT strategy, year(asof) AS year, avg(n) AS passing FROM (SELECT strategy, asof, count(*) FILTER (WHERE pass) AS n FROM gate_panel GROUP BY 1, 2) GROUP BY 1, 2) p
JOIN (SELECT strategy, year(asof) AS year, avg(excess) FILTER (WHERE gate = 'on') AS on_excess, avg(excess) FILTER (WHERE gate = 'off') AS off_excess FROM gtop GROUP BY 1, 2) t
ON t.strategy = p.strategy AND t.year = p.year
"""
BODY["cap_quintiles"] = """
SELECT strategy, q, median(market_cap) AS median_cap, avg(excess) AS mean_excess, avg(CASE WHEN fwd_63 > 0 THEN 1e0 ELSE 0e0 END) * 100e0 AS win_rate, count(*) AS n FROM (
 SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(5 * (pos - 1) / CAST(n - 1 AS DOUBLE))) END AS q FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy, asof ORDER BY market_cap, ticker) AS pos, count(*) OVER (PARTITION BY strategy, asof) AS n FROM gate_panel)) GROUP BY 1, 2
"""
cte("liq_floor", "SELECT g.*, f AS floor FROM gate_panel g, (SELECT unnest([0e0, 1e4, 2e4, 3e4, 5e4, 1e5]) AS f) WHERE coalesce(avg_tv, 0) >= f")
cte("liq_top", topn("liq_floor", "strategy, floor"))
BODY["liquidity_floors"] = clustered_sql("liq_top", "strategy, floor", "fwd_63", "excess")
cte("reg_m", "SELECT strategy, asof, any_value(b_univ) AS bu FROM prepared WHERE in_universe GROUP BY 1, 2")
cte("reg", "SELECT strategy, asof, CASE WHEN bu <= e0 THEN 'down' WHEN bu <= e1 THEN 'flat' ELSE 'up' END AS regime FROM (SELECT *, quantile_cont(bu, 1e0/3) OVER (PARTITION BY strategy) AS e0, quantile_cont(bu, 2e0/3) OVER (PARTITION BY strategy) AS e1 FROM reg_m)")
cte("reg_rows", "SELECT p.*, r.regime FROM prepared p JOIN reg r ON r.strategy = p.strategy AND r.asof = p.asof WHERE in_universe")
cte("reg_modes", "SELECT *, 'off' AS gate FROM reg_rows UNION ALL SELECT *, 'on' FROM reg_rows WHERE pass")
cte("reg_top", topn("reg_modes", "strategy, gate"))
BODY["gate_by_regime"] = """
SELECT b.strategy, b.regime, b.universe, b.months, t.on_excess, t.off_excess FROM
 (SELECT strategy, regime, avg(b_univ) AS universe, count(DISTINCT asof) AS months FROM reg_rows GROUP BY 1, 2) b JOIN
 (SELECT strategy, regime, avg(exc_univ) FILTER (WHERE gate = 'on') AS on_excess, avg(exc_univ) FILTER (WHERE gate = 'off') AS off_excess FROM reg_top GROUP BY 1, 2) t
 ON t.strategy = b.strategy AND t.regime = b.regime
"""
cte("pred_m", """
SELECT asof, avg(CASE WHEN pass THEN 1e0 ELSE 0e0 END) FILTER (WHERE strategy = 'growth') AS growth_pass, avg(CASE WHEN rev_growth_q_of_4 >= 3 THEN 1e0 ELSE 0e0 END) FILTER (WHERE strategy = 'growth') AS diffusion,
  avg(CASE WHEN pass THEN 1e0 ELSE 0e0 END) FILTER (WHERE strategy = 'value') AS value_pass, max(b_univ) FILTER (WHERE strategy = 'growth') AS market
FROM prepared WHERE in_universe GROUP BY 1
""")
cte("preds", "\nUNION ALL ".join(f"SELECT asof, market, '{x}' AS predictor, {x} AS x FROM pred_m" for x in ("growth_pass", "diffusion", "value_pass")))
BODY["predictors"] = link_sql("preds", "predictor", "x", "market", "1e0/3", "2e0/3")
cte("pred_half", "SELECT *, CASE WHEN row_number() OVER (ORDER BY asof) <= count(*) OVER () // 2 THEN 'first' ELSE 'second' END AS half FROM preds WHERE predictor = 'diffusion' AND x IS NOT NULL AND market IS NOT NULL")
BODY["predictor_halves"] = link_sql("pred_half", "half", "x", "market", "1e0/3", "2e0/3")

# ---- portfolio ---------------------------------------------------------------------------------------------
BODY["monthly_returns"] = "SELECT * FROM monthly_returns"
cte("gone", f"SELECT ticker, max(date) AS last_date FROM prices GROUP BY 1 HAVING (SELECT max(date) FROM prices) - max(date) > {P.delist_gap_days}")
BODY["haircut_returns"] = """
SELECT m.asof, m.ticker, CASE WHEN g.ticker IS NOT NULL AND m.asof = max(m.asof) OVER (PARTITION BY m.ticker) THEN ((1 + ret_m / 100e0) * 0.5e0 - 1) * 100e0 ELSE ret_m END AS ret_m
FROM monthly_returns m LEFT JOIN gone g ON g.ticker = m.ticker
"""
BODY["delisted"] = "SELECT * FROM gone"
cte("bench", """
SELECT a.asof, coalesce(eq, 0e0) AS eq, coalesce(cw, 0e0) AS cw FROM asofs a LEFT JOIN (
 SELECT u.asof, avg(ret_m) AS eq, sum(ret_m * market_cap) / sum(market_cap) AS cw FROM (SELECT DISTINCT asof, ticker, market_cap FROM prepared WHERE in_universe) u
 JOIN monthly_returns r ON r.asof = u.asof AND r.ticker = u.ticker GROUP BY 1) b ON b.asof = a.asof
""")
BODY["benchmarks"] = "SELECT * FROM bench"


def simulate_sql(picks: str, runs: str, run: str) -> dict[str, str]:
    """Step names: <picks>_legs, _book, _state, _sim. The carried book is found by an as-of join."""
    keys = [x.strip() for x in run.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    sel = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    cte(f"{picks}_legs", f"SELECT p.*, r.ret_m FROM {picks} p JOIN monthly_returns r ON r.asof = p.asof AND r.ticker = p.ticker")
    cte(f"{picks}_book", f"""
SELECT {sel('f')}, f.asof, p.n AS picked, l.n, l.gross, CASE WHEN p.n IS NULL THEN [] ELSE l.members END AS state
FROM (SELECT * FROM {runs}, asofs) f
LEFT JOIN (SELECT {run}, asof, count(*) AS n FROM {picks} GROUP BY ALL) p ON {on('p', 'f')} AND p.asof = f.asof
LEFT JOIN (SELECT {run}, asof, count(*) AS n, avg(ret_m) AS gross, list(ticker) AS members FROM {picks}_legs GROUP BY ALL) l ON {on('l', 'f')} AND l.asof = f.asof
""")
    cte(f"{picks}_state", f"""
SELECT b.*, coalesce(s.state, []) AS prev FROM {picks}_book b
ASOF LEFT JOIN (SELECT * FROM {picks}_book WHERE state IS NOT NULL) s ON {on('b', 's')} AND b.asof > s.asof
""")
    cte(f"{picks}_net", f"""
SELECT {run}, asof, coalesce(n, 0) AS n, coalesce(gross, 0e0) AS gross,
  CASE WHEN n > 0 THEN len(list_filter(state, lambda x: NOT list_contains(prev, x))) / CAST(n AS DOUBLE) ELSE 0e0 END AS turnover,
  coalesce(gross, 0e0) - CASE WHEN n > 0 THEN {P.cost_pct}e0 * (len(list_filter(state, lambda x: NOT list_contains(prev, x))) + len(list_filter(prev, lambda x: NOT list_contains(state, x)))) / n ELSE 0e0 END AS ret
FROM {picks}_state
""")
    cte(f"{picks}_sim", f"SELECT *, product(1 + ret / 100e0) OVER (PARTITION BY {run} ORDER BY asof) AS equity FROM {picks}_net")
    return {"sim": f"{picks}_sim", "legs": f"{picks}_legs"}


def summary_sql(sim: str, run: str, part: str) -> str:
    return f"""
SELECT *, {two_sided('t')} AS p FROM (SELECT *, CASE WHEN total > -100 THEN (pow(1 + total / 100e0, 12e0 / months) - 1) * 100e0 END AS cagr,
  CASE WHEN months >= 3 AND sd > 0 THEN excess / (sd / sqrt(CAST(months AS DOUBLE))) END AS t FROM (
 SELECT {part}, count(*) AS months, (product(1 + ret / 100e0) - 1) * 100e0 AS total, (product(1 + gross / 100e0) - 1) * 100e0 AS gross_total, (product(1 + eq / 100e0) - 1) * 100e0 AS bench_total,
  min(e / top_e - 1) * 100e0 AS mdd, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) * 100e0 AS win_rate, avg(turnover) AS turnover, avg(ret - eq) AS excess, stddev_samp(ret - eq) AS sd
 FROM (SELECT *, max(e) OVER (PARTITION BY {part} ORDER BY asof) AS top_e FROM (
   SELECT *, product(1 + ret / 100e0) OVER (PARTITION BY {part} ORDER BY asof) AS e FROM (
    SELECT s.*, b.eq, year(s.asof) AS year FROM {sim} s JOIN bench b ON b.asof = s.asof))) GROUP BY {part}))
"""


cte("u_modes", "SELECT *, 'off' AS gate FROM prepared WHERE in_universe UNION ALL SELECT *, 'on' FROM prepared WHERE in_universe AND pass")
cte("runs", topn("u_modes", "strategy, gate"))
cte("run_list", "SELECT * FROM (VALUES ('value', 'on'), ('value', 'off'), ('growth', 'on'), ('growth', 'off')) v(strategy, gate)")
simulate_sql("runs", "run_list", "strategy, gate")
BODY["topn_performance"] = "SELECT * FROM runs_sim"
BODY["performance_summary"] = summary_sql("runs_sim", "strategy, gate", "strategy, gate")
BODY["performance_by_year"] = summary_sql("runs_sim", "strategy, gate", "strategy, gate, year")
BODY["trade_stats"] = """
SELECT *, abs(avg_win / nullif(avg_loss, 0)) AS payoff, -avg_loss / nullif(avg_win - avg_loss, 0) * 100e0 AS breakeven FROM (
SELECT strategy, gate, count(*) AS n, avg(CASE WHEN ret_m > 0 THEN 1e0 ELSE 0e0 END) * 100e0 AS win_rate, avg(ret_m) FILTER (WHERE ret_m > 0) AS avg_win, avg(ret_m) FILTER (WHERE NOT ret_m > 0) AS avg_loss FROM runs_legs GROUP BY 1, 2)
"""


def concentration_sql(legs: str, run: str) -> str:
    return f"""
SELECT {run}, sum(k) AS n, count(*) AS names, sum(c) / sum(k) AS base, {', '.join(f'sum(c) FILTER (WHERE rk > {d}) / sum(k) FILTER (WHERE rk > {d}) AS without_{d}' for d in (1, 3, 5))}
FROM (SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY c DESC, ticker) AS rk FROM (SELECT {run}, ticker, round(sum(ret_m), 8) AS c, count(*) AS k FROM {legs} GROUP BY ALL)) GROUP BY {run}
"""


BODY["concentration"] = concentration_sql("runs_legs", "strategy, gate")
_fs = {"pbr": "100e0 - pbr_p", "per": "100e0 - per_p"}
_fs.update({c: f"{c}_score" for c in ("valuation", "profitability", "growth", "stability")})
for _s, _w in spec.STRATEGY_WEIGHTS.items():
    _fs[f"{_s}_mix"] = mix(_w)
    _fs[f"{_s}_mix_no_valuation"] = mix({k: v for k, v in _w.items() if k != "valuation"})


def _low_pct(x: str) -> str:
    v = f"CASE WHEN {x} > 0 THEN {x} END"
    return (f"CASE WHEN {x} > 0 THEN (rank() OVER (PARTITION BY asof, coalesce({x} > 0, false) ORDER BY {x}) + (count(*) OVER (PARTITION BY asof, {v}) - 1) / 2e0) / count({v}) OVER (PARTITION BY asof) * 100e0 END")


cte("race_in", f"SELECT *, {_low_pct('pbr')} AS pbr_p, {_low_pct('per')} AS per_p FROM prepared WHERE strategy = 'value' AND in_universe")
cte("race_sig", "\nUNION ALL ".join(f"SELECT asof, ticker, '{n}' AS signal, round({x}, 8) AS sscore FROM race_in WHERE {x} IS NOT NULL" for n, x in _fs.items()))
cte("race_rk", "SELECT *, row_number() OVER (PARTITION BY signal, asof ORDER BY sscore DESC, ticker) AS rk FROM race_sig")
cte("race", "SELECT r.*, t AS top FROM race_rk r, (SELECT unnest([3, 5, 10, 20]) AS t) WHERE rk <= t")
cte("race_list", "SELECT s AS signal, t AS top FROM (SELECT unnest([" + ", ".join(repr(x) for x in _fs) + "]) AS s), (SELECT unnest([3, 5, 10, 20]) AS t)")
simulate_sql("race", "race_list", "signal, top")
BODY["factor_race"] = summary_sql("race_sim", "signal, top", "signal, top")
BODY["race_eras"] = """
SELECT *, CASE WHEN early > bench_early AND late > bench_late THEN 'both' WHEN early > bench_early THEN 'early' WHEN late > bench_late THEN 'late' ELSE 'none' END AS beats FROM (
SELECT signal, top, """ + ", ".join(f"(coalesce(product(1 + {x} / 100e0) FILTER (WHERE {c}), 1e0) - 1) * 100e0 AS {n}" for x, c, n in (
    ("ret", "year(s.asof) < 1999", "early"), ("ret", "year(s.asof) >= 1999", "late"), ("eq", "year(s.asof) < 1999", "bench_early"), ("eq", "year(s.asof) >= 1999", "bench_late"))) + """
FROM race_sim s JOIN bench b ON b.asof = s.asof GROUP BY 1, 2)
"""
BODY["race_concentration"] = concentration_sql("race_legs", "signal, top")
cte("sets", "SELECT strategy, gate, asof, list(ticker) AS cur FROM runs GROUP BY ALL")
BODY["signal_turnover"] = """
SELECT t.*, new_per_month * 12e0 AS new_per_year, e.names_ever FROM (
 SELECT a.strategy, a.gate, avg(len(list_filter(a.cur, lambda x: list_contains(b.cur, x))) / CAST(len(a.cur) AS DOUBLE)) * 100e0 AS kept_pct,
  avg(len(list_filter(a.cur, lambda x: NOT list_contains(b.cur, x)))) AS new_per_month
 FROM sets a ASOF JOIN sets b ON a.strategy = b.strategy AND a.gate = b.gate AND a.asof > b.asof GROUP BY 1, 2) t
JOIN (SELECT strategy, gate, count(DISTINCT ticker) AS names_ever FROM runs GROUP BY 1, 2) e ON e.strategy = t.strategy AND e.gate = t.gate
"""
BODY["unit_nav"] = """
SELECT *, units * nav AS value, (nav / max(nav) OVER (ORDER BY asof) - 1) * 100e0 AS drawdown FROM (
 SELECT asof, nav, sum(paid / coalesce(before, 1000e0)) OVER (ORDER BY asof) AS units, sum(paid) OVER (ORDER BY asof) AS paid_total FROM (
  SELECT *, lag(nav) OVER (ORDER BY asof) AS before, 500e0 + CASE WHEN row_number() OVER (ORDER BY asof) = 1 THEN 20000e0 ELSE 0e0 END AS paid FROM (
   SELECT asof, 1000e0 * product(1 + eq / 100e0) OVER (ORDER BY asof) AS nav FROM bench)))
"""
BODY["first_touch"] = """
SELECT e.ticker, e.entry_date, e.entry_price, min(p.date) AS exit_date, arg_min(p.close_adj, p.date) AS exit_price,
  CASE WHEN min(p.date) IS NULL THEN NULL WHEN arg_min(p.close_adj, p.date) / e.entry_price <= 1 - 30e0 / 100e0 THEN 'stop' ELSE 'target' END AS reason
FROM (SELECT DISTINCT ticker, price_date AS entry_date, price_asof AS entry_price FROM prepared WHERE strategy = 'growth' AND in_universe) e
LEFT JOIN prices p ON p.ticker = e.ticker AND p.date > e.entry_date AND (p.close_adj / e.entry_price <= 1 - 30e0 / 100e0 OR p.close_adj / e.entry_price >= 1 + 60e0 / 100e0)
GROUP BY 1, 2, 3
"""
cte("old_runs", topn(f"(SELECT * FROM u_modes WHERE cap_rank <= {P.universe_size // 2})", "strategy, gate"))
simulate_sql("old_runs", "run_list", "strategy, gate")
cte("old_bench", f"""
SELECT a.asof, coalesce(eq, 0e0) AS eq FROM asofs a LEFT JOIN (SELECT u.asof, avg(ret_m) AS eq FROM (SELECT DISTINCT asof, ticker, market_cap FROM prepared WHERE in_universe AND cap_rank <= {P.universe_size // 2}) u
 JOIN monthly_returns r ON r.asof = u.asof AND r.ticker = u.ticker GROUP BY 1) b ON b.asof = a.asof
""")
_side = lambda sim, bench: summary_sql(sim, "strategy, gate", "strategy, gate").replace("JOIN bench b", f"JOIN {bench} b")
BODY["panel_diff"] = f"""
SELECT d.*, o.total AS old_total, o.excess AS old_excess, o.mdd AS old_mdd, w.total AS new_total, w.excess AS new_excess, w.mdd AS new_mdd FROM (
SELECT f.strategy, f.gate, count(*) AS months, count(*) FILTER (WHERE gone + come > 0) AS changed_months, avg(coalesce(come, 0)) AS avg_replaced FROM (SELECT * FROM run_list, asofs) f LEFT JOIN (
 SELECT strategy, gate, asof, count(*) FILTER (WHERE NOT in_new) AS gone, count(*) FILTER (WHERE NOT in_old) AS come FROM (
  SELECT strategy, gate, asof, ticker, bool_or(o) AS in_old, bool_or(NOT o) AS in_new FROM (
   SELECT strategy, gate, asof, ticker, true AS o FROM old_runs UNION ALL SELECT strategy, gate, asof, ticker, false FROM runs) GROUP BY ALL) GROUP BY ALL) x
 ON x.strategy = f.strategy AND x.gate = f.gate AND x.asof = f.asof GROUP BY 1, 2) d
LEFT JOIN ({_side('old_runs_sim', 'old_bench')}) o ON o.strategy = d.strategy AND o.gate = d.gate LEFT JOIN ({_side('runs_sim', 'bench')}) w ON w.strategy = d.strategy AND w.gate = d.gate
"""

# ---- raw documents ----------------------------------------------------------------------------------
BODY["statement_json"] = """
SELECT ticker, bsns_year, reprt_code, count(*) AS n_rows, max(ord) AS last_ord, arg_min(account_nm, ord) AS first_name FROM raw_rows
WHERE CAST(corp_code AS BIGINT) % 11 <> 5 GROUP BY 1, 2, 3
"""


def _brk(x: str) -> str:
    from tidemark.adapters import BROKERS
    return "[" + ", ".join(f"'{b}'" for b in BROKERS) + f"][CAST({x} % 7 AS INTEGER) + 1]"


_word = "CASE event_type WHEN 'click' THEN ' 상향' WHEN 'error' THEN ' 하향' WHEN 'signup' THEN ' 신규 제시' WHEN 'view' THEN ' 유지' ELSE '' END"
cte("ev", f"""
SELECT event_id, ts, user_id, event_type, value, lpad(CAST(user_id AS VARCHAR), 6, '0') AS ticker, '종목' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS nm,
  '종목' || lpad(CAST(user_id + 1 AS VARCHAR), 6, '0') AS other, {_brk('event_id')} AS broker, CAST(ceil(value / 50e0) AS BIGINT) AS a, {_word} AS word, event_id % 6 AS shape FROM events
""")
BODY["news_pages"] = """
SELECT ticker AS query, link AS article, title FROM (
 SELECT *, 'http://news/' || CAST(event_id // 2 AS VARCHAR) AS link,
  CASE shape WHEN 0 THEN broker || ', ' || nm || ' 목표주가 ' || a || '만원으로' || word WHEN 1 THEN nm || ' 실적 전망' WHEN 2 THEN '이번주 7종목 추천' WHEN 3 THEN other || ' 호조'
   WHEN 4 THEN nm || ' 주목' ELSE nm || ' ' || broker || ' 목표주가 ' || a || '만원 제시' END AS title FROM ev)
WHERE event_id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY ticker, link ORDER BY event_id % 7, event_id) = 1
"""

# ---- style and verdicts --------------------------------------------------------------------------------
def style_steps(pre: str, panel: str) -> None:
    """Baskets, interval returns and spreads over a graded panel, as expressions that start with `pre`."""
    cte(f"{pre}bask0", "\nUNION ALL ".join(f"SELECT asof, ticker, '{s}' AS style, {c} AS x, (SELECT count(*) FROM {panel} q WHERE q.asof = p.asof) AS n FROM {panel} p WHERE {c} IS NOT NULL"
                                           for s, c in (("value", "valuation_score"), ("growth", "growth_score"))))
    cte(f"{pre}bask", f"""
SELECT asof, style, ticker FROM (SELECT *, row_number() OVER (PARTITION BY asof, style ORDER BY x DESC, ticker) AS pos, count(*) OVER (PARTITION BY asof, style) AS scored FROM {pre}bask0)
WHERE scored >= {P.style_min_scored} AND pos <= greatest({P.style_min}, floor(n * {P.style_top_pct}e0))
""")
    cte(f"{pre}pm", f"SELECT asof, lead(asof) OVER (ORDER BY asof) AS nxt FROM (SELECT DISTINCT asof FROM {panel})")
    cte(f"{pre}bret", f"""
SELECT b.asof, b.style, b.ticker, arg_max(p.close_adj, p.date) / arg_min(p.close_adj, p.date) - 1 AS ret FROM {pre}bask b JOIN {pre}pm m ON m.asof = b.asof
JOIN prices p ON p.ticker = b.ticker AND p.date BETWEEN b.asof AND m.nxt GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND arg_min(p.close_adj, p.date) > 0
""")
    means = ", ".join(f"(SELECT avg(ret) * 100e0 FROM {pre}bret r WHERE r.asof = m.asof AND style = '{x}') AS {x}_ret" for x in ("value", "growth"))
    sizes = ", ".join(f"(SELECT count(*) FROM {pre}bask r WHERE r.asof = m.asof AND style = '{x}') AS n_{x}" for x in ("value", "growth"))
    cte(f"{pre}style_sp", f'''SELECT *, value_ret - growth_ret AS spread FROM (SELECT m.asof, m.nxt AS "to", {means}, {sizes} FROM {pre}pm m WHERE nxt IS NOT NULL)''')


style_steps("", "panel")
cte("fx_in", f"""
SELECT h.*, p.close_adj AS price_asof, p.date AS price_date, p.price_days, p.return_1m, p.return_3m, p.return_6m, p.volume_ratio,
  p.pos_52w, p.disparity_20, p.rsi_14, p.fwd_63, p.avg_tv, s.shares_outstanding AS shares_out, p.close_adj * s.shares_outstanding AS market_cap,
  coalesce(t.track, 'T1') AS track, coalesce(t.sector, '00') AS sector
FROM hist h JOIN px_asof p ON p.asof = h.asof AND p.ticker = h.ticker
JOIN shares_net s ON s.ticker = h.ticker AND s.shares_outstanding > 0 LEFT JOIN tracks t ON t.ticker = h.ticker
""")
cte("fx_ratios", ratio_sql("fx_in"))
_fx = grade_sql("fx_ratios")
cte("fx_peers", _fx["peers"])
cte("fx_long", _fx["long"].format(peers="fx_peers"))
cte("fx_ranked", _fx["ranked"].format(long="fx_long"))
cte("fx_panel", _fx["final"].format(peers="fx_peers", ranked="fx_ranked"))
style_steps("fx_", "fx_panel")
BODY["style_baskets"] = "SELECT * FROM bask"
BODY["style_spread"] = "SELECT * FROM style_sp"
BODY["style_spread_fixed"] = "SELECT * FROM fx_style_sp"
BODY["style_regime"] = """
SELECT *, 50 + CASE tilt WHEN 'value' THEN 10 WHEN 'growth' THEN -10 ELSE 0 END AS alloc_value, 35 + CASE tilt WHEN 'growth' THEN 10 WHEN 'value' THEN -10 ELSE 0 END AS alloc_growth, 15 AS alloc_momentum
FROM (SELECT w AS "window", count(*) AS months, sum(spread) AS spread, sum(value_ret) AS value_ret, sum(growth_ret) AS growth_ret,
  CASE WHEN round(sum(spread), 10) >= 3 THEN 'value' WHEN round(sum(spread), 10) <= -3 THEN 'growth' END AS tilt
 FROM (SELECT *, row_number() OVER (ORDER BY asof DESC) AS rn FROM style_sp WHERE spread IS NOT NULL), (SELECT unnest([3, 6, 12]) AS w) WHERE rn <= w GROUP BY 1)
"""
_stats = "SELECT '{0}' AS shares, count(*) AS months, avg(spread) AS mean_spread, avg(CASE WHEN spread > 0 THEN 1e0 ELSE 0e0 END) * 100e0 AS value_won_pct FROM {1} WHERE spread IS NOT NULL"
BODY["style_stats"] = _stats.format("as seen", "style_sp")
BODY["style_stats_by_shares"] = _stats.format("as seen", "style_sp") + " UNION ALL " + _stats.format("fixed", "fx_style_sp")

# ---- pros and cons: items ranked from both ends, risks first, cons filled up to the number of pros --------
_cat_of = {m: c for c, ms in spec.CATEGORIES.items() for m, _, _ in ms}
_items = [("fact", m, i, f"{_cat_of[m]}_score", f"{m} IS NOT NULL AND {_cat_of[m]}_score IS NOT NULL") for i, m in enumerate(spec.FACT_METRICS) if m in _cat_of]
_items += [("category", c, i, f"{c}_score", f"{c}_score IS NOT NULL") for i, c in enumerate(spec.CATEGORY_NAMES)]
_present = " + ".join(f"CASE WHEN {c}_score IS NOT NULL THEN 1 ELSE 0 END" for c in spec.STRATEGY_WEIGHTS["value"])
_risks = [("penalty_revenue_decline", "revenue_decline_3y"), ("penalty_cash_quality", "ocf_quality_bad_2y"), ("penalty_value_trap", "pbr < 0.5 AND roe < 5"),
          ("penalty_restructured", "NOT ttm_reliable"), ("restructured", "NOT ttm_reliable"), ("loss_streak", "loss_streak > 0"), ("stability_distorted", "stability_distorted"),
          ("overheated", "disparity_20 >= 130 OR rsi_14 >= 80 OR (pos_52w >= 99 AND rsi_14 >= 75)"), ("thin_coverage", f"{_present} < 4")]
cte("ev_in", "SELECT s.*, k.loss_streak, t.stability_distorted FROM sc_in s LEFT JOIN streaks k ON k.ticker = s.ticker LEFT JOIN (SELECT ticker, stability_distorted FROM tracks) t ON t.ticker = s.ticker")
cte("ev_items", "\nUNION ALL ".join(f"SELECT asof, ticker, '{k}' AS kind, '{m}' AS item, {i} AS o, {s} AS s FROM ev_in WHERE {c}" for k, m, i, s, c in _items))
cte("ev_order", "SELECT *, row_number() OVER (PARTITION BY asof, ticker, kind ORDER BY s DESC, o) AS down, row_number() OVER (PARTITION BY asof, ticker, kind ORDER BY s, o) AS up FROM ev_items")
cte("ev_strong", "SELECT *, row_number() OVER (PARTITION BY asof, ticker ORDER BY kind DESC, down) AS pos FROM ev_order WHERE s >= 70 AND down <= CASE kind WHEN 'fact' THEN 3 ELSE 2 END")
cte("ev_pros", """
SELECT asof, ticker, kind, item, s, pos FROM ev_strong WHERE pos <= 4 UNION ALL
SELECT asof, ticker, kind, item, s, down FROM ev_order o WHERE kind = 'fact' AND down <= 3 AND NOT EXISTS (SELECT 1 FROM ev_strong x WHERE x.asof = o.asof AND x.ticker = o.ticker)
""")
cte("ev_risks", "SELECT *, row_number() OVER (PARTITION BY asof, ticker ORDER BY o) AS pos FROM (" + "\nUNION ALL ".join(
    f"SELECT asof, ticker, '{n}' AS item, {i} AS o FROM ev_in WHERE {c}" for i, (n, c) in enumerate(_risks)) + ")")
cte("ev_sizes", """
SELECT e.asof, e.ticker, (SELECT count(*) FROM ev_pros p WHERE p.asof = e.asof AND p.ticker = e.ticker) AS n_pros,
  (SELECT count(*) FROM ev_risks r WHERE r.asof = e.asof AND r.ticker = e.ticker) AS n_risks FROM ev_in e
""")
cte("ev_fill", """
SELECT *, row_number() OVER (PARTITION BY asof, ticker ORDER BY kind, up) AS pos FROM ev_order o
WHERE kind = 'category' OR NOT EXISTS (SELECT 1 FROM ev_pros p WHERE p.asof = o.asof AND p.ticker = o.ticker AND p.kind = o.kind AND p.item = o.item)
""")
BODY["evidence"] = """
SELECT asof, ticker, 'pro' AS side, pos AS rank, kind, item, s AS score FROM ev_pros UNION ALL
SELECT c.asof, c.ticker, 'con', c.pos, c.kind, c.item, c.s FROM (
 SELECT asof, ticker, pos, 'risk' AS kind, item, NULL AS s FROM ev_risks UNION ALL
 SELECT f.asof, f.ticker, z.n_risks + f.pos, f.kind, f.item, f.s FROM ev_fill f JOIN ev_sizes z ON z.asof = f.asof AND z.ticker = f.ticker
 WHERE f.pos <= greatest(greatest(3, z.n_pros) - z.n_risks, 0)) c
JOIN ev_sizes z ON z.asof = c.asof AND z.ticker = c.ticker WHERE c.pos <= greatest(3, least(z.n_pros, 4))
"""
cte("vers", "SELECT asof, lag(asof) OVER (ORDER BY asof) AS prev FROM (SELECT DISTINCT asof FROM panel)")
cte("brd", f"SELECT b.asof, b.ticker, b.track, b.sector, CASE WHEN b.quality_score - a.quality_score <= -{P.breadth_drop}e0 THEN 1e0 ELSE 0e0 END AS worse FROM panel b JOIN vers v ON v.asof = b.asof JOIN panel a ON a.ticker = b.ticker AND a.asof = v.prev WHERE a.quality_score IS NOT NULL AND b.quality_score IS NOT NULL")
BODY["breadth"] = """
SELECT asof, track, NULL AS sector, avg(worse) AS worse_share, count(*) AS n FROM brd GROUP BY 1, 2 UNION ALL SELECT asof, NULL, sector, avg(worse), count(*) FROM brd GROUP BY 1, 3
UNION ALL SELECT asof, NULL, NULL, avg(worse), count(*) FROM brd GROUP BY 1
"""
cte("vh", "SELECT ticker, asof AS month, CASE WHEN score >= 70 THEN 'buy' WHEN score >= 60 THEN 'hold' WHEN score >= 40 THEN 'defer' ELSE 'out' END AS code FROM current_rows WHERE strategy = 'growth' AND score IS NOT NULL")
cte("hb0", """
SELECT c.asof, c.ticker, arg_max(v.code, v.month) AS last_code, max(v.month) FILTER (WHERE v.code <> 'defer') AS stop FROM (SELECT DISTINCT asof, ticker FROM current_rows WHERE strategy = 'growth') c
JOIN vh v ON v.ticker = c.ticker AND v.month < c.asof GROUP BY 1, 2
""")
cte("hb", """
SELECT h.asof, h.ticker, any_value(last_code) IN ('buy', 'hold', 'trim') AS held, count(v.month) AS defer_months FROM hb0 h
LEFT JOIN vh v ON v.ticker = h.ticker AND v.month < h.asof AND (h.stop IS NULL OR v.month > h.stop) GROUP BY 1, 2
""")
BODY["held_before"] = "SELECT * FROM hb"
_core = [("roe", 1), ("operating_margin", 1), ("ocf_to_ni", 1), ("debt_ratio", -1)]
cte("hurt", f"SELECT b.asof, b.ticker, b.track, b.sector, list_filter([{', '.join(f'CASE WHEN a.{m} <> 0 AND (b.{m} - a.{m}) / abs(a.{m}) * {s} < -0.25e0 THEN {chr(39)}{m}{chr(39)} END' for m, s in _core)}], lambda x: x IS NOT NULL) AS hurt FROM panel b JOIN vers v ON v.asof = b.asof LEFT JOIN panel a ON a.ticker = b.ticker AND a.asof = v.prev")
BODY["verdicts"] = """
SELECT *, CASE WHEN score IS NULL THEN 'na' WHEN NOT gate_pass THEN leave_sell WHEN score >= 78 THEN 'buy' WHEN score >= 62 THEN CASE WHEN held THEN 'hold' ELSE 'watch' END
  WHEN score >= 52 THEN CASE WHEN NOT held THEN 'watch' WHEN defer THEN 'defer' ELSE 'trim' END ELSE leave_sell END AS code FROM (
 SELECT *, defer_reason IS NOT NULL AS defer, CASE WHEN NOT held THEN 'out' WHEN defer_reason IS NOT NULL THEN 'defer' ELSE 'sell' END AS leave_sell FROM (
  SELECT h.asof, h.ticker, s.score, s.gate_pass, h.hurt, coalesce(b.held, false) AS held, b.defer_months,
   CASE WHEN coalesce(b.defer_months, 0) >= 6 THEN NULL WHEN t.w >= 0.4e0 THEN 'market' WHEN x.w >= 0.5e0 THEN 'sector' WHEN len(hurt) = 0 THEN 'fundamentals' END AS defer_reason
  FROM hurt h JOIN (SELECT * FROM scored WHERE strategy = 'growth') s ON s.ticker = h.ticker AND s.asof = h.asof LEFT JOIN hb b ON b.ticker = h.ticker AND b.asof = h.asof
  LEFT JOIN (SELECT asof, track, avg(worse) AS w FROM brd GROUP BY 1, 2) t ON t.track = h.track AND t.asof = h.asof
  LEFT JOIN (SELECT asof, sector, avg(worse) AS w FROM brd GROUP BY 1, 2) x ON x.sector = h.sector AND x.asof = h.asof))
"""
BODY["value_counts"] = "SELECT *, row_number() OVER (PARTITION BY asof, \"column\" ORDER BY n DESC, value NULLS LAST) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT asof, '{c}' AS \"column\", {x} AS value, count(*) AS n FROM current_rows WHERE strategy = 'value' GROUP BY 1, 3" for c, x in (
        ("track", "track"), ("sector", "sector"), ("growth_grade", "growth_grade"), ("pass", "CASE WHEN score IS NOT NULL THEN CAST(pass AS VARCHAR) END"))) + ")"
cte("band0", f"""
SELECT p.ticker, p.date, p.close_adj * m.shares_out / nullif(f.net_income_parent_ttm, 0) AS per, p.close_adj * m.shares_out / nullif(f.equity_parent - coalesce(f.hybrid_capital, 0), 0) AS pbr
FROM (SELECT * FROM prices WHERE date <= (SELECT max(asof) FROM months)) p JOIN metrics_latest m ON m.ticker = p.ticker
ASOF LEFT JOIN (SELECT * FROM ttm QUALIFY row_number() OVER (PARTITION BY ticker, rcept_dt ORDER BY period DESC) = 1) f ON f.ticker = p.ticker AND p.date >= f.rcept_dt
""")
cte("band1", "SELECT *, arg_max(per, date) FILTER (WHERE per IS NOT NULL) OVER (PARTITION BY ticker) AS cper, arg_max(pbr, date) FILTER (WHERE pbr IS NOT NULL) OVER (PARTITION BY ticker) AS cpbr FROM band0")
BODY["valuation_band"] = """
SELECT b.*, CASE WHEN m.per > 0 AND per_p75 <> 0 THEN m.price_asof * per_p75 / m.per END AS exit_price FROM (
 SELECT ticker, count(*) AS days, """ + ", ".join(f"CASE WHEN count(per) > 60 THEN quantile_cont(per, {q}) END AS per_p{n}" for q, n in ((0.25, 25), (0.5, 50), (0.75, 75))) + """,
  CASE WHEN count(per) > 60 THEN avg(CASE WHEN per < cper THEN 1e0 WHEN per >= cper THEN 0e0 END) * 100e0 END AS per_pos,
  CASE WHEN count(pbr) > 60 THEN avg(CASE WHEN pbr < cpbr THEN 1e0 WHEN pbr >= cpbr THEN 0e0 END) * 100e0 END AS pbr_pos FROM band1 GROUP BY 1) b JOIN metrics_latest m ON m.ticker = b.ticker
"""
BODY["contributions"] = "\nUNION ALL ".join(f"SELECT asof, ticker, '{c}' AS category, {w} AS weight, {c}_score AS score, {c}_score * {w}e0 / 100e0 AS points FROM panel" for c, w in spec.STRATEGY_WEIGHTS["value"].items())
BODY["best_strategy"] = """
SELECT asof, ticker, arg_max(strategy, (score, CASE WHEN strategy = 'value' THEN 1 ELSE 0 END)) AS strategy, max(score) AS score, count(*) AS n_passed FROM scored WHERE gate_pass AND score IS NOT NULL GROUP BY 1, 2
"""
BODY["strategy_duplicates"] = "SELECT * FROM scored WHERE gate_pass QUALIFY count(*) OVER (PARTITION BY asof, ticker) > 1"
_secn = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spec.SECTOR_NAMES.items())
BODY["sector_ranking"] = f"""
SELECT *, row_number() OVER (PARTITION BY asof ORDER BY round(mean_score, 10) DESC, sector_name) AS rank FROM (
 SELECT asof, sector_name, count(*) AS n, avg(score) AS mean_score, arg_max(ticker, (score, ticker)) AS top_name, max(score) AS top_score FROM (
  SELECT s.*, CASE WHEN code = '' THEN '미분류' ELSE coalesce(CASE substr(code, 1, 2) {_secn} END, 'KSIC ' || substr(code, 1, 2)) END AS sector_name
  FROM scored s JOIN (SELECT c.ticker, coalesce(CASE k % 8 WHEN 0 THEN '64992' WHEN 1 THEN '651' WHEN 2 THEN '21101' WHEN 3 THEN '26110' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE CAST(20 + k % 12 AS VARCHAR) || '111' END, '') AS code FROM corps c) f
  ON f.ticker = s.ticker WHERE strategy = 'value' AND score IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 3) QUALIFY rank <= 5
"""

# ---- consensus ------------------------------------------------------------------------------------------
cte("m0", """
SELECT event_id AS mention_id, ticker, broker, event_id % 7 = 6 AS "foreign", CAST(a * 50 AS DOUBLE) AS target,
  CASE event_type WHEN 'click' THEN '상향' WHEN 'error' THEN '하향' WHEN 'signup' THEN '신규' WHEN 'view' THEN '유지' END AS direction, date_trunc('second', ts) AS pub FROM ev
""")
cte("eprices", "SELECT ticker, CAST(ts AS DATE) AS date, round(sum(value), 2) / count(*) + 60e0 AS close_adj FROM ev GROUP BY 1, 2")
cte("elast", "SELECT ticker, arg_max(close_adj, date) AS price FROM eprices GROUP BY 1")


def anchors_sql(name: str, src: str) -> None:
    """Greedy anchors by recursion: the next kept mention is the first one fifteen days on."""
    gap = P.mention_dedupe_days + 1
    cte(f"{name}_a", f"""
SELECT ticker, broker, target, min(pub) AS at FROM {src} GROUP BY 1, 2, 3 UNION ALL
SELECT a.ticker, a.broker, a.target, min(m.pub) FROM {name}_a a JOIN {src} m ON m.ticker = a.ticker AND m.broker = a.broker AND m.target = a.target AND m.pub >= a.at + INTERVAL {gap} DAY GROUP BY 1, 2, 3
""")
    cte(name, f"""
SELECT m.*, (SELECT count(*) FROM {src} c WHERE c.ticker = m.ticker AND c.broker = m.broker AND c.target = m.target AND c.pub >= m.pub AND c.pub < m.pub + INTERVAL {gap} DAY) AS copies
FROM {src} m JOIN {name}_a a ON a.ticker = m.ticker AND a.broker = m.broker AND a.target = m.target AND a.at = m.pub
QUALIFY row_number() OVER (PARTITION BY m.ticker, m.broker, m.target, m.pub ORDER BY m.mention_id) = 1
""")


def representatives_sql(name: str, src: str) -> None:
    """Base mention, then later agreeing mentions folded in time order by recursion."""
    cte(f"{name}_w", f"SELECT * FROM {src} WHERE pub >= (SELECT date_trunc('day', max(ts)) FROM ev) - INTERVAL {P.mention_window_days} DAY AND NOT \"foreign\"")
    cte(f"{name}_b", f"SELECT * FROM {name}_w QUALIFY row_number() OVER (PARTITION BY ticker, broker ORDER BY copies >= 2 DESC, pub DESC, mention_id DESC) = 1")
    cte(f"{name}_c", f"""
SELECT w.ticker, w.broker, w.mention_id, w.target, w.direction, row_number() OVER (PARTITION BY w.ticker, w.broker ORDER BY w.pub, w.mention_id) AS rn
FROM {name}_w w JOIN {name}_b b ON b.ticker = w.ticker AND b.broker = w.broker WHERE b.copies >= 2 AND w.pub > b.pub AND w.direction IN ('상향', '하향')
""")
    take = "abs(c.target / f.target - 1) > 1e-9 AND (c.direction = '상향') = (c.target > f.target)"
    cte(f"{name}_f", f"""
SELECT ticker, broker, mention_id, target, CAST(0 AS BIGINT) AS rn FROM {name}_b UNION ALL
SELECT f.ticker, f.broker, CASE WHEN {take} THEN c.mention_id ELSE f.mention_id END, CASE WHEN {take} THEN c.target ELSE f.target END, c.rn
FROM {name}_f f JOIN {name}_c c ON c.ticker = f.ticker AND c.broker = f.broker AND c.rn = f.rn + 1
""")
    cte(name, f"""
SELECT w.* FROM {name}_w w JOIN (SELECT * FROM {name}_f QUALIFY row_number() OVER (PARTITION BY ticker, broker ORDER BY rn DESC) = 1) f
ON f.ticker = w.ticker AND f.broker = w.broker AND f.mention_id = w.mention_id
""")


def consensus_sql(name: str, src: str, rep: str) -> None:
    n = P.min_brokers
    cte(name, f"""
SELECT o.ticker, coalesce(r.n, 0) AS n_brokers, coalesce(f.n, 0) AS n_foreign, l.price, CASE WHEN r.n >= {n} THEN med END AS median_target,
  CASE WHEN r.n >= {n} AND price <> 0 THEN (med / price - 1) * 100e0 END AS upside, CASE WHEN r.n >= {n} THEN (q3 - q1) / med * 100e0 END AS dispersion,
  CASE WHEN r.n >= {n} THEN (ups - downs) / CAST(r.n AS DOUBLE) END AS revision
FROM (SELECT DISTINCT ticker FROM {src}) o
LEFT JOIN (SELECT ticker, count(*) AS n, median(target) AS med, quantile_cont(target, 0.25) AS q1, quantile_cont(target, 0.75) AS q3,
  count(*) FILTER (WHERE direction = '상향') AS ups, count(*) FILTER (WHERE direction = '하향') AS downs FROM {rep} GROUP BY 1) r ON r.ticker = o.ticker
LEFT JOIN (SELECT ticker, count(DISTINCT broker) AS n FROM {src} WHERE "foreign" AND pub >= (SELECT date_trunc('day', max(ts)) FROM ev) - INTERVAL {P.mention_window_days} DAY GROUP BY 1) f ON f.ticker = o.ticker
LEFT JOIN elast l ON l.ticker = o.ticker
""")


anchors_sql("dd", "m0")
representatives_sql("rp", "dd")
consensus_sql("cs", "dd", "rp")
_pub = "strftime(pub, '%Y-%m-%d %H:%M:%S') AS pub"
BODY["mention_dedupe"] = f"SELECT * REPLACE ({_pub}) FROM dd"
BODY["representatives"] = "SELECT * FROM rp"
BODY["consensus"] = "SELECT * FROM cs"
_band = f"ratio IS NULL OR ratio BETWEEN {P.band_low}e0 AND {P.band_high}e0"


def band_sql(src: str) -> str:
    return f"""
SELECT *, {_band} AS kept FROM (SELECT o.*, o.target / p.close_adj AS ratio FROM (SELECT *, CAST(pub + INTERVAL 9 HOUR AS DATE) AS d FROM {src}) o
ASOF LEFT JOIN eprices p ON p.ticker = o.ticker AND o.d >= p.date)
"""


cte("band_all", band_sql("m0"))
BODY["asof_price"] = f"SELECT * REPLACE ({_pub}) FROM band_all"
cte("mb", "SELECT *, 'n' || CAST(mention_id // 3 AS VARCHAR) AS link FROM m0 QUALIFY row_number() OVER (PARTITION BY ticker, mention_id // 3, broker, target ORDER BY mention_id DESC) = 1")
anchors_sql("bdd", "mb")
cte("bmark", band_sql("bdd"))
cte("bkept", "SELECT * FROM bmark WHERE kept")
representatives_sql("brp", "bkept")
consensus_sql("bcs", "bkept", "brp")
cte("batch", """
SELECT c.ticker, c.name, coalesce(a.n, 0) AS articles, coalesce(a.span, 0) AS span_days, coalesce(m.reports, 0) AS reports, coalesce(m.band_drop, 0) AS band_drop, coalesce(m.single, 0) AS single,
  l.price, coalesce(b.n_brokers, 0) AS n_brokers, coalesce(b.n_foreign, 0) AS n_foreign, b.median_target, b.upside, b.dispersion, b.revision
FROM (SELECT DISTINCT ticker, nm AS name FROM ev UNION ALL SELECT '999999', 'none') c
LEFT JOIN (SELECT ticker, count(DISTINCT mention_id // 3) AS n, floor((epoch((SELECT date_trunc('day', max(ts)) FROM ev)) - epoch(min(pub))) / 86400) AS span FROM m0 GROUP BY 1) a ON a.ticker = c.ticker
LEFT JOIN (SELECT ticker, count(*) FILTER (WHERE kept) AS reports, count(*) FILTER (WHERE NOT kept) AS band_drop, count(*) FILTER (WHERE kept AND copies = 1) AS single FROM bmark GROUP BY 1) m ON m.ticker = c.ticker
LEFT JOIN bcs b ON b.ticker = c.ticker LEFT JOIN elast l ON l.ticker = c.ticker
""")
BODY["consensus_batch"] = "SELECT * FROM batch"
cte("pool", f"SELECT upside FROM batch WHERE n_brokers >= {P.min_brokers} AND upside IS NOT NULL")
BODY["upside_percentile"] = f"""
SELECT b.ticker, b.upside, CASE WHEN b.upside IS NOT NULL AND n >= {P.min_pool} THEN (SELECT count(*) FROM pool q WHERE q.upside < b.upside) * 100e0 / n END AS upside_pct,
  CASE WHEN b.upside IS NOT NULL AND n >= {P.min_pool} THEN m END AS pool_median FROM batch b, (SELECT count(*) AS n, median(upside) AS m FROM pool)
"""
BODY["report_summary"] = """
SELECT g.*, l.price, CASE WHEN target_mean <> 0 AND price <> 0 THEN (target_mean / price - 1) * 100e0 END AS upside,
  CASE WHEN target_mean <> 0 AND price <> 0 THEN (target_max - target_min) / target_mean * 100e0 END AS spread FROM (
 SELECT ticker, count(*) AS n, array_to_string(list_sort(list(DISTINCT broker)), ', ') AS brokers, avg(target) AS target_mean, min(target) AS target_min, max(target) AS target_max, max(d) AS latest
 FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM (SELECT ticker, broker, CASE WHEN mention_id % 9 <> 0 THEN CAST(CAST(pub AS DATE) - to_months(CAST(mention_id % 10 AS INTEGER)) AS DATE) END AS d,
   CASE WHEN mention_id % 8 <> 0 THEN target END AS target FROM m0 WHERE direction IS NULL))
 WHERE last IS NULL OR d IS NULL OR d >= CAST(last - INTERVAL 6 MONTH AS DATE) GROUP BY 1) g LEFT JOIN elast l ON l.ticker = g.ticker
"""
BODY["report_csv"] = """
SELECT ticker, broker, CASE WHEN mention_id % 9 <> 0 THEN CAST(CAST(pub AS DATE) - to_months(CAST(mention_id % 10 AS INTEGER)) AS DATE) END AS date, CASE WHEN mention_id % 8 <> 0 THEN target END AS target FROM m0 WHERE direction IS NULL
"""
BODY["company_profiles"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS corp_code, CASE s_suppkey % 8 WHEN 0 THEN '64992' WHEN 1 THEN '651' WHEN 2 THEN '21101' WHEN 3 THEN '26110' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE CAST(20 + s_suppkey % 12 AS VARCHAR) || '111' END AS induty_code
FROM supplier WHERE s_suppkey % 11 <> 5
"""
BODY["market_projection"] = "SELECT ticker, 'market' AS source, count(*) AS n, sum(close) AS close, max(market_cap) AS market_cap, max(shares_out) AS shares_out FROM market GROUP BY 1"
BODY["rank_gap"] = f"""
SELECT *, rank_upside - rank_score AS gap, CASE WHEN rank_score IS NULL THEN NULL WHEN abs(rank_upside - rank_score) < {P.gap_rank} THEN 'agree' WHEN rank_upside > rank_score THEN 'score_high' ELSE 'consensus_high' END AS note FROM (
 SELECT asof, strategy, ticker, rank, score, upside, CASE WHEN upside IS NOT NULL AND n >= 2 THEN row_number() OVER (PARTITION BY asof, strategy, upside IS NOT NULL ORDER BY score DESC, ticker) END AS rank_score,
  CASE WHEN upside IS NOT NULL AND n >= 2 THEN row_number() OVER (PARTITION BY asof, strategy, upside IS NOT NULL ORDER BY upside DESC, ticker) END AS rank_upside
 FROM (SELECT *, count(upside) OVER (PARTITION BY asof, strategy) AS n FROM (
  SELECT s.asof, s.strategy, s.ticker, s.score, b.upside, row_number() OVER (PARTITION BY s.asof, s.strategy ORDER BY s.score DESC, s.ticker) AS rank
  FROM scored s LEFT JOIN batch b ON b.ticker = s.ticker WHERE s.score IS NOT NULL QUALIFY rank <= {P.top_n})))
"""
BODY["mention_extract"] = """
SELECT event_id AS article_id, ticker, broker, event_id % 7 = 6 AS "foreign", a * 10000 AS target, CASE WHEN shape = 1 THEN (a + 1) * 10000 END AS prev_target,
  CASE WHEN shape = 0 THEN CASE event_type WHEN 'click' THEN '상향' WHEN 'error' THEN '하향' WHEN 'signup' THEN '신규' WHEN 'view' THEN '유지' END WHEN shape = 1 THEN '상향' ELSE '유지' END AS direction,
  strftime(date_trunc('second', ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS pub, 'http://news/' || CAST(event_id AS VARCHAR) AS link, shape IN (0, 5) AS from_title
FROM ev WHERE shape IN (0, 1, 5) OR (shape IN (3, 4) AND user_id + 1 NOT IN (SELECT user_id FROM events))
"""
BODY["name_dictionary"] = """
SELECT DISTINCT ticker, nm AS name, [nm] AS own, CASE WHEN user_id % 5 = 0 THEN ['홀딩스'] ELSE [] END AS tails, CAST(NULL AS VARCHAR) AS affiliate FROM ev
"""

# ---- ledger -----------------------------------------------------------------------------------------------
_rule = {"value_mix": mix(spec.STRATEGY_WEIGHTS["value"]), "growth_mix": mix(spec.STRATEGY_WEIGHTS["growth"]), "growth_only": "growth_score",
         "profitability_only": "profitability_score", "valuation_only": "valuation_score", "pbr_only": "100e0 - pbr_p",
         "consensus_upside": "CASE WHEN nb >= 3 THEN quality_score - 40e0 END", "consensus_revision": "CASE WHEN nb >= 3 THEN rev END + nb / 1000e0",
         "growth_and_revision": f"CASE WHEN nb >= 3 AND rev > 0 THEN {mix(spec.STRATEGY_WEIGHTS['growth'])} END"}
_gated = {"value_mix": "value", "growth_mix": "growth", "growth_and_revision": "growth"}
cte("led_in", f"""
SELECT v.*, period % 7 AS nb, (period % 3 - 1) * 0.5e0 AS rev, {_low_pct('pbr')} AS pbr_p, (SELECT any_value(g.pass) FROM current_rows g WHERE g.strategy = 'growth' AND g.asof = v.asof AND g.ticker = v.ticker) AS gpass
FROM current_rows v WHERE strategy = 'value'
""")
cte("led_sc", "\nUNION ALL ".join(
    f"SELECT asof, ticker, '{n}' AS rule, round({x}, 8) AS rscore FROM led_in WHERE {x} IS NOT NULL" + ("" if n not in _gated else " AND pass" if _gated[n] == "value" else " AND coalesce(gpass, false)")
    for n, x in _rule.items()))
cte("led_sel", f"SELECT asof, rule, ticker, round_even(rscore, 2) AS score, row_number() OVER (PARTITION BY rule, asof ORDER BY rscore DESC, ticker) AS rank FROM led_sc QUALIFY rank <= {P.top_n}")
BODY["rule_selections"] = "SELECT * FROM led_sel"


def _close(d: str) -> str:
    return f"(SELECT ticker, arg_max(close_adj, date) AS price FROM prices WHERE date <= {d} GROUP BY 1)"


# runs in turn: a batch stays unless the next run is near, and settles at the first run after its holding time
cte("led_runs", f"""
SELECT r.asof, d.price_date, r.asof - d.price_date AS lag, r.asof - d.price_date <= {P.max_price_lag_days} AS fresh
FROM (SELECT DISTINCT asof FROM current_rows) r ASOF LEFT JOIN (SELECT DISTINCT date AS price_date FROM prices) d ON r.asof >= d.price_date
""")
cte("led_cal", f"""
SELECT r.*, (SELECT min(n.asof) FROM led_runs n WHERE n.fresh AND n.asof > r.asof) AS next_run, (SELECT min(n.asof) FROM led_runs n WHERE n.fresh AND n.asof >= r.asof + {P.min_hold_days}) AS exit_run FROM led_runs r
""")
cte("led_px", "SELECT t.ticker, r.asof, p.close_adj AS price FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN led_runs r ASOF JOIN (SELECT * FROM prices WHERE close_adj IS NOT NULL) p ON p.ticker = t.ticker AND r.asof >= p.date")
cte("cyc", f"""
SELECT s.*, a.price AS entry_price, x.exit_asof, b.price AS exit_price, round_even((b.price / a.price - 1) * 100e0, 2) AS ret_pct
FROM led_sel s JOIN (SELECT * FROM led_cal WHERE fresh AND (next_run IS NULL OR next_run - asof >= {P.min_hold_days})) c ON c.asof = s.asof
LEFT JOIN led_px a ON a.ticker = s.ticker AND a.asof = s.asof,
LATERAL (SELECT CASE WHEN c.exit_run IS NULL THEN NULL WHEN a.price IS NOT NULL THEN c.exit_run ELSE (SELECT max(asof) FROM led_runs WHERE fresh) END AS exit_asof) x
LEFT JOIN led_px b ON b.ticker = s.ticker AND b.asof = x.exit_asof
""")
BODY["ledger_cycle"] = "SELECT * FROM cyc"
cte("led_diff", "SELECT asof, avg(CASE WHEN rev_growth_q_of_4 >= 3 THEN 1e0 ELSE 0e0 END) AS diffusion, count(*) AS n FROM current_rows WHERE strategy = 'growth' GROUP BY 1")
BODY["diffusion"] = "SELECT * FROM led_diff"
BODY["run_dates"] = "SELECT * FROM led_cal"
_means = ", ".join(f"round_even(avg(ret_pct) FILTER (WHERE rule = '{n}'), 2) AS {n}" for n in _rule)
cte("led_months", f"""
SELECT r.*, r.exit_asof - r.asof AS days, m.bench_eq, m.bench_cap, m.n_universe, (SELECT round_even(d.diffusion * 100e0, 1) FROM led_diff d WHERE d.asof = r.asof) AS diffusion
FROM (SELECT asof, exit_asof, {_means} FROM cyc WHERE ret_pct IS NOT NULL GROUP BY 1, 2) r
JOIN (SELECT asof, round_even(avg(rr), 2) AS bench_eq, round_even(sum(rr * market_cap) / sum(market_cap), 2) AS bench_cap, count(*) AS n_universe FROM (
 SELECT p.asof, p.market_cap, (b.price / a.price - 1) * 100e0 AS rr FROM panel p JOIN led_cal c ON c.asof = p.asof
 JOIN led_px a ON a.ticker = p.ticker AND a.asof = p.asof JOIN led_px b ON b.ticker = p.ticker AND b.asof = c.exit_run) WHERE rr IS NOT NULL AND market_cap IS NOT NULL GROUP BY 1) m ON m.asof = r.asof
""")
BODY["month_close"] = "SELECT * FROM led_months"
BODY["scoreboard"] = f"""
SELECT rule, (product(1 + v / 100e0) - 1) * 100e0 AS cumulative, avg(v) AS mean, avg(v - bench_eq) AS vs_bench, count(*) FILTER (WHERE v > bench_eq) AS wins, count(*) AS months, max(v) AS best, min(v) AS worst
FROM (UNPIVOT (SELECT asof, bench_eq, {', '.join(_rule)} FROM led_months) ON {', '.join(_rule)} INTO NAME rule VALUE v) GROUP BY 1
"""

# ---- data quality ---------------------------------------------------------------------------------------------
BODY["coverage_check"] = """
SELECT *, tickers < peak * 0.5e0 AND datediff('month', first, month) > 6 AS bad FROM (SELECT *, max(tickers) OVER () AS peak, min(month) OVER () AS first FROM (
 SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT ticker) AS tickers FROM prices GROUP BY 1))
"""
BODY["staleness_check"] = f"SELECT *, stale_share > 0.1e0 AS bad FROM (SELECT asof, avg(CASE WHEN (asof - rcept_dt) / 30.44e0 > {P.stale_months} THEN 1e0 ELSE 0e0 END) AS stale_share, count(*) AS n FROM prepared WHERE in_universe GROUP BY 1)"
BODY["completeness"] = """
SELECT i.*, n.name, f.fin_year, x.px_last, t.ticker IS NOT NULL AS has_track, f.fin_year IS NULL OR f.fin_year < year(i.last_in) AS stale
FROM (SELECT ticker, min(asof_date) AS first_in, max(asof_date) AS last_in FROM snapshots WHERE included GROUP BY 1) i
LEFT JOIN (SELECT ticker, arg_max(name, asof_date) AS name FROM snapshots GROUP BY 1) n ON n.ticker = i.ticker
LEFT JOIN (SELECT ticker, max(year) AS fin_year FROM ttm GROUP BY 1) f ON f.ticker = i.ticker
LEFT JOIN (SELECT ticker, max(date) AS px_last FROM prices GROUP BY 1) x ON x.ticker = i.ticker LEFT JOIN tracks t ON t.ticker = i.ticker
"""
BODY["missing_dates"] = """
SELECT d AS asof_date FROM (SELECT unnest([make_date(y, 4, 5), make_date(y, 5, 20), make_date(y, 8, 20), make_date(y, 11, 20)]) AS d FROM (SELECT unnest(range(year(lo), year(hi) + 1)) AS y, lo, hi
 FROM (SELECT CAST(min(date) - INTERVAL 12 MONTH AS DATE) AS lo, max(date) AS hi FROM prices))), (SELECT CAST(min(date) - INTERVAL 12 MONTH AS DATE) AS lo, max(date) AS hi FROM prices)
WHERE d BETWEEN lo AND hi AND d NOT IN (SELECT asof_date FROM snapshots)
"""
BODY["needs_extension"] = f"SELECT ticker, max(date) AS last_date FROM prices GROUP BY 1 HAVING max(date) < (SELECT max(date) FROM prices) - {P.extension_days}"
BODY["stored_months"] = "SELECT * REPLACE (CASE WHEN asof >= (SELECT asof FROM led_months ORDER BY asof OFFSET (SELECT count(*) // 2 FROM led_months) LIMIT 1) THEN diffusion END AS diffusion) FROM led_months"
BODY["published_panel"] = "SELECT asof, ticker, track, quality_score FROM panel"
BODY["price_upsert"] = "SELECT ticker, count(*) AS n, sum(CASE WHEN date >= DATE '1999-01-01' THEN close_adj * 1.01e0 ELSE close_adj END) AS total FROM prices GROUP BY 1"
BODY["reconcile"] = """
SELECT field, count(*) AS n, count(*) FILTER (WHERE err <= 0.1e0) AS within, median(err) AS median_err FROM (
""" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS field, CASE WHEN x <> 0 THEN abs(v - x) / abs(x) END AS err FROM (SELECT {f} AS v, {f} * (1 + (CAST(ticker AS BIGINT) / 10 % 7) / 25e0) * CASE WHEN CAST(ticker AS BIGINT) % 90 = 0 THEN 0e0 ELSE 1e0 END AS x FROM metrics_latest)"
    for f in ("eps", "bps", "pbr")) + ") WHERE err IS NOT NULL GROUP BY 1\n"
