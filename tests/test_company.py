"""Hand-computed checks on one synthetic company: statements, TTM, metrics, masks."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import div, parse_amount
from tidemark.params import Params
from tidemark.plans import metrics, panel, statements

P = Params()


def company(spark, years=range(2022, 2027), margin=0.20, ticker="TEST", skip=()):
    rows = []
    for y in years:
        for q in range(1, 5):
            if (y, q) in skip:
                continue
            rev = 100.0 * q
            op = rev * margin
            ni = op - op * 0.22
            rows.append(dict(
                ticker=ticker, corp_code="0000", year=y, quarter=q, period=y * 4 + q, reprt_code=list(spec.REPORT_QUARTER)[q - 1],
                fs_div="CFS", rcept_dt=f"{y}-{('05-15', '08-14', '11-14', '03-31')[q - 1]}", currency="KRW", revenue=rev,
                gross_profit=rev * 0.4, operating_income=op, pretax_income=op, tax_expense=op * 0.22, net_income=ni,
                net_income_parent=ni, ocf=ni * 1.2, capex_tangible=10.0 * q, capex_intangible=0.0, depreciation=rev * 0.05,
                amortization=0.0, assets=2000.0, current_assets=800.0, liabilities=1000.0, current_liabilities=400.0,
                equity=1000.0, equity_parent=1000.0, cash=200.0, hybrid_capital=None))
    cols = ["ticker", "corp_code", "year", "quarter", "period", "reprt_code", "fs_div", "rcept_dt", "currency"]
    schema = ("ticker string, corp_code string, year int, quarter int, period int, reprt_code string, fs_div string, "
              "rcept_dt string, currency string, " + ", ".join(f"{f} double" for f in spec.FLOW_FIELDS + spec.STOCK_FIELDS))
    data = [tuple(r[c] for c in cols + spec.FLOW_FIELDS + spec.STOCK_FIELDS) for r in rows]
    return spark.createDataFrame(data, schema).withColumn("rcept_dt", F.to_date("rcept_dt"))


def one_metric_row(spark, track="T1", **kw):
    t = statements.ttm(company(spark, **kw))
    h = metrics.history_features(t, P, ["ticker"]).where("year = 2026 AND quarter = 2")
    h = h.withColumn("market_cap", F.lit(1000.0)).withColumn("shares_out", F.lit(100.0)).withColumn("track", F.lit(track))
    return metrics.ratios(h, P).first()


def near(got, want, tol=1e-6):
    return got is not None and abs(got - want) <= tol * max(1.0, abs(want))


@pytest.mark.parametrize("text, want", [("1,234,567", 1234567.0), ("-", None), ("(1,234)", -1234.0), ("-500", -500.0),
                                        ("", None), ("--", None), ("nan", None), ("1.5", 1.5), ("1-2", None), (" 7원", 7.0)])
def test_parse_amount(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(parse_amount("x")).first()[0] == want


@pytest.mark.parametrize("aid, name, sj, want", [
    ("ifrs-full_Revenue", "수익(매출액)", "IS", "revenue"), ("-", "영업이익", "IS", "operating_income"),
    ("-", "유형자산의 취득", "CF", "capex_tangible"), ("-", "배당금지급", "CF", None),
    ("ifrs-full_Assets", "자산총계", "IS", None), ("ifrs-full_ComprehensiveIncome", "당기순이익", "IS", None),
    ("-", "기본주당이익", "IS", None), ("-", "총포괄이익", "IS", None), ("other", "매출액", "IS", "revenue"),
    ("-", "현금 및 현금성자산", "BS", "cash"), ("-", "무형자산상각비", "CF", "amortization")])
def test_standard_field(spark, aid, name, sj, want):
    d = spark.createDataFrame([(aid, name, sj)], "a string, n string, s string")
    a, n = statements.clean_account(F.col("a"), F.col("n"))
    assert d.select(statements.standard_field(a, n, F.col("s"))).first()[0] == want


def test_ttm(spark):
    t = {(r.year, r.quarter): r for r in statements.ttm(company(spark)).collect()}
    assert near(t[2026, 2].revenue_ttm, 400) and near(t[2026, 2].operating_income_ttm, 80)
    assert near(t[2025, 4].revenue_ttm, 400)
    assert t[2022, 1].revenue_ttm is None
    assert near(t[2026, 2].fcf_ttm, 62.4 * 1.2 - 40)


def test_ttm_needs_both_prior_rows(spark):
    t = {(r.year, r.quarter): r for r in statements.ttm(company(spark, skip=[(2024, 2), (2023, 4)])).collect()}
    assert t[2025, 2].revenue_ttm is None       # same quarter of the prior year is missing
    assert t[2024, 1].revenue_ttm is None       # prior annual is missing
    assert near(t[2025, 3].revenue_ttm, 400)


def test_single_quarter(spark):
    q = {(r.year, r.quarter): r for r in statements.single_quarter(company(spark)).collect()}
    assert near(q[2025, 3].revenue_q, 100) and near(q[2025, 1].revenue_q, 100)


def test_metrics(spark):
    m = one_metric_row(spark)
    want = dict(operating_margin=20, roe=6.24, roa=3.12, debt_ratio=100, current_ratio=200, pbr=1.0, eps=0.624, ocf_to_ni=120,
                revenue_growth_yoy=0, psr=2.5, net_debt=800, equity_ratio=50)
    for k, v in want.items():
        assert near(m[k], v), k
    assert near(m.per, 1000 / 62.4, 1e-3) and near(m.roic, 80 * 0.78 / 1800 * 100)


def test_losses_are_null_not_cheap(spark):
    m = one_metric_row(spark, margin=-0.10)
    assert m.per is None and m.op_growth_yoy is None and m.peg is None and m.normalized_per is None
    assert near(m.pbr, 1.0) and near(m.revenue_growth_yoy, 0)


def test_track_mask(spark):
    m = one_metric_row(spark, track="T2")
    assert m.debt_ratio is None and m.fcf_to_ni is None and near(m.roa, 3.12)


@pytest.mark.parametrize("n, d, positive, want", [(10.0, 0.0, True, None), (10.0, None, True, None), (10.0, -5.0, True, None), (10.0, -5.0, False, -2.0)])
def test_div(spark, n, d, positive, want):
    assert spark.createDataFrame([(n, d)], "n double, d double").select(div("n", "d", positive=positive)).first()[0] == want


def test_zero_parent_income_falls_back(spark):
    t = statements.ttm(company(spark).withColumn("net_income_parent", F.lit(0.0)))
    h = metrics.history_features(t, P, ["ticker"]).where("year = 2026 AND quarter = 2")
    h = h.withColumn("market_cap", F.lit(1000.0)).withColumn("shares_out", F.lit(100.0)).withColumn("track", F.lit("T1"))
    assert near(metrics.ratios(h, P).first().eps, 0.624)


@pytest.mark.parametrize("cur, want", [(None, True), (" ", True), ("krw", True), ("usd", False)])
def test_currency_mask(spark, cur, want):
    t = statements.ttm(company(spark).withColumn("currency", F.lit(cur).cast("string")))
    h = metrics.history_features(t, P, ["ticker"]).where("year = 2026 AND quarter = 2")
    h = h.withColumn("market_cap", F.lit(1000.0)).withColumn("shares_out", F.lit(100.0)).withColumn("track", F.lit("T1"))
    r = metrics.ratios(h, P).first()
    assert (r.per is not None) == want and r.roe is not None


def test_late_filing_is_not_seen_early(spark):
    """A quarter received late must not feed growth of a later quarter before its receipt."""
    q = company(spark).withColumn("rcept_dt", F.when(F.col("period") == 2025 * 4 + 1, F.lit("2026-07-01").cast("date")).otherwise(F.col("rcept_dt")))
    t = statements.ttm(q).withColumn("revenue_ttm", F.col("revenue_ttm") + F.col("period"))
    dates = F.array(*[F.lit(d).cast("date") for d in ("2026-06-05", "2026-07-05")])
    got = {str(r["asof"]): r for r in panel.fundamentals_on_dates(t, dates, P).collect()}
    assert got["2026-06-05"].period == got["2026-07-05"].period == 2026 * 4 + 4  # the fourth quarter carries a March receipt
    early = panel.fundamentals_on_dates(t.where("rcept_dt <= '2026-06-05'"), dates, P).where("asof = '2026-06-05'").first()
    for name in ("growth_volatility", "revenue_growth_yoy", "growth_acceleration", "_norm_margin"):
        a, b = got["2026-06-05"][name], early[name]
        assert (a is None and b is None) or math.isclose(a, b), name
