"""Raw statement rows -> one wide row per report -> trailing twelve months."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import parse_amount
from tidemark.operators.dedupe import keep_first

REPORT = ["ticker", "corp_code", "bsns_year", "reprt_code", "fs_div"]


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def clean_account(account_id, account_nm) -> tuple[Column, Column]:
    """Trimmed id, and name without spaces and parentheses."""
    return (F.trim(F.coalesce(account_id, F.lit(""))),
            F.regexp_replace(F.coalesce(account_nm, F.lit("")), r"[\s()]", ""))


def standard_field(aid, name, sj_div) -> Column:
    """Standard field of a cleaned account row, NULL when it must not be used.

    A known id decides alone (a known id in the wrong statement is NULL); otherwise excluded ids
    and names drop out and the first matching name rule wins.
    """
    by_id = _literal_map(spec.ACCOUNT_IDS)[aid]
    home = F.create_map(*[x for f, sj, _ in spec.ACCOUNT_NAMES
                          for x in (F.lit(f), F.array(*[F.lit(s) for s in sj]))])
    by_name = F.coalesce(*[
        F.when(sj_div.isin(*sj) & name.rlike("|".join(patterns)), F.lit(field))
        for field, sj, patterns in spec.ACCOUNT_NAMES])
    excluded = aid.rlike(spec.EXCLUDED_ID_TOKENS) | name.rlike(spec.EXCLUDED_NAMES)
    return (F.when(by_id.isNotNull(), F.when(F.array_contains(home[by_id], sj_div), by_id))
             .when(excluded, F.lit(None).cast("string"))
             .otherwise(by_name))


def cumulative_amount(reprt_code, this_term, accumulated) -> Column:
    """Annual reports carry the full year; others prefer the accumulated amount."""
    this_term, accumulated = parse_amount(this_term), parse_amount(accumulated)
    return F.when(reprt_code == spec.ANNUAL_REPORT, this_term).otherwise(
        F.coalesce(accumulated, this_term))


def account_dictionary(rows: DataFrame) -> DataFrame:
    """Distinct (account_id, account_nm, sj_div) with their standard field: patterns run once per wording, not per line."""
    d = rows.select("account_id", "account_nm", "sj_div").distinct()
    aid, name = clean_account(F.col("account_id"), F.col("account_nm"))
    d = d.withColumn("_aid", aid).withColumn("_name", name)
    return d.select("account_id", "account_nm", "sj_div", standard_field(F.col("_aid"), F.col("_name"), F.col("sj_div")).alias("field"))


def classified_rows(rows: DataFrame, store: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> DataFrame:
    """Rows with `field` and `val`. With `store` the dictionary is written first, so its size decides how it is joined."""
    words = store(account_dictionary(rows).where("field IS NOT NULL"), "account_dictionary")
    blank = lambda d: d.withColumns({"_a": F.coalesce("account_id", F.lit("")), "_b": F.coalesce("account_nm", F.lit("")), "_c": F.coalesce("sj_div", F.lit(""))})
    words = blank(words).select("_a", "_b", "_c", "field").distinct()
    rows = blank(rows).join(words, ["_a", "_b", "_c"], "left").drop("_a", "_b", "_c")
    stock = parse_amount("thstrm_amount")
    flow = cumulative_amount(F.col("reprt_code"), F.col("thstrm_amount"), F.col("thstrm_add_amount"))
    return rows.withColumn("val", F.when(F.col("field").isin(*spec.STOCK_FIELDS), stock).when(F.col("field").isNotNull(), flow))


def report_currency(rows: DataFrame) -> DataFrame:
    """Most frequent currency of each report, the first in order on a tie, KRW where none is given."""
    cur = F.when(F.trim("currency") != "", F.trim("currency"))
    n = rows.groupBy(*REPORT, cur.alias("_cur")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.when(F.col("_cur").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_cur").alias("cur"))))
    return n.groupBy(*REPORT).agg(F.coalesce(best["cur"], F.lit("KRW")).alias("currency"))


def wide_reports(rows: DataFrame, store: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> DataFrame:
    """One row per report with every standard field as a column (NULL when absent).

    The first non-NULL row of a field wins; capital expenditure lines are added up. The aggregate holds numbers only, so it
    hashes; the modal currency is a small count of its own with the same partitioning.
    """
    r = classified_rows(rows, store)

    def pick(f: str) -> Column:
        mine = (F.col("field") == f) & F.col("val").isNotNull()
        if f in spec.CAPEX_FIELDS:
            return F.sum(F.when(mine, F.abs("val"))).alias(f)
        return F.min_by(F.when(mine, F.col("val")), F.when(mine, F.col("ord"))).alias(f)

    wide = r.groupBy(*REPORT).agg(*[pick(f) for f in spec.FLOW_FIELDS + spec.STOCK_FIELDS])
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in REPORT]
    out = wide.alias("w").join(report_currency(rows).alias("c"), reduce(lambda x, y: x & y, same))
    return out.select(*[f"w.{k}" for k in REPORT], "c.currency", *[f"w.{f}" for f in spec.FLOW_FIELDS + spec.STOCK_FIELDS])


def filing_dates(filings: DataFrame) -> DataFrame:
    """Earliest receipt per (corp, year, report); later corrections never move it."""
    name = F.regexp_replace("report_nm", " ", "")
    year = F.regexp_extract(name, r"\((\d{4})\.(\d{2})", 1).try_cast("int")
    month = F.regexp_extract(name, r"\((\d{4})\.(\d{2})", 2)
    code = F.coalesce(*[F.when(month == m, F.lit(rc)) for rc, m in spec.REPORT_MONTH.items()])
    # fixed values: disclosure type that each report code is filed under
    kind = {"11011": "A001", "11012": "A002", "11013": "A003", "11014": "A003"}
    return (filings.withColumn("bsns_year", year).withColumn("reprt_code", code)
            .where(F.col("reprt_code").isNotNull()
                   & (_literal_map(kind)[F.col("reprt_code")] == F.col("detail_type")))
            .groupBy("corp_code", "bsns_year", "reprt_code")
            .agg(F.min(F.to_date(F.nullif("rcept_dt", F.lit("")), "yyyyMMdd")).alias("rcept_dt")))


def fin_quarterly(rows: DataFrame, filings: DataFrame, store: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> DataFrame:
    """Consolidated report when it has any row, else separate; no receipt date, no row."""
    fields = spec.FLOW_FIELDS + spec.STOCK_FIELDS
    chosen = keep_first(wide_reports(rows, store), ["ticker", "corp_code", "bsns_year", "reprt_code"], "fs_div")
    any_value = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])
    quarter = F.create_map(*[F.lit(x) for kv in spec.REPORT_QUARTER.items() for x in kv])
    return (chosen.where(any_value)
            .join(filing_dates(filings).where(F.col("rcept_dt").isNotNull()),
                  ["corp_code", "bsns_year", "reprt_code"])
            .withColumn("quarter", quarter[F.col("reprt_code")])
            .withColumn("period", F.col("bsns_year") * 4 + F.col("quarter"))
            .select("ticker", "corp_code", F.col("bsns_year").alias("year"), "quarter", "period",
                    "reprt_code", "fs_div", "rcept_dt", "currency", *fields))


def ttm(q: DataFrame) -> DataFrame:
    """Trailing twelve months of flows, end values of stocks, average balances.

    TTM = cumulative + prior annual - prior same-quarter cumulative, found by period (gaps give
    NULL); averages use the row four rows back (gaps are not respected there). A ticker has one
    row per quarter, so windows by ticker stay small.
    """
    by_period = W.partitionBy("ticker").orderBy("period")
    flows = F.struct(*[F.col(f) for f in spec.FLOW_FIELDS])
    annual = F.max(F.when(F.col("quarter") == 4, flows)).over(by_period.rangeBetween(-3, -1))
    same = F.max(flows).over(by_period.rangeBetween(-4, -4))
    d = q.withColumn("_annual", annual).withColumn("_same", same)
    d = d.withColumns({
        f + "_ttm": F.when(F.col("quarter") == 4, F.col(f)).otherwise(
            F.col(f) + F.col(f"_annual.{f}") - F.col(f"_same.{f}"))
        for f in spec.FLOW_FIELDS})
    d = d.withColumns({
        s + "_avg": F.coalesce((F.col(s) + F.lag(s, 4).over(by_period)) / 2.0, F.col(s))
        for s in ("equity", "equity_parent", "assets")})
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    d = d.withColumn("capex_ttm", F.nullif(zero("capex_tangible_ttm") + zero("capex_intangible_ttm"),
                                           F.lit(0.0)))
    d = d.withColumn("fcf_ttm", F.col("ocf_ttm") - F.col("capex_ttm"))
    d = d.withColumn("da_ttm", F.nullif(zero("depreciation_ttm") + zero("amortization_ttm"),
                                        F.lit(0.0)))
    keys = ["ticker", "corp_code", "year", "quarter", "period", "reprt_code", "fs_div", "rcept_dt",
            "currency"]
    return d.select(*keys, *[f + "_ttm" for f in spec.FLOW_FIELDS], *spec.STOCK_FIELDS,
                    "equity_avg", "equity_parent_avg", "assets_avg", "capex_ttm", "fcf_ttm", "da_ttm")


def single_quarter(q: DataFrame) -> DataFrame:
    """Quarter flows as differences of the cumulative rows of one year."""
    in_year = W.partitionBy("ticker", "year").orderBy("quarter")
    return q.withColumns({
        f + "_q": F.when(F.col("quarter") == 1, F.col(f)).otherwise(F.col(f) - F.lag(f).over(in_year))
        for f in spec.FLOW_FIELDS})


def treasury_shares(rows: DataFrame) -> DataFrame:
    """Treasury shares at term end: sum of the 'total' lines, NULL when there is none."""
    qty = F.trim(F.regexp_replace("trmend_qy", ",", ""))
    total = F.col("acqs_mth1").contains("총") & F.col("acqs_mth1").contains("계") & qty.rlike(r"^-*\d+$")
    return rows.groupBy("corp_code", "year").agg(
        F.sum(F.when(total, qty).try_cast("long")).alias("treasury"))


def issuer_root(ticker="ticker") -> Column:
    return F.expr(f"left({ticker}, length({ticker}) - 1)")


def total_shares(snapshot: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Common share rows with the shares and market value of all classes of their issuer."""
    keys = keys or []
    d = snapshot.select(*keys, "ticker", "shares_out", "market_cap", issuer_root().alias("root"))
    agg = d.groupBy(*keys, "root").agg(F.sum("shares_out").alias("shares_total"),
                                       F.sum("market_cap").alias("market_cap_total"))
    common = d.where(F.col("ticker").endswith("0")).select(
        *keys, "ticker", "root", F.col("shares_out").alias("shares_common"),
        F.col("market_cap").alias("market_cap_common"))
    return (common.join(agg, [*keys, "root"], "left")
            .withColumn("has_preferred", F.col("shares_total") > F.col("shares_common"))
            .drop("root"))


def outstanding_shares(shares: DataFrame, treasury: DataFrame) -> DataFrame:
    """Shares net of treasury; unknown treasury counts as zero and is flagged."""
    d = shares.join(treasury.select("ticker", "treasury"), "ticker", "left")
    known = F.col("treasury").isNotNull()
    t = F.coalesce("treasury", F.lit(0))
    return (d.withColumn("treasury_known", known).withColumn("treasury", t)
             .withColumn("shares_outstanding", F.greatest(F.col("shares_total") - F.col("treasury"), F.lit(1)))
             .withColumn("treasury_ratio", F.col("treasury") / F.col("shares_total")))


def load_report(members: DataFrame, q: DataFrame, t: DataFrame, streaks: DataFrame,
                events: DataFrame) -> DataFrame:
    """Per member: loaded rows, TTM rows, loss streak, real restructure events, status."""
    counts = q.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    ttm_rows = t.groupBy("ticker").agg(F.count(F.lit(1)).alias("ttm_rows"))
    real = (events.where(F.col("carried") == 0).groupBy("ticker")
            .agg(F.count(F.lit(1)).alias("restructure")))
    d = (members.join(counts, "ticker", "left").join(ttm_rows, "ticker", "left")
         .join(streaks.select("ticker", "loss_streak"), "ticker", "left").join(real, "ticker", "left"))
    zero = ["rows", "ttm_rows", "loss_streak", "restructure"]
    status = (F.when(F.col("corp_code").isNull(), "skip").when(F.col("rows") == 0, "empty")
              .otherwise("ok"))
    return d.fillna(0, subset=zero).withColumn("status", status)
