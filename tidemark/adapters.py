"""Model tables derived from the star-schema tables (lineitem, supplier, nation, events).

The first step always aggregates lineitem to (supplier, day) or (supplier, quarter), combined
before the shuffle, so one supplier with a third of all lines costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.params import Params

# thresholds in the currency of the test tables
PARAMS = Params().with_(universe_size=50, min_market_cap=4.0e6, min_avg_trading_value=3.0e4,
                        value_cap_floor=4.0e6, growth_cap_floor=2.4e6, mention_window_days=20,
                        delist_gap_days=4, extension_days=5)


def ticker_of(key: Column) -> Column:
    pad = lambda k: F.when(F.length(k.cast("string")) >= 5, k.cast("string")).otherwise(
        F.lpad(k.cast("string"), 5, "0"))
    return F.when(key % 10 == 3, F.concat(pad(key - 1), F.lit("5"))).otherwise(
        F.concat(pad(key), F.lit("0")))


def _lines(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(*cols)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date) prices of every supplier and day with a line."""
    k = F.col("l_suppkey")
    d = (_lines(spark, folder, "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
         .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
         .agg(F.round(F.sum("l_extendedprice"), 2).alias("trading_value"), F.sum("l_quantity").alias("volume")))
    return d.select(
        ticker_of(k).alias("ticker"), k.alias("key"), "date",
        (F.col("trading_value") / F.col("volume")).alias("close_adj"), "volume", "trading_value")


def price_stores(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and current store that overlap in 1999-2000; the current one is 1% higher."""
    hist = px.where(F.col("date") < "2001-01-01")
    cur = px.where(F.col("date") >= "1999-01-01").withColumn("close_adj", F.col("close_adj") * 1.01)
    return hist, cur


def fin_quarterly(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative quarterly statements with late filings."""
    op = F.col("l_extendedprice") * (0.015 - F.col("l_discount") + F.col("l_tax"))
    q = (_lines(spark, folder, "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
         .groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("year"),
                  F.quarter("l_shipdate").alias("quarter"))
         .agg(F.round(F.sum("l_extendedprice"), 2).alias("q_ext"), F.round(F.sum(op), 6).alias("q_op"))
         .withColumn("period", F.col("year") * 4 + F.col("quarter")))
    in_year = W.partitionBy("key", "year").orderBy("quarter").rowsBetween(W.unboundedPreceding, 0)
    run = W.partitionBy("key").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    q = q.withColumns({"ext": F.round(F.sum("q_ext").over(in_year), 2),
                       "op": F.round(F.sum("q_op").over(in_year), 6),
                       "run_op": F.round(F.sum("q_op").over(run), 6)})
    sup = spark.read.parquet(f"{folder}/supplier.parquet").select(
        F.col("s_suppkey").alias("key"), "s_acctbal", "s_nationkey")
    q = q.join(sup, "key")
    k, ext, op, period = F.col("key"), F.col("ext"), F.col("op"), F.col("period")
    shift = (F.when((k % 6 == 1) & (period >= 1998 * 4 + 3), 0.6)
              .when((k % 8 == 3) & (period >= 1999 * 4 + 2), 1.8).otherwise(1.0))
    q = q.withColumns({"pretax_income": 0.95 * op + 0.002 * ext,
                       "equity": (200000.0 + 10.0 * F.col("s_acctbal") + 2.0 * F.col("run_op")) * shift})
    q = q.withColumns({"tax_expense": F.col("pretax_income") * ((F.lit(10) + k % 60) / 100.0),
                       "liabilities": F.col("equity") * ((F.lit(4) + 3 * (k % 8)) / 10.0)})
    q = q.withColumns({"net_income": F.col("pretax_income") - F.col("tax_expense"),
                       "assets": F.col("equity") + F.col("liabilities")})
    quarter_end = F.last_day(F.make_date("year", F.col("quarter") * 3, F.lit(1)))
    lag = (F.when((k % 15 == 8) & (period == 1998 * 4 + 1), 400)
            .when(F.col("quarter") == 4, 90).otherwise(45))
    code = F.create_map(*[x for c, n in spec.REPORT_QUARTER.items() for x in (F.lit(n), F.lit(c))])
    nation = F.col("s_nationkey")
    currency = (F.when(nation % 7 == 0, "USD").when(nation % 7 == 1, " ").when(nation % 7 == 2, None)
                 .when(nation % 7 == 3, "krw").otherwise("KRW"))
    ni, eq = F.col("net_income"), F.col("equity")
    return q.select(
        ticker_of(k).alias("ticker"), k.cast("string").alias("corp_code"), "year", "quarter", "period",
        code[F.col("quarter")].alias("reprt_code"), F.lit("CFS").alias("fs_div"),
        F.date_add(quarter_end, lag).alias("rcept_dt"), currency.alias("currency"),
        ext.alias("revenue"), (0.3 * ext + 0.5 * op).alias("gross_profit"), op.alias("operating_income"),
        "pretax_income", "tax_expense", "net_income",
        F.when(k % 11 == 0, 0.0).when(k % 13 == 1, None).otherwise(0.9 * ni).alias("net_income_parent"),
        (1.1 * ni + 0.004 * ext).alias("ocf"),
        F.when(k % 9 != 4, 0.003 * ext).alias("capex_tangible"),
        F.when(k % 4 == 2, 0.0005 * ext).alias("capex_intangible"),
        F.when(k % 5 == 0, 0.01 * ext).alias("depreciation"), F.when(k % 5 == 0, F.lit(0.0)).alias("amortization"),
        "assets", (0.4 * F.col("assets")).alias("current_assets"), "liabilities",
        (F.col("liabilities") * ((F.lit(3) + k % 5) / 10.0)).alias("current_liabilities"), "equity",
        F.when(k % 13 == 0, None).when(k % 17 == 0, 0.0).otherwise(0.95 * eq).alias("equity_parent"),
        (0.1 * F.col("assets")).alias("cash"), F.when(k % 4 == 1, 0.05 * eq).alias("hybrid_capital"))


# fixed values: accounts written by the raw-statement adapter (field, division, id, name)
RAW_ACCOUNTS = [
    ("revenue", "IS", "ifrs-full_Revenue", "매출액"),
    ("gross_profit", "CIS", "-", "매출총이익"),
    ("operating_income", "IS", "-", "영업이익(손실)"),
    ("pretax_income", "IS", "-", "법인세비용차감전순이익"),
    ("tax_expense", "IS", "ifrs_IncomeTaxExpenseContinuingOperations", "법인세"),
    ("net_income", "IS", "-", "당기순이익"),
    ("net_income_parent", "IS", "ifrs-full_ProfitLossAttributableToOwnersOfParent", "지배기업 소유주지분"),
    ("ocf", "CF", "-", "영업활동 현금흐름"),
    ("capex_tangible", "CF", "-", "유형자산의 취득"),
    ("capex_intangible", "CF", "-", "무형자산의 취득"),
    ("depreciation", "CF", "-", "감가상각비"),
    ("assets", "BS", "ifrs-full_Assets", "자산총계"),
    ("liabilities", "BS", "-", "부채총계"),
    ("equity", "BS", "ifrs-full_Equity", "자본총계"),
    ("cash", "BS", "-", "현금 및 현금성자산"),
    # traps: known id in the wrong division, excluded id, excluded name, repeated line
    ("assets", "IS", "ifrs-full_Assets", "자산총계"),
    ("net_income", "CIS", "ifrs-full_ComprehensiveIncome", "당기순이익"),
    ("net_income", "IS", "-", "당기순이익 주당이익"),
    ("operating_income", "IS", "-", "영업이익 조정"),
    ("capex_tangible", "CF", "-", "유형자산의 증가"),
]


def raw_statements(q: DataFrame) -> DataFrame:
    """Statement rows with amounts as text, as filed."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(sj).alias("sj_div"), F.lit(aid).alias("account_id"),
                     F.lit(nm).alias("account_nm"), F.lit(field in spec.FLOW_FIELDS).alias("flow"),
                     F.col(field).alias("amount"))
            for i, (field, sj, aid, nm) in enumerate(RAW_ACCOUNTS)]
    d = q.select("ticker", "corp_code", F.col("year").alias("bsns_year"), "quarter", "reprt_code",
                 F.when(F.col("corp_code").endswith("9"), "OFS").otherwise("CFS").alias("fs_div"),
                 "currency", F.explode(F.array(*rows)).alias("r"))
    d = d.select(*[x for x in d.columns if x != "r"], "r.*")

    def text(col: Column) -> Column:
        n = F.round(col, 0)
        body = F.format_number(F.abs(n), 0)
        wrapped = F.when(F.col("quarter") % 2 == 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(
            F.concat(F.lit("-"), body))
        return F.when(n.isNull(), "-").when(n < 0, wrapped).otherwise(body)

    part = F.col("flow") & (F.col("quarter") != 4)
    return (d.withColumn("thstrm_amount", text(F.when(part, F.col("amount") / 2).otherwise(F.col("amount"))))
            .withColumn("thstrm_add_amount", F.when(part, text(F.col("amount"))).otherwise(""))
            .drop("quarter", "flow", "amount"))


def filing_list(q: DataFrame) -> DataFrame:
    """Original and corrected disclosures with the fiscal period in the report name."""
    month = F.lpad((F.col("quarter") * 3).cast("string"), 2, "0")
    kind = F.when(F.col("quarter") == 4, "사업보고서").when(F.col("quarter") == 2, "반기보고서").otherwise("분기보고서")
    detail = F.when(F.col("quarter") == 4, "A001").when(F.col("quarter") == 2, "A002").otherwise("A003")
    rows = F.array(F.struct(F.lit("").alias("pre"), F.lit(0).alias("late")),
                   F.struct(F.lit("[기재정정]").alias("pre"), F.lit(30).alias("late")))
    return q.select("corp_code", detail.alias("detail_type"), "rcept_dt", kind.alias("kind"), "year", month.alias("m"),
                    F.explode(rows).alias("x")).select(
        "corp_code", "detail_type",
        F.concat("x.pre", "kind", F.lit(" ("), F.col("year").cast("string"), F.lit("."), "m", F.lit(")")).alias("report_nm"),
        F.date_format(F.date_add("rcept_dt", F.col("x.late")), "yyyyMMdd").alias("rcept_dt"))


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Region decides the track, nation is the sector."""
    # nation has a fixed 25 rows
    nation = spark.read.parquet(f"{folder}/nation.parquet").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    sup = spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name")
    r, k = F.col("n_regionkey"), F.col("s_suppkey")
    track = (F.when(r == 1, spec.FINANCE).when(r == 2, spec.PHARMA).when(r == 3, spec.HOLDING)
              .otherwise(spec.GENERAL))
    return (sup.join(F.broadcast(nation), "s_nationkey")
            .select(ticker_of(k).alias("ticker"), F.col("s_name").alias("name"), track.alias("track"),
                    F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("sector"),
                    (k % 14 == 6).alias("stability_distorted")))


def shares_of(key: Column) -> Column:
    return F.lit(1000) + 100 * (key % 50)


def market(px: DataFrame) -> DataFrame:
    """Daily market rows; on the 13th of a month nothing is settled yet (all zero)."""
    settled = F.dayofmonth("date") != 13
    shares = shares_of(F.col("key"))
    return px.select(
        "ticker", F.concat(F.lit("C"), F.col("key").cast("string")).alias("name"),
        F.when(F.col("key") % 2 == 0, "KOSPI").otherwise("KOSDAQ").alias("market"), "date",
        F.when(settled, F.col("close_adj")).otherwise(0.0).alias("close"),
        F.when(settled, F.col("close_adj") * shares).otherwise(0.0).alias("market_cap"),
        shares.alias("shares_out"), "volume",
        F.when(settled, F.col("trading_value")).otherwise(0.0).alias("trading_value"))


def rebalance_dates(px: DataFrame) -> Column:
    from tidemark.functions.exprs import rebalance_days
    return px.agg(rebalance_days(F.min("date"), F.max("date")).alias("d")).scalar()


# fixed values: brokers and foreign flag of the mention adapter
BROKERS = ["한국투자증권", "미래에셋증권", "KB증권", "키움증권", "하나증권", "대신증권", "골드만삭스"]


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Target-price mentions from events: user -> ticker, value band -> target."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    broker = F.element_at(F.array(*[F.lit(b) for b in BROKERS]), (F.col("event_id") % 7 + 1).cast("int"))
    direction = (F.when(F.col("event_type") == "click", "상향").when(F.col("event_type") == "error", "하향")
                  .when(F.col("event_type") == "signup", "신규").when(F.col("event_type") == "view", "유지"))
    return e.select(F.col("event_id").alias("mention_id"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("ticker"),
                    broker.alias("broker"), (F.col("event_id") % 7 == 6).alias("foreign"),
                    (F.ceil(F.col("value") / 50.0) * 50).cast("double").alias("target"),
                    direction.alias("direction"), F.date_trunc("second", "ts").alias("pub"))


def treasury_list(spark: SparkSession, folder: str) -> DataFrame:
    """Treasury disclosures: detail lines, a total line, and for one in three only a blank total."""
    k = F.col("s_suppkey")
    line = lambda m, q: F.struct(F.lit(m).alias("acqs_mth1"), q.alias("trmend_qy"))
    qty = F.format_number((k * 7) % 2000, 0)
    rows = F.array(line("장내 직접취득", F.lit("10")), line("총계", F.when(k % 3 == 0, F.lit("-")).otherwise(qty)),
                   line("소계", F.lit("99")))
    return (spark.read.parquet(f"{folder}/supplier.parquet")
            .select(k.cast("string").alias("corp_code"), F.lit(1999).alias("year"), F.explode(rows).alias("r"))
            .select("corp_code", "year", "r.*"))


def company_list(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{folder}/supplier.parquet").select(
        k.cast("string").alias("corp_code"), ticker_of(k).alias("ticker"), F.col("s_name").alias("corp_name"),
        F.when(k % 8 == 0, "64992").when(k % 8 == 1, "651").when(k % 8 == 2, "21101").when(k % 8 == 3, "26110")
        .when(k % 8 == 4, "").when(k % 8 == 5, None).otherwise(F.concat((F.lit(20) + k % 12).cast("string"), F.lit("111"))).alias("induty_code"))


def finance_lines(q: DataFrame) -> DataFrame:
    """Balance-sheet lines of annual reports; every sixth company holds finance receivables."""
    big = F.col("corp_code").cast("long") % 6 == 0
    line = lambda nm, x: F.struct(F.lit(nm).alias("account_nm"), F.format_number(F.round(x, 0), 0).alias("thstrm_amount"))
    rows = F.array(line("금융업채권", F.when(big, F.col("assets") * 0.5).otherwise(F.lit(0.0))), line("재고자산", F.col("assets") * 0.2),
                   line("금융리스 채권", F.when(big, F.col("assets") * 0.1).otherwise(F.lit(0.0))))
    return q.where("quarter = 4").select("ticker", F.col("year").alias("bsns_year"), "reprt_code", F.lit("BS").alias("sj_div"),
                                         F.explode(rows).alias("r")).select("ticker", "bsns_year", "reprt_code", "sj_div", "r.*")


# ---- articles and reports ------------------------------------------------------------------------
def _user_ticker(user: Column) -> Column:
    return F.lpad(user.cast("string"), 6, "0")


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, name) of every user; names have a fixed width so none is the head of another."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct()
    return e.select(_user_ticker(F.col("user_id")).alias("ticker"), F.concat(F.lit("종목"), _user_ticker(F.col("user_id"))).alias("name"))


def listed_names(firms: DataFrame) -> DataFrame:
    """All listed names: one company in five has a listed holding with a longer name."""
    holding = firms.where(F.col("ticker").cast("long") % 5 == 0).select(F.concat("name", F.lit("홀딩스")).alias("name"))
    return firms.select("name").unionByName(holding)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """One article per event, in six shapes that each test one attribution rule."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    broker = F.element_at(F.array(*[F.lit(b) for b in BROKERS]), (F.col("event_id") % 7 + 1).cast("int"))
    name = text("종목", _user_ticker(F.col("user_id")))
    other = text("종목", _user_ticker(F.col("user_id") + 1))
    a = F.ceil(F.col("value") / 50.0)
    up, amount = (a + 1).cast("string"), a.cast("string")
    word = (F.when(F.col("event_type") == "click", " 상향").when(F.col("event_type") == "error", " 하향")
             .when(F.col("event_type") == "signup", " 신규 제시").when(F.col("event_type") == "view", " 유지").otherwise(""))
    shape = F.col("event_id") % 6
    holding = F.when(F.col("user_id") % 5 == 0, text(broker, " ", name, "홀딩스 목표가 9만원. ")).otherwise("")
    title = (F.when(shape == 0, text(broker, ", ", name, " 목표주가 ", amount, "만원으로", word))
              .when(shape == 1, text(name, " 실적 전망")).when(shape == 2, "이번주 7종목 추천")
              .when(shape == 3, text(other, " 호조")).when(shape == 4, text(name, " 주목"))
              .otherwise(text(name, " ", broker, " 목표주가 ", amount, "만원 제시")))
    body = (F.when(shape == 0, text("<b>", name, "</b> 실적 &amp; 전망"))
             .when(shape.isin(1, 2), text(name, " 관련 소식. ", holding, broker, "은 ", name, "의 목표가를 ", up, "만원에서 ", amount, "만원으로 올렸다. 끝."))
             .when(shape == 3, text(broker, " ", name, " 목표주가 ", amount, "만원 제시"))
             .when(shape == 4, text(other, "와 ", name, " 목표주가 ", amount, "만원 ", broker, " 제시."))
             .otherwise(text(broker, "은 ", name, " 목표가 ", up, "만원을 제시했다.")))
    return e.select(F.col("event_id").alias("article_id"), _user_ticker(F.col("user_id")).alias("ticker"), title.alias("title"),
                    body.alias("description"), F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0900")).alias("pubDate"),
                    F.concat(F.lit("http://news/"), F.col("event_id").cast("string")).alias("link"))


def news_pages(art: DataFrame) -> DataFrame:
    """Raw result pages: an article appears on the page of its day and again on a later page."""
    link = F.concat(F.lit("http://news/"), (F.floor(F.col("article_id") / 2)).cast("string"))
    item = F.struct("title", "description", "pubDate", F.when(F.col("article_id") % 10 == 0, "").otherwise(link).alias("originallink"),
                    F.when(F.col("article_id") % 20 == 0, "").otherwise(link).alias("link"))
    page = F.array(F.col("article_id") % 7, F.col("article_id") % 7 + 100)
    rows = art.select("ticker", F.explode(page).alias("page"), "article_id", item.alias("item"))
    # one page of one query
    return (rows.groupBy("ticker", "page").agg(F.sort_array(F.collect_list(F.struct("article_id", "item"))).alias("items"))
            .select(F.format_string("%03d", "page").alias("page"), F.to_json(F.struct(
                F.col("ticker").alias("query"), F.transform("items", lambda x: x["item"]).alias("items"))).alias("json")))


def statement_docs(raw: DataFrame) -> DataFrame:
    """Raw filing documents; one company in eleven answers 'no data'."""
    line = F.struct("sj_div", "account_id", "account_nm", "thstrm_amount", "thstrm_add_amount", "currency")
    g = raw.groupBy("ticker", "corp_code", "bsns_year", "reprt_code", "fs_div").agg(
        F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("_l"))
    status = F.when(F.col("corp_code").cast("long") % 11 == 5, "013").otherwise("000")
    return g.select(F.to_json(F.struct(status.alias("status"), "corp_code", "ticker", "bsns_year", "reprt_code", "fs_div",
                                       F.transform("_l", lambda x: x["line"]).alias("list"))).alias("json"))


def reports(m: DataFrame) -> DataFrame:
    """Manual reports: purchases, some undated or without a target."""
    return m.where("direction IS NULL").select(
        "ticker", "broker", F.when(F.col("mention_id") % 9 != 0, F.add_months(F.to_date("pub"), -(F.col("mention_id") % 10).cast("int"))).alias("date"),
        F.when(F.col("mention_id") % 8 != 0, F.col("target")).alias("target"))


def verdict_history(scored: DataFrame) -> DataFrame:
    """Verdict codes of the growth strategy by score band, NULL where there is no score."""
    s = F.col("score")
    code = F.when(s >= 70, "buy").when(s >= 60, "hold").when(s >= 40, "defer").when(s.isNotNull(), "out")
    return scored.where(F.col("strategy") == "growth").select("ticker", "asof", code.alias("code"))


def rule_inputs(scored: DataFrame) -> DataFrame:
    """Graded rows with both pass flags and stand-in consensus columns."""
    flags = scored.groupBy("asof", "ticker").agg(*[
        F.max(F.when(F.col("strategy") == s, F.col("pass"))).alias(f"{s}_pass") for s in spec.STRATEGY_WEIGHTS])
    d = scored.where("strategy = 'value'").join(flags, ["asof", "ticker"])
    k = F.col("fin_period")
    return d.withColumns({"n_brokers": k % 7, "upside": F.col("quality_score") - 40.0, "revision": (k % 3 - 1) * 0.5})
