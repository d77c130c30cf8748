"""Scans and sinks: Parquet, CSV with comments, raw JSON documents, and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tidemark.functions.exprs import parse_amount
from tidemark.operators.dedupe import keep_first


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table by name; a missing table is an error."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, folder: str, name: str, *, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with `#` comment lines and a header; columns are taken by name, absent ones are NULL.

    A missing file gives an empty typed frame. Every column is read as text and cast without
    failing, so a bad value is NULL.
    """
    try:
        raw = (spark.read.option("header", True).option("comment", "#").option("encoding", "UTF-8")
               .option("mode", "PERMISSIVE").csv(path))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    found = {x.replace("﻿", "").strip(): x for x in raw.columns}
    cols = []
    for f in schema.fields:
        if f.name not in found:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        x = F.trim(F.col(f"`{found[f.name]}`"))
        cols.append(x.try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


# fixed values: header of the manual report file
REPORT_COLUMNS = ["ticker", "증권사", "작성자", "날짜", "투자의견", "목표주가", "제목", "url"]
REPORT_NAMES = ["ticker", "broker", "author", "date", "opinion", "target", "title", "url"]


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Manually kept broker reports; tickers padded to six digits, prices parsed leniently."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in REPORT_COLUMNS])
    d = read_csv(spark, path, schema).toDF(*REPORT_NAMES)
    return (d.where(F.col("ticker").isNotNull())
            .withColumn("ticker", F.when(F.length("ticker") < 6, F.lpad("ticker", 6, "0")).otherwise(F.col("ticker")))
            .withColumn("date", F.col("date").try_cast("date"))
            .withColumn("target", parse_amount("target")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


STATEMENT_DOC = ("status string, corp_code string, ticker string, bsns_year int, reprt_code string, "
                 "fs_div string, list array<struct<sj_div:string,account_id:string,account_nm:string,"
                 "thstrm_amount:string,thstrm_add_amount:string,currency:string>>")
NEWS_DOC = ("query string, items array<struct<title:string,description:string,pubDate:string,"
            "originallink:string,link:string>>")


def statement_rows(docs: DataFrame, column: str = "json") -> DataFrame:
    """Raw statement documents -> rows in document order; any status but 000 holds no rows."""
    d = docs.select(F.from_json(F.col(column), STATEMENT_DOC).alias("d")).where("d.status = '000'")
    return (d.select("d.corp_code", "d.ticker", "d.bsns_year", "d.reprt_code", "d.fs_div",
                     F.posexplode("d.list").alias("ord", "r"))
            .select("corp_code", "ticker", "bsns_year", "reprt_code", "fs_div", "ord", "r.*"))


def company_profiles(docs: DataFrame) -> DataFrame:
    """(corp_code, induty_code) of answered profile requests."""
    return docs.where("status = '000'").select("corp_code", "induty_code")


def news_articles(pages: DataFrame, column: str = "json", page_key: str = "page") -> DataFrame:
    """Cached news pages -> distinct articles per query, first page wins; no link, no article."""
    d = pages.select(F.col(page_key).alias("_page"), F.from_json(F.col(column), NEWS_DOC).alias("d"))
    rows = d.select("_page", "d.query", F.posexplode("d.items").alias("_pos", "r")).select("_page", "query", "_pos", "r.*")
    rows = rows.withColumn("article", F.coalesce(F.nullif("originallink", F.lit("")), F.nullif("link", F.lit(""))))
    return keep_first(rows.where(F.col("article").isNotNull()), ["query", "article"], "_page", "_pos").drop("_page", "_pos")


def project(df: DataFrame, names: dict[str, str], **constants) -> DataFrame:
    """Source columns renamed into model columns, plus constant columns."""
    return df.select(*[F.col(f"`{s}`").alias(d) for s, d in names.items() if s in df.columns],
                     *[F.lit(v).alias(k) for k, v in constants.items()])


# fixed values: source headers of the market tables
SNAPSHOT_NAMES = {"티커": "ticker", "종가": "close", "시가총액": "market_cap", "거래량": "volume",
                  "거래대금": "trading_value", "상장주식수": "shares_out"}
PRICE_NAMES = {"ticker": "ticker", "날짜": "date", "시가": "open", "고가": "high", "저가": "low",
               "종가": "close_adj", "거래량": "volume", "거래대금": "trading_value", "등락률": "change_pct"}
FLOW_NAMES = {"ticker": "ticker", "날짜": "date", "외국인합계": "foreign_net", "기관합계": "inst_net",
              "개인": "retail_net"}
FUNDAMENTAL_NAMES = {"티커": "ticker", "BPS": "bps", "PER": "per", "PBR": "pbr", "EPS": "eps",
                     "DIV": "div", "DPS": "dps"}


def scratch_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables below `spark.checkpoint.dir`, which the cluster names.

    Only a session on one machine without that setting (tests) gets a temporary folder; on a cluster other executors could
    not read one, so its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a shared intermediate once and reads it back: later jobs prune and survive losses."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
