"""Shared steps move no more than they need: bounded sides are broadcast, value counts are made once."""

import datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import session, spec
from tidemark.adapters import PARAMS
from tidemark.operators.ranks import row_ranks, value_positions
from tidemark.plans import grading, panel, validate
from tidemark.session import by_part_of_key
from tidemark.workspace import Workspace, workspace


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    def write(df, name):
        path = str(tmp_path_factory.mktemp("growth") / name)
        df.coalesce(1).write.parquet(path)
        return spark.read.parquet(path)
    return write


def months(spark, n=3):
    return spark.range(n).select(F.add_months(F.lit(datetime.date(1999, 1, 5)), F.col("id").cast("int")).alias("asof"))


def test_value_counts_are_made_once(spark, stored):
    nan = float("nan")
    rows = [(g, v) for g in ("a", "b", None) for v in (1.0, 1.0, -2.5, 0.0, -0.0, 7e5, None, nan, float("inf"), float("-inf"))]
    d = stored(spark.createDataFrame(rows, "g string, v double"), "values")
    out = value_positions(d, ["g"], "v")
    got = {(r.g, r.v): (r.n_below, r.n_equal, r.n_ranked) for r in out.collect()}
    vals = [v for g, v in rows if g == "a" and v is not None and v == v]
    want = {(g, v): (sum(x < v for x in vals), sum(x == v for x in vals), len(vals)) for g in ("a", "b") for v in vals}
    assert got == want
    # the file is read by one side, the other reuses its exchange
    assert "ReusedExchange" in plan(out).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("whole", [2, 100])
def test_rows_are_ranked_whole_or_by_buckets(spark, whole):
    nan = float("nan")
    values = (1.0, 1.0, -2.5, 0.0, -0.0, 7e5, None, nan, float("inf"), float("-inf"))
    rows = [(g, i, v, len(values)) for g in ("a", "b") for i, v in enumerate(values)] + [("c", 0, 3.0, 1)]
    out = row_ranks(spark.createDataFrame(rows, "g string, i int, v double, size int"), ["g"], "v", "size", whole=whole)
    got = sorted((r.g, r.i, r.n_below, r.n_equal, r.n_ranked) for r in out.collect())
    vals = [(i, v) for i, v in enumerate(values) if v is not None and v == v]
    want = [(g, i, sum(x < v for _, x in vals), sum(x == v for _, x in vals), len(vals)) for g in ("a", "b") for i, v in vals]
    assert got == want + [("c", 0, 0, 1, 1)]


def test_metric_rows_move_by_group_not_by_value(spark, stored):
    d = months(spark).crossJoin(spark.range(12).select(F.col("id").cast("string").alias("ticker"), F.col("id").cast("double").alias("roe")))
    d = stored(d.withColumns({"track": F.lit(spec.GENERAL), "sector": F.lit("01")}), "graded")
    out = grading.grade(d, PARAMS).select("asof", "ticker", "profitability_score", "profitability_n", "growth_score", "growth_n")
    moves = [x for x in plan(out).splitlines() if "hashpartitioning" in x]
    assert moves and not any("value" in x.split("hashpartitioning")[1].split(")")[0] for x in moves)
    got = sorted((int(r.ticker), r.profitability_score, r.profitability_n, r.growth_score, r.growth_n) for r in out.where("month(asof) = 1").collect())
    assert got == [(i, round((i + 1) / 12 * 100, 10), 0.35, None, 0.0) for i in range(12)]


def research(spark):
    """Scored rows of three months, two tickers and both strategies, one without a score, one without a return."""
    d = months(spark).crossJoin(spark.createDataFrame([("t1", 4.0), ("t2", None)], "ticker string, fwd_63 double"))
    d = d.crossJoin(spark.createDataFrame([(s,) for s in spec.STRATEGY_WEIGHTS], "strategy string"))
    return d.withColumn("score", F.when(F.col("strategy") != "value", 50.0)).withColumns({"market_cap": F.lit(9e6), "avg_tv": F.lit(9e9)})


def test_month_means_are_broadcast(spark, stored):
    out = panel.gate_panel(stored(research(spark), "scored"))
    assert "SortMergeJoin" not in plan(out)
    assert [(r.ticker, r.strategy, r.mkt, r.excess) for r in out.collect()] == [("t1", "growth", 4.0, 0.0)] * 3


def test_benchmarks_are_broadcast(spark, stored):
    gp = stored(panel.gate_panel(research(spark)), "gate_panel")
    out = panel.prepare(gp, PARAMS)
    # rows meet the benchmark of their month, the outermost join, without a shuffle
    assert 0 < plan(out).index("BroadcastHashJoin") < plan(out).index("SortMergeJoin")
    assert [(r.in_universe, r.cap_rank, r.b_univ, r.b_cap, r.exc_univ) for r in out.collect()] == [(True, 1, 4.0, 4.0, 0.0)] * 3


def test_peer_sizes_and_dates_are_broadcast(spark, stored):
    d = months(spark).crossJoin(spark.createDataFrame([("t1", "general", "01"), ("t2", "general", None)], "ticker string, track string, sector string"))
    d = stored(d.withColumn("quality_score", F.lit(50.0) - 20 * F.month("asof")), "peers")
    out = grading.with_peer(d, PARAMS)
    assert "SortMergeJoin" not in plan(out)
    assert out.count() == 6 and {r.peer for r in out.collect()} == {grading.WHOLE_TRACK}
    b = grading.breadth(d, PARAMS, [])
    assert plan(b).count("SortMergeJoin") == 1  # a month with the month before, not with the list of months
    assert [(r.worse_share, r.n) for r in b.orderBy("asof").collect()] == [(1.0, 2), (1.0, 2)]


def test_stored_scores_hold_each_panel_row_once(spark):
    d = spark.createDataFrame([("x",), ("y",)], "w string")
    base = d.select("w", F.array(F.struct(F.lit("growth").alias("strategy"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("gate_fails")),
                                 F.struct(F.lit("value").alias("strategy"), F.lit(None).cast("double").alias("score"), F.array(F.lit("g")).alias("gate_fails"))).alias("_s"))
    rows = sorted((r.w, r.strategy, r.score, r.gate_fails, r["pass"]) for r in panel.by_strategy(base).where("strategy = 'growth'").collect())
    assert rows == [("x", "growth", 1.0, [], True), ("y", "growth", 1.0, [], True)]
    assert panel.by_strategy(base).columns == ["w", "strategy", "score", "gate_fails", "pass"]


def test_a_month_of_ties_has_no_rank_correlation(spark):
    d = months(spark, 2).crossJoin(spark.range(12).select(F.col("id").cast("double").alias("v"))).coalesce(1)
    first = F.month("asof") == 1
    rows = d.select(F.lit("s").alias("signal"), "asof", F.when(first, 1.0).otherwise(F.col("v")).alias("x"), (F.col("v") * -2).alias("y"))
    p = PARAMS.with_(ic_min_pairs=5)
    assert [(r.asof.month, r.n, round(r.ic, 9)) for r in validate.ic_by_month(rows, p).collect()] == [(2, 12, -1.0)]


def test_months_need_no_prepared_rows(spark):
    w = Workspace(spark, "none", PARAMS)
    w.__dict__["scored"] = research(spark)
    got = spark.range(1).select(w.asofs.alias("a")).first()["a"]
    assert got == [datetime.date(1999, m, 5) for m in (1, 2, 3)]
    assert "prepared" not in w.__dict__


def test_panel_and_scores_are_one_stored_table(spark, monkeypatch):
    w, names = Workspace(spark, "none", PARAMS), []
    score = F.struct(F.lit("growth").alias("strategy"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("gate_fails"))
    w.__dict__.update(cohorts=spark.createDataFrame([("t1", 2.0), ("t2", None)], "ticker string, per double"), ttm=None, dates=None)
    monkeypatch.setattr(grading, "grade", lambda d, p: d.withColumn("quality_score", F.lit(7.0)))
    monkeypatch.setattr(panel, "with_strategies", lambda d, *rest: d.withColumn("annual_count", F.lit(3)).withColumn("_s", F.array(score)))
    monkeypatch.setattr(w, "stored", lambda df, name: names.append(name) or df)
    assert w.panel.columns == ["ticker", "per", "quality_score"]
    assert w.scored.columns == ["ticker", "per", "quality_score", "annual_count", "strategy", "score", "gate_fails", "pass"]
    assert sorted((r.ticker, r.per, r.quality_score) for r in w.panel.collect()) == [("t1", 2.0, 7.0), ("t2", None, 7.0)]
    assert names == ["scored"]


def test_sides_dealt_by_ticker_meet_where_they_are(spark, stored):
    d = stored(months(spark, 4).crossJoin(spark.createDataFrame([("t1",), ("t2",), (None,)], "ticker string")), "dealt")
    w = W.partitionBy("ticker").orderBy("asof")
    join = lambda: (d.withColumn("a", F.row_number().over(w))
                    .join(d.withColumn("b", F.lead("asof").over(w)).select("ticker", "asof", "b", F.lit(1).alias("x")), ["ticker", "asof"]))
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before, outside = spark.conf.get(key), plan(join())
    with by_part_of_key(spark):
        inside = plan(join())
    assert "hashpartitioning(ticker" in inside and inside.count("Exchange") < outside.count("Exchange")
    assert spark.conf.get(key) == before
    assert sorted((r.ticker, r.a) for r in join().collect()) == [(t, i) for t in ("t1", "t2") for i in (1, 2, 3, 4)]


def test_shuffles_start_with_partitions_by_input_rows(spark, tmp_path, monkeypatch):
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(first, None)
    spark.range(1000).write.parquet(f"{tmp_path}/in/lineitem.parquet")
    (tmp_path / "none").mkdir()
    try:
        workspace(spark, f"{tmp_path}/in")
        assert spark.conf.get(first, None) == before  # small inputs keep the number of the session
        monkeypatch.setattr(session, "ROWS_PER_PARTITION", 10)
        workspace(spark, f"{tmp_path}/in")
        assert spark.conf.get(first) == "100"
        workspace(spark, f"{tmp_path}/none")  # no such table
        assert spark.conf.get(first) == "100"
    finally:
        spark.conf.unset(first) if before is None else spark.conf.set(first, before)
