"""Panel steps whose cost must not grow with a frame's length, a calendar or columns that nobody reads."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.adapters import PARAMS
from tidemark.operators import asof
from tidemark.plans import grading, ledger, momentum, style, validate
from tidemark.workspace import Workspace


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def prices(spark, n: int = 300):
    rnd = random.Random(5)
    rows = [(t, i, None if rnd.random() < 0.05 else rnd.uniform(1, 9), None if rnd.random() < 0.05 else rnd.uniform(1, 99))
            for t in ("a", "b") for i in range(n)]
    d = spark.createDataFrame(rows, "ticker string, i int, close_adj double, volume double")
    return d.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).drop("i")


@pytest.fixture
def stored(spark, tmp_path):
    def write(df, name: str):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")
    return write


def test_frames_from_parts_equal_window_frames(spark):
    d = prices(spark)
    got = momentum.trailing(d, {"s": ("volume", 60, "sum"), "n": ("volume", 60, "count"), "hi": ("close_adj", 252, "max"), "q": ("close_adj", 14, "sum")})
    w = W.partitionBy("ticker").orderBy("date")
    over = lambda f, n: f.over(w.rowsBetween(1 - n, 0))
    got = got.withColumns({"s2": F.coalesce(over(F.sum("volume"), 60), F.lit(0.0)), "n2": over(F.count("volume"), 60), "hi2": over(F.max("close_adj"), 252),
                           "q2": F.coalesce(over(F.sum("close_adj"), 14), F.lit(0.0))})
    same = (F.abs(F.col("s") - F.col("s2")) < 1e-9) & (F.abs(F.col("q") - F.col("q2")) < 1e-9) & (F.col("n") == F.col("n2")) & F.col("hi").eqNullSafe(F.col("hi2"))
    assert got.count() == 600 and got.where(~same).count() == 0


def test_momentum_has_no_sliding_frames(spark):
    assert ", -251, currentrow" not in plan(momentum.features(prices(spark), turnover=True)).replace("$()", "")
    assert "-59, currentrow" not in plan(momentum.average_turnover(prices(spark))).replace("$()", "")


def test_ordered_rows_meet_the_calendar_alike(spark):
    d = prices(spark, 90).where("close_adj IS NOT NULL").where("dayofmonth(date) % 3 = 0")
    dates = spark.range(1).select(F.sequence(F.lit("2019-12-05").cast("date"), F.lit("2020-06-05").cast("date"), F.expr("interval 1 month"))).scalar()
    a, b = (f(d, "ticker", "date", dates) for f in (asof.on_dates, asof.ordered_on_dates))
    assert a.count() == 12 and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_groups_are_graded_whole_or_spread(spark):
    rnd = random.Random(3)
    names = grading._metrics()
    rows = [(str(i), rnd.choice((spec.GENERAL, *spec.TRACK_CATEGORIES)), rnd.choice(("01", "02", None)),
             *[rnd.choice((None, float("nan"), -0.0, 0.0, float(rnd.randint(-3, 3)))) for _ in names]) for i in range(200)]
    d = spark.createDataFrame(rows, "ticker string, track string, sector string, " + ", ".join(f"{m} double" for m in names))
    d = d.withColumn("asof", F.lit("2020-01-05").cast("date"))
    out = [grading.grade(d, PARAMS, whole=whole).drop(*names) for whole in (0, 30, 10**6)]
    rows = [sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in x.collect()), key=str) for x in out]
    assert len(rows[0]) == 200 and rows[0] == rows[1] == rows[2]
    # a row moves once to its group, not once per metric
    assert "_group" in plan(out[2]) and any(r[-1] for r in rows[0])


def test_pairs_move_without_their_values_as_keys(spark, stored):
    rnd = random.Random(9)
    rows = [("s", m, f"t{i}", float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for m in (1, 2) for i in range(40)]
    d = spark.createDataFrame(rows, "signal string, m int, ticker string, x double, y double").select(
        "signal", F.make_date(F.lit(2020), "m", F.lit(5)).alias("asof"), "ticker", "x", "y")
    out = validate.ic_by_month(stored(d, "rows"), PARAMS.with_(ic_min_pairs=5))
    moves = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan(out).splitlines() if "hashpartitioning" in x]
    assert moves and not any(k.strip().split("#")[0] in ("x", "y") for m in moves for k in m.split(","))

    def rank(v, vs):
        return sum(z < v for z in vs) + (sum(z == v for z in vs) + 1) / 2

    for r in out.collect():
        xs, ys = zip(*[(a[3], a[4]) for a in rows if a[1] == r.asof.month])
        p, q = [rank(v, xs) for v in xs], [rank(v, ys) for v in ys]
        mp, mq = sum(p) / 40, sum(q) / 40
        cov = sum((a - mp) * (b - mq) for a, b in zip(p, q))
        assert r.n == 40 and abs(r.ic - cov / (sum((a - mp) ** 2 for a in p) * sum((b - mq) ** 2 for b in q)) ** 0.5) < 1e-9


def test_run_dates_need_no_graded_table(spark, monkeypatch):
    w = Workspace(spark, "/nowhere")
    d = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "ticker string, m int").select("ticker", F.make_date(F.lit(2020), "m", F.lit(5)).alias("asof"))
    monkeypatch.setattr(w, "_cohorts", lambda: d)
    monkeypatch.setattr(w, "_with_strategies", lambda c: c.withColumn("_s", F.lit(1)))
    assert sorted(r.asof.month for r in w.months.collect()) == [1, 2] and "graded" not in w.__dict__
    w.__dict__["prices"] = prices(spark, 40)
    # rows that join the run dates would repeat their lookups of price days
    assert "lambda" not in plan(w.runs) and sorted((r.asof.month, r.lag) for r in w.runs.collect()) == [(1, 0), (2, 0)]
    w.close()


def test_rules_read_only_their_columns(spark, stored):
    names = ["value_pass", "growth_pass"]
    d = spark.range(9).select(F.lit("2020-01-05").cast("date").alias("asof"), F.col("id").cast("string").alias("ticker"), F.lit("n").alias("name"),
                              *[F.lit(True).alias(x) for x in names], *[F.col("id").cast("double").alias(f"{c}_score") for c in spec.CATEGORY_NAMES],
                              F.lit(5).alias("n_brokers"), F.lit(1.0).alias("upside"), F.lit(1.0).alias("revision"), F.col("id").cast("double").alias("pbr"), F.lit("z").alias("other"))
    out = ledger.rule_scores(stored(d, "rules"), PARAMS)
    assert "other" not in plan(out).split("== Physical Plan ==")[1]
    assert sorted((r.ticker, r.score) for r in out.where("rule = 'pbr_only'").collect())[:2] == [("1", 87.5), ("2", 75.0)]


def test_evidence_and_intervals_use_plain_arrays(spark):
    cols = [f"{c}_score" for c in spec.CATEGORY_NAMES]
    facts = list(dict.fromkeys([*spec.FACT_METRICS, "disparity_20", "rsi_14", "pos_52w"]))
    d = spark.createDataFrame(
        [("t", 80.0, 75.0, 20.0, 90.0, None)], "ticker string, " + ", ".join(f"{c} double" for c in cols))
    d = d.withColumn("asof", F.lit("2020-01-05").cast("date")).withColumns({m: F.lit(1.0) for m in facts}).withColumns(
        {"ttm_reliable": F.lit(False), "loss_streak": F.lit(0), "stability_distorted": F.lit(False), "weighted_present": F.lit(4),
         "revenue_decline_3y": F.lit(False), "ocf_quality_bad_2y": F.lit(False)})
    out = style.evidence(d, "value", PARAMS)
    assert not any(f"{x}(" in plan(out) for x in ("transform", "array_sort", "exists"))
    got = sorted((r.side, r["rank"], r.kind, r.item, r.score) for r in out.collect())
    cheap = [m for m in spec.FACT_METRICS if m in [x for x, _, _ in spec.CATEGORIES["valuation"]]][:3]
    assert [x[3:] for x in got if x[0] == "pro"] == [*[(m, 90.0) for m in cheap], ("valuation", 90.0)]
    assert [x[2] for x in got if x[0] == "con"] == ["risk", "risk", "category", "category"] and got[2][3:] == ("stability", 20.0)
    dates = spark.range(1).select(F.sequence(F.lit("2020-01-05").cast("date"), F.lit("2020-03-05").cast("date"), F.expr("interval 1 month"))).scalar()
    px = prices(spark, 90).withColumn("close_adj", F.datediff("date", F.lit("2019-12-31").cast("date")).cast("double"))
    r = style.interval_returns(px, dates)
    assert "filter(_cal" not in plan(r)
    assert sorted((x.ticker, x.asof.month, round(x.ret, 6)) for x in r.collect()) == [
        (t, m, round(b / a - 1, 6)) for t in ("a", "b") for m, a, b in ((1, 5, 36), (2, 36, 65))]
