"""Kernels against pandas or a plain loop, including the path for groups of any size."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import two_sided_p
from tidemark.operators import asof, ranks
from tidemark.operators.dedupe import union_by_priority
from tidemark.params import Params
from tidemark.plans import consensus


def frame(seed, n=400):
    rnd = random.Random(seed)
    return pd.DataFrame({"g": [rnd.choice("abc") for _ in range(n)], "ticker": [f"{i:06d}" for i in range(n)],
                         "v": [rnd.choice([None, 0.0, -1.5, rnd.gauss(0, 100), rnd.gauss(0, 0.01), 7.0]) for _ in range(n)]})


def test_nan_is_missing_and_infinities_rank_at_the_ends(spark):
    vals = [float("nan"), float("inf"), -float("inf"), -3.0, 2.0, 2.0, None] + [0.5] * 40
    d = spark.createDataFrame([("a", f"{i:03d}", v) for i, v in enumerate(vals)], "g string, ticker string, v double")
    want = pd.Series(vals, dtype="float64").rank(pct=True) * 100
    for per_fold in (0.01, 1.0, 200.0):
        pos = ranks.value_positions(d, ["g"], "v", per_fold).toPandas().sort_values("v")
        assert pos["n_ranked"].unique().tolist() == [45]
        assert pos["n_below"].tolist() == [0, 1, 2, 42, 44]
    got = ranks.average_rank_pct(d, ["g"], "v", "pct").toPandas().sort_values("ticker")["pct"].reset_index(drop=True)
    pd.testing.assert_series_equal(got, want, check_names=False)


@pytest.mark.parametrize("per_fold", [200.0, 0.1])
def test_positions_equal_pandas(spark, per_fold, monkeypatch):
    monkeypatch.setattr(ranks.value_positions, "__defaults__", (per_fold,))
    p = frame(1)
    d = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in p.itertuples(index=False)], "g string, ticker string, v double")
    got = ranks.average_rank_pct(d, ["g"], "v", "pct").toPandas().set_index("ticker")["pct"]
    want = (p.groupby("g")["v"].rank(pct=True) * 100).set_axis(p["ticker"])
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    got = ranks.min_rank_desc(d, ["g"], "v", "r").toPandas().set_index("ticker")["r"].astype(float)
    want = p.groupby("g")["v"].rank(ascending=False, method="min").set_axis(p["ticker"])
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    q = ranks.exact_quantiles(d, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.9}).toPandas().set_index("g").sort_index()
    for name, prob in (("a", 0.01), ("b", 0.5), ("c", 0.9)):
        np.testing.assert_allclose(q[name], p.groupby("g")["v"].quantile(prob).sort_index())
    for desc in (False, True):
        pos = ranks.row_positions(d, ["g"], "v", "ticker", "pos", descending=desc).toPandas().set_index("ticker")["pos"]
        s = p.dropna().sort_values(["v", "ticker"], ascending=[not desc, True])
        want = (s.groupby("g").cumcount() + 1).set_axis(s["ticker"])
        pd.testing.assert_series_equal(pos.sort_index(), want.sort_index(), check_names=False, check_dtype=False)


@pytest.mark.parametrize("n", [1, 2, 5, 7, 11, 23, 40])
def test_quantile_bucket_equals_qcut(spark, n):
    d = spark.range(1, n + 1).withColumn("n", F.lit(n)).withColumn("q", ranks.quantile_bucket("id", "n", 5))
    got = [r.q for r in d.orderBy("id").collect()]
    want = list(pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5])) if n >= 5 else None
    assert want is None or got == want


def test_top_n_limits_before_the_shuffle(spark):
    d = spark.range(1000).select((F.col("id") % 7 >= 0).cast("string").alias("g"), F.col("id").cast("string").alias("ticker"), (F.col("id") % 7).cast("double").alias("s"))
    top = ranks.top_n(d, ["g"], "s", 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [r.ticker for r in top.orderBy("rank").collect()] == ["104", "111", "118"]


def test_later_store_wins(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0)], "ticker string, d int, v double")
    b = spark.createDataFrame([("x", 1, 9.0)], "ticker string, d int, v double")
    assert {(r.ticker, r.v) for r in union_by_priority([a, b], ["ticker", "d"]).collect()} == {("x", 9.0), ("y", 2.0)}


def test_backward_asof(spark):
    day = lambda s: dt.date.fromisoformat(s)
    left = spark.createDataFrame([("a", day("2020-01-05"), 1), ("a", day("2020-01-05"), 2), ("a", day("2019-01-01"), 3), ("b", day("2020-01-05"), 4)],
                                 "ticker string, d date, i int")
    right = spark.createDataFrame([("a", day("2020-01-05"), 5.0), ("a", day("2020-01-01"), 1.0), ("a", day("2020-02-01"), 9.0)], "ticker string, date date, v double")
    got = {r.i: r.v for r in asof.backward(left, right, "ticker", "d", "date", ["v"]).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: None, 4: None}


def test_latest_period_whatever_the_receipt_order(spark):
    day = lambda s: dt.date.fromisoformat(s)
    f = spark.createDataFrame([("a", 1, day("2020-01-10")), ("a", 2, day("2020-02-10")), ("a", 1_000, day("2020-02-10")), ("a", 3, day("2020-03-10"))],
                              "ticker string, period int, rcept_dt date")
    dates = F.array(*[F.lit(d).cast("date") for d in ("2020-01-05", "2020-02-05", "2020-03-05", "2020-04-05")])
    got = {str(r["asof"]): r.period for r in asof.latest_period_on_dates(f, ["ticker"], "period", "rcept_dt", dates).collect()}
    assert got == {"2020-02-05": 1, "2020-03-05": 1000, "2020-04-05": 1000}


def test_latest_received_prefers_first_on_tie(spark):
    day = dt.date(2020, 2, 10)
    f = spark.createDataFrame([("a", 1, dt.date(2020, 1, 1)), ("a", 2, day), ("a", 3, day)], "ticker string, period int, rcept_dt date")
    assert asof.latest_received(f, F.lit("2020-03-01").cast("date")).first().period == 2


def mention_frame(spark, days, broker="b", target=100.0):
    base = dt.datetime(2024, 1, 1, 12)
    rows = [(i, "t", broker, target, base + dt.timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "mention_id long, ticker string, broker string, target double, pub timestamp")


def test_anchor_moves_on_kept_rows_only(spark):
    got = consensus.dedupe(mention_frame(spark, [1, 10, 16, 30, 31]), Params()).orderBy("pub").collect()
    assert [r.mention_id for r in got] == [0, 2, 4] and [r.copies for r in got] == [2, 2, 1]


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_equals_loop(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice("xy"), rnd.choice("ab"), rnd.choice([100.0, 200.0]), base + dt.timedelta(seconds=rnd.randrange(86400 * 90))) for i in range(500)]
    d = spark.createDataFrame(rows, "mention_id long, ticker string, broker string, target double, pub timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys span batches
    try:
        got = {(r.mention_id, r.copies) for r in consensus.dedupe(d, Params()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, kept = {}, []
    for r in sorted(rows, key=lambda r: r[4]):
        k = r[1:4]
        if k in last and (r[4] - last[k]).days <= 14:
            continue
        last[k] = r[4]
        kept.append(r)
    want = {(r[0], sum(1 for o in rows if o[1:4] == r[1:4] and 0 <= (o[4] - r[4]).days <= 14 and o[4] >= r[4])) for r in kept}
    assert got == want


def test_dedupe_of_one_busy_key_equals_loop(spark):
    rnd = random.Random(9)
    base = dt.datetime(2023, 1, 1)
    seconds = sorted(rnd.sample(range(86400 * 200), 1_500)) + [86400 * 15 - 1, 86400 * 30 - 1, 86400 * 400, 86400 * 415, 86400 * 430 - 1, 86400 * 430]
    rows = [(i, "t", "a", 100.4, base + dt.timedelta(seconds=x)) for i, x in enumerate(sorted(seconds))]
    rows += [(10_000 + i, "t", "a", 100.0, rows[5][4]) for i in range(400)] + [(20_000, None, "a", 100.0, base), (20_001, "t", "b", None, base)]
    d = spark.createDataFrame(rows, "mention_id long, ticker string, broker string, target double, pub timestamp")
    got = {(r.mention_id, r.copies) for r in consensus.dedupe(d, Params()).where("ticker = 't' AND broker = 'a'").collect()}
    times, last, want = sorted((r[4], r[0]) for r in rows if r[1] == "t" and r[2] == "a"), None, {}
    for at, i in times:
        if last is None or (at - times[last][0]).days > 14:
            last = next(k for k, x in enumerate(times) if x == (at, i))
            want[i] = 0
            current = i
        want[current] += 1
    assert got == set(want.items())


@pytest.mark.parametrize("seed", range(4))
def test_updates_equal_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(consensus, "CHUNK", 3)
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    start = {k: rnd.choice([0.0, 50.0, 100.0, 150.0]) for k in "abcdefgh"}
    rows = [("t", b, base + dt.timedelta(hours=rnd.randrange(200)), i, rnd.choice([0.0] * (b in "ab") + [50.0, 80.0, 100.0, 120.0, 200.0]), rnd.choice([consensus.UP, consensus.DOWN]), start[b])
            for i in range(400) for b in [rnd.choice("abcdefgh" + "h" * 8)]]
    got = {r.broker: r.id for r in consensus.confirmed_updates(spark.createDataFrame(rows, "ticker string, broker string, pub timestamp, id long, target double, direction string, base double")).collect()}
    want = {}
    for b in start:
        current, choice = start[b], None
        for r in sorted((r for r in rows if r[1] == b), key=lambda r: (r[2], r[3])):
            change = r[4] / current - 1 if current else 0.0
            if change and (r[5] == consensus.UP) == (change > 0):
                current, choice = r[4], r[3]
        if choice is not None:
            want[b] = choice
    assert got == want


def test_representative_follows_agreeing_direction(spark):
    base = dt.datetime(2024, 1, 1)
    at = lambda d: base + dt.timedelta(days=d)
    rows = [(0, "t", "a", 100.0, "유지", at(1), 3), (1, "t", "a", 120.0, "상향", at(5), 1), (2, "t", "a", 130.0, "하향", at(6), 1), (3, "t", "a", 90.0, "하향", at(7), 1),
            (4, "t", "b", 50.0, None, at(1), 1), (5, "t", "b", 60.0, None, at(2), 1), (6, "t", "c", 10.0, "상향", at(3), 2), (7, "t", "c", 9.0, None, at(9), 1)]
    d = spark.createDataFrame(rows, "mention_id long, ticker string, broker string, target double, direction string, pub timestamp, copies long").withColumn("foreign", F.lit(False))
    got = {r.broker: r.mention_id for r in consensus.representatives(d, F.lit("2024-02-01").cast("timestamp"), Params()).collect()}
    assert got == {"a": 3, "b": 5, "c": 6}


@pytest.mark.parametrize("t, want", [(0.0, 1.0), (1.0, 0.31731050786), (-1.96, 0.04999579), (3.0, 0.0026997960)])
def test_two_sided_p(spark, t, want):
    assert abs(spark.range(1).select(two_sided_p(F.lit(t))).first()[0] - want) < 2e-7
