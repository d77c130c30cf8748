"""Jobs against plain loops and hand-made cases: performance, mentions, ledger, verdicts, guards."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.params import Params
from tidemark.plans import flags, ledger, mentions, panel, portfolio, quality, strategies, style
from tidemark.sources import tables
from tidemark.sources.store import Refused, Store, remove

P = Params()
FOLDER = "/root/testdata/sf0.001"
day = lambda s: dt.date.fromisoformat(s)


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 5)


@pytest.mark.parametrize("seed", range(3))
def test_simulate_equals_loop(spark, seed):
    """Months without picks empty the book; picks without returns carry it."""
    rnd = random.Random(seed)
    names = [f"t{i}" for i in range(8)]
    picks, rets = {}, {}
    for i in range(24):
        picks[i] = rnd.sample(names, rnd.choice([0, 0, 3, 4]))
        for n in names:
            if rnd.random() < (0.0 if i % 5 == 3 else 0.8):
                rets[i, n] = rnd.gauss(0, 5)
    pk = spark.createDataFrame([("r", month(i), n) for i, v in picks.items() for n in v], "run string, asof date, ticker string")
    rt = spark.createDataFrame([(month(i), n, v) for (i, n), v in rets.items()], "asof date, ticker string, ret_m double")
    asofs = F.array(*[F.lit(month(i)) for i in range(24)])
    runs = spark.createDataFrame([("r",)], "run string")
    got = portfolio.simulate(pk, rt, asofs, runs, ["run"], 0.35).orderBy("asof").collect()
    held, eq = set(), 1.0
    for i, r in enumerate(got):
        raw = {n: rets[i, n] for n in picks[i] if (i, n) in rets}
        if not picks[i]:
            held, ret, turn = set(), 0.0, 0.0
        elif not raw:
            ret, turn = 0.0, 0.0
        else:
            new = set(raw)
            gross = sum(raw.values()) / len(raw)
            ret = gross - 0.35 * (len(new - held) + len(held - new)) / len(new)
            turn, held = len(new - held) / len(new), new
        eq *= 1 + ret / 100
        assert r.n == len(raw) and abs(r.ret - ret) < 1e-9 and abs(r.turnover - turn) < 1e-12 and abs(r.equity - eq) < 1e-9


def test_unit_nav_equals_loop(spark):
    rnd = random.Random(5)
    ret = [rnd.gauss(0, 4) for _ in range(24)]
    b = spark.createDataFrame([(month(i), r) for i, r in enumerate(ret)], "asof date, eq double")
    nav, value = 1000.0, 0.0
    for i, (r, got) in enumerate(zip(ret, portfolio.unit_nav(b, 500.0, 20000.0).orderBy("asof").collect())):
        value = (value + 500.0 + (20000.0 if i == 0 else 0.0)) * (1 + r / 100)
        nav *= 1 + r / 100
        assert abs(got.nav - nav) < 1e-8 and abs(got.value - value) < 1e-6


def test_return_gap_and_delisting(spark):
    px = spark.createDataFrame([("a", day("2020-01-03"), 10.0), ("a", day("2020-05-01"), 20.0), ("b", day("2020-01-03"), 10.0), ("b", day("2020-05-03"), 20.0),
                                ("c", day("2020-01-03"), 10.0), ("c", day("2020-07-20"), 5.0), ("z", day("2020-11-01"), 1.0)], "ticker string, date date, close_adj double")
    asofs = F.array(F.lit(day("2020-01-05")), F.lit(day("2020-05-05")))
    got = {r.ticker: r.ret_m for r in portfolio.monthly_returns(px, asofs, P).collect()}
    assert got == {"a": 100.0}                     # 119 days pass, 121 do not
    assert {r.ticker for r in portfolio.delisted(px, P).collect()} == {"a", "b"}


@pytest.mark.parametrize("score, gate, held, defer, want", [
    (78.0, True, False, False, "buy"), (77.9, True, True, False, "hold"), (77.9, True, False, False, "watch"), (62.0, True, True, False, "hold"),
    (61.9, True, True, False, "trim"), (61.9, True, True, True, "defer"), (52.0, True, False, False, "watch"), (51.9, True, True, False, "sell"),
    (51.9, True, False, False, "out"), (90.0, False, True, False, "sell"), (90.0, False, True, True, "defer"), (90.0, False, False, False, "out"),
    (None, True, True, False, "na")])
def test_verdict(spark, score, gate, held, defer, want):
    d = spark.createDataFrame([(score, gate, held, defer)], "score double, gate_pass boolean, held boolean, defer boolean")
    assert d.select(style.verdict(P)).first()[0] == want


@pytest.mark.parametrize("vals, want", [([5.0, -1.0, -2.0], 2), ([-1.0, None, -2.0], 1), ([-1.0, -1.0, -1.0], 3), ([-1.0, 0.0], 0), ([1.0], 0)])
def test_loss_streak(spark, vals, want):
    d = spark.createDataFrame([("a", 2000 + i, v) for i, v in enumerate(vals)], "ticker string, year int, operating_income_ttm double")
    assert flags.loss_streak(d).first().loss_streak == want


@pytest.mark.parametrize("industry, debt, name, fin, track, reason", [
    ("64992", 1200.0, "KB금융", 0.0, "T2", "holding_debt"), ("64992", 149.0, "SK", 0.0, "T4", "holding"), ("64992", None, "하나금융지주", 0.0, "T2", "holding_name"),
    ("651", 80.0, "보험", 0.0, "T2", "finance"), ("21101", 50.0, "제약", 0.0, "T3", "pharma"), ("51100", 1370.0, "항공", 0.0, "T1", "no_finance_assets"),
    ("62010", 1007.0, "기술", 0.5, "T2", "debt_override"), ("", 10.0, "무", 0.0, "T1", "no_code"), ("301", 189.0, "차", 0.4, "T1", "industry")])
def test_tracks(spark, industry, debt, name, fin, track, reason):
    firms = spark.createDataFrame([("a", name, industry)], "ticker string, corp_name string, induty_code string")
    annual = spark.createDataFrame([("a", 100.0, None if debt is None else debt, 100.0)], "ticker string, assets double, liabilities double, equity double")
    assets = spark.createDataFrame([("a", fin * 100.0)], "ticker string, finance_assets double")
    r = strategies.assign_tracks(firms, annual, assets, P).first()
    assert (r.track, r.track_reason) == (track, reason)
    assert r.stability_distorted == (track == "T1" and fin >= 0.1 and debt > 150)


ITEM_CASES = [
    # title, description, expected (broker, target, previous, direction)
    ("KB증권, 삼성전자 목표주가 9만원으로 상향", "", [("KB증권", 90000.0, None, "상향")]),
    ("삼성전자 전망", "대신증권은 삼성전자 목표주가를 12만5000원에서 13만5천원으로 올렸다.", [("대신증권", 135000.0, 125000.0, "상향")]),
    ("이번주 7종목 추천", "KB증권 삼성전자 목표주가 9만원", []),
    ("SK하이닉스 강세", "KB증권 삼성전자 목표주가 9만원 유지", []),
    ("삼성전자 주목", "SK하이닉스와 삼성전자 목표주가 9만원 KB증권 유지", []),
    ("삼성전자우 주목", "KB증권 삼성전자우 목표주가 7만원", []),
    ("하나證 \"삼성전자 목표가 1,230,000원 신규 제시\"", "", [("하나증권", 1230000.0, None, "신규")]),
    ("삼전 KB증권 목표주가 9만원 하향", "KB증권은 삼전 목표가 8만원을 말했다.", [("KB증권", 90000.0, None, "하향")]),
    ("삼성전자 목표주가 9만원", "증권가 전망", []),
    ("삼성전자 &amp; <b>KB증권</b> 목표주가 900원", "", []),
    ("키움증권, 삼성전자 목표주가 9만원…NH투자증권, 삼성전자 목표가 10만원", "", [("키움증권", 90000.0, None, None), ("NH투자증권", 100000.0, None, None)]),
]


@pytest.mark.parametrize("title, desc, want", ITEM_CASES)
def test_mention_rules(spark, title, desc, want):
    firms = spark.createDataFrame([("005930", "삼성전자"), ("000660", "SK하이닉스")], "ticker string, name string")
    art = spark.createDataFrame([(1, "005930", title, desc, "Mon, 07 Sep 2026 09:30:00 +0900", "u")], "article_id long, ticker string, title string, description string, pubDate string, link string")
    rows = mentions.extract(art, mentions.name_dictionary(firms, firms.select("name")), mentions.name_table(firms)).collect()
    assert sorted(((r.broker, r.target, r.prev_target, r.direction) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.pub == dt.datetime(2026, 9, 7, 0, 30) for r in rows)


@pytest.mark.parametrize("text", ["Mon, 01 Jul 2024 09:00:00 +0900", "01 Jul 2024 09:00:00 +0900", "Monday, 1 Jul 2024 00:00:00 GMT", "1 Jul 2024 00:00:00 UTC"])
def test_date_forms(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(mentions.published(F.col("x")).cast("string").alias("t")).first()["t"]
    assert got == "2024-07-01 00:00:00"


def test_clean_decodes_numeric_entities_and_tags_inside_words(spark):
    got = spark.createDataFrame([("<b>목표</b>주가 &#8217;&#x41;&#65; &#99999999;",)], "x string").select(mentions.clean(F.col("x")).alias("t")).first()["t"]
    assert got == "목표주가 \u2019AA \ufffd"  # a number outside Unicode, as html.unescape has it


def test_unescape_equals_the_standard_library(spark):
    import html
    import random
    rng = random.Random(5)
    bits = ["&", "#", "x", "amp", "lt;", "amp;", "hellip;", "middot;", "lsquo;", "notin;", "not", "it;", "38;", "8217;", "x2019;", "0", "128;", "xD800;", "1114112;",
            "99999999999999999999;", ";", " ", "a", "가", "&#xFFFE;", "&#11;", "&#12;", "&nbsp;", "\n", "&ampfoo", "&copy2", "&amp;lt;", "\\", "$1"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3_000)] + ["&" + k for k in html.entities.html5]
    texts += [f"&#{i};" for i in range(300)] + [f"&#x{i:x}" for i in range(0xFDC0, 0x10010)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mentions.unescape(F.col("t")).alias("u")).collect()
    assert [r for r in rows if r["u"] != html.unescape(r["t"])] == []


def test_broker_short_forms():
    a = mentions.broker_aliases()
    assert a["하나證"] == "하나증권" and a["NH투자"] == "NH투자증권" and a["NH證"] == "NH투자증권" and a["신한투자證"] == "신한투자증권" and a["한투"] == "한국투자증권"
    assert a["맥쿼리"] == "맥쿼리" and "맥쿼證" not in a


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
def test_rows_without_a_later_price_are_scored(spark):
    from tidemark.workspace import workspace
    w = workspace(spark, FOLDER)
    assert w.scored.count() == 2 * w.panel.count()
    assert w.scored.where("fwd_63 IS NULL AND score IS NOT NULL").count() > 0


def test_affiliate_is_not_an_analyst(spark):
    firms = spark.createDataFrame([("105560", "KB금융")], "ticker string, name string")
    art = spark.createDataFrame([(1, "105560", "KB증권 모회사 KB금융 목표주가 24만원", "", "Mon, 07 Sep 2026 09:30:00 +0900", "u")], "article_id long, ticker string, title string, description string, pubDate string, link string")
    assert mentions.extract(art, mentions.name_dictionary(firms, firms.select("name")), mentions.name_table(firms)).count() == 0


def test_ledger_is_idempotent_within_a_month(spark):
    px = spark.createDataFrame([("a", day("2026-09-04"), 10.0), ("a", day("2026-10-02"), 12.0), *(("b", day(f"2026-09-{d}"), 1.0) for d in ("11", "18"))], "ticker string, date date, close_adj double")
    pick = spark.createDataFrame([("growth_mix", 1, "a", "A", 80.0)], "rule string, rank int, ticker string, name string, score double")
    empty = spark.createDataFrame([], ledger.LEDGER_SCHEMA)
    on = lambda s: F.lit(day(s))
    once = ledger.record(empty, pick, px, on("2026-09-05"), P)
    twice = ledger.record(once, pick, px, on("2026-09-12"), P)
    assert [str(r["asof"]) for r in twice.collect()] == ["2026-09-12"]
    early = ledger.settle(twice, px, on("2026-09-20"), P).first()
    assert early.ret_pct is None
    done = ledger.settle(twice, px, on("2026-10-05"), P)
    assert done.first().ret_pct == 20.0 and str(done.first().exit_asof) == "2026-10-05"
    again = ledger.record(done, pick, px, on("2026-09-14"), P)
    assert again.where("ret_pct = 20").count() == 1    # settled rows never change


@pytest.mark.parametrize("seed", range(4))
def test_book_of_all_runs_equals_one_run_after_the_other(spark, seed):
    rnd = random.Random(seed)
    start = day("2026-01-05")
    on = lambda d: start + dt.timedelta(days=d)
    runs = sorted({rnd.randrange(0, 300) for _ in range(9)} | {20, 23, 60, 61})
    closed = range(rnd.randrange(100, 200), 220)  # no prices at all: runs in there are stale
    prices = [(t, on(d), rnd.choice([None, 10.0, 11.0, 12.5])) for t in "abcd" for d in range(-5, 300, rnd.choice([2, 3])) if d not in closed and not (t == "d" and d < 150)]
    picks = [(on(r), rule, i + 1, t, t.upper(), 50.0 + i) for r in runs for rule in ("growth_mix", "pbr_only") for i, t in enumerate(rnd.sample("abcde", 3))]
    px = spark.createDataFrame(prices, "ticker string, date date, close_adj double")
    sel = spark.createDataFrame(picks, "asof date, rule string, rank int, ticker string, name string, score double")
    runs_at = ledger.run_dates(spark.createDataFrame([(on(r),) for r in runs], "asof date"), px, P)
    got = sorted(map(str, ledger.book(sel, px, runs_at, P).collect()))
    close, led, stale = {}, [], set()
    for r in runs:
        known = [x for x in prices if x[1] <= on(r)]
        if not known or (on(r) - max(x[1] for x in known)).days > P.max_price_lag_days:
            stale.add(on(r))
            continue
        close = {t: x for t, _, x in sorted(known, key=lambda x: x[1]) if x is not None}
        for row in led:  # settle, then record
            if row[9] is None and (on(r) - row[0]).days >= P.min_hold_days:
                row[7], row[8] = on(r), close.get(row[3])
                if row[6] is not None and row[8] is not None:
                    row[9] = round((row[8] / row[6] - 1) * 100, 2)
        led = [x for x in led if x[9] is not None or abs((on(r) - x[0]).days) >= P.min_hold_days]
        led += [[*x, close.get(x[3]), None, None, None] for x in picks if x[0] == on(r)]
    assert {r["asof"] for r in runs_at.where("not fresh").collect()} == stale
    names = ledger.book(sel, px, runs_at, P).columns
    want = sorted(str(Row(*names)(*x)) for x in led)
    assert got == want


def test_stale_prices_record_nothing(spark):
    px = spark.createDataFrame([("a", day("2026-09-04"), 10.0)], "ticker string, date date, close_adj double")
    pick = spark.createDataFrame([("growth_mix", 1, "a", "A", 80.0)], "rule string, rank int, ticker string, name string, score double")
    empty = spark.createDataFrame([], ledger.LEDGER_SCHEMA)
    for step in (lambda: ledger.record(empty, pick, px, F.lit(day("2026-09-12")), P), lambda: ledger.settle(empty, px, F.lit(day("2026-10-12")), P)):
        with pytest.raises(ledger.StalePrices):
            step()


def test_freshness_guard(spark):
    px = spark.createDataFrame([("a", day("2026-09-04"), 10.0)], "ticker string, date date, close_adj double")
    assert ledger.check_fresh(px, "2026-09-11", P) == 7
    with pytest.raises(ledger.StalePrices):
        ledger.check_fresh(px, "2026-09-12", P)
    with pytest.raises(ledger.StalePrices):
        ledger.check_fresh(px.where("false"), "2026-09-12", P)


def test_publish_guard(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *t: spark.createDataFrame([(x, i) for i, x in enumerate(t)], "ticker string, n int")
    with pytest.raises(LookupError):
        store.published("x")
    with pytest.raises(Refused):
        store.publish(rows("a"), "x", ["ticker"], complete=False)
    first = store.publish(rows("a", "b", "b"), "x", ["ticker"])
    with pytest.raises(Refused):
        store.publish(rows("a"), "x", ["ticker"])
    with pytest.raises(Refused):
        store.publish(rows("a", "b", None), "x", ["ticker"])
    assert store.current("x").version == first and store.published("x").count() == 3
    for more in ("c", "d", "e"):
        store.publish(rows("a", "b", more), "x", ["ticker"])
    assert {r.ticker for r in store.published("x").collect()} == {"a", "b", "e"}
    assert len([f for f in os.listdir(tmp_path / "x") if f.startswith("v-")]) == 2  # refused and old versions are gone


def test_a_failed_publish_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.publish(spark.createDataFrame([("a", 1)], "ticker string, n int"), "x", ["ticker"])
    broken = spark.createDataFrame([("a", 1), ("b", 0)], "ticker string, n int").withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        store.publish(broken, "x", ["ticker"])  # fails while writing
    monkeypatch.setattr(store, "current", lambda name: (_ for _ in ()).throw(RuntimeError("driver died")))
    with pytest.raises(RuntimeError):
        store.publish(spark.createDataFrame([("c", 1)], "ticker string, n int"), "x", ["ticker"])
    monkeypatch.undo()
    assert [tuple(r) for r in store.published("x").collect()] == [("a", 1)]


def test_a_month_is_replaced_alone_and_read_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame([(month(m), v) for m, v in r], "asof date, v int")
    store.put(rows((0, 1), (1, 2), (2, 3)), "m")
    store.put(rows((1, 20), (1, 21)), "m")
    assert sorted((str(r["asof"]), r.v) for r in store.dated("m").collect()) == [("2020-01-05", 1), ("2020-02-05", 20), ("2020-02-05", 21), ("2020-03-05", 3)]
    one = store.dated("m").where(F.col("asof") == month(1))
    assert len(one.inputFiles()) >= 1 and one.count() == 2
    plan = one._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert "PartitionFilters: [isnotnull(asof" in plan.toString() and scan.metrics().apply("numPartitions").value() in (0, 1)
    assert remove(spark, str(tmp_path / "m")) and not os.path.exists(tmp_path / "m")


def test_scratch_folder_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace
    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get("root", d)), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    with pytest.raises(ValueError):
        tables.scratch_folder(session("spark://x"))
    with pytest.raises(ValueError):
        tables.scratch_folder(session("local-cluster[2,1,1024]"))
    assert tables.scratch_folder(session("spark://x", root="hdfs://y/z/")).startswith("hdfs://y/z/tidemark-app-")


def test_report_csv(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("﻿# comment\nticker,증권사,날짜,목표주가\n5930,KB증권,2026-08-27,\"720,000원\"\n005930,하나증권,bad,\n", encoding="utf-8")
    rows = {r.broker: r for r in tables.read_reports(spark, str(f)).collect()}
    assert rows["KB증권"].ticker == "005930" and rows["KB증권"].target == 720000.0 and rows["KB증권"].date == day("2026-08-27")
    assert rows["하나증권"].date is None and rows["하나증권"].target is None and rows["하나증권"].url is None
    assert tables.read_reports(spark, str(tmp_path / "none.csv")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
def test_no_row_changes_when_the_future_is_removed(spark):
    from tidemark.workspace import workspace
    w = workspace(spark, FOLDER)
    cut = day("1999-06-05")
    dates = F.array(*[F.lit(day(x)) for x in ("1998-12-05", "1999-03-05", "1999-06-05")])
    full = panel.cohorts(w.ttm, w.prices, w.snapshots, w.tracks, w.p, dates=dates)
    seen = panel.cohorts(w.ttm.where(F.col("rcept_dt") <= cut), w.prices.where(F.col("date") <= cut),
                         w.snapshots.where(F.col("asof_date") <= cut), w.tracks, w.p, dates=dates)
    cols = [c for c in full.columns if not c.startswith("fwd_")]
    a, b = full.select(*cols), seen.select(*cols)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
def test_evidence_equals_loop(spark):
    from tidemark import catalog
    from tidemark.workspace import workspace
    w = workspace(spark, FOLDER)
    got = {}
    for r in catalog.QUERIES["evidence"](spark, FOLDER).orderBy("rank").collect():
        got.setdefault((r["asof"], r.ticker, r.side), []).append((r.kind, r.item))
    rows = w.scored.where("strategy = 'value'").collect()
    cat_of = {m: c for c, ms in spec.CATEGORIES.items() for m, _, _ in ms}
    for r in rows:
        facts = [(r[cat_of[m] + "_score"], ("fact", m)) for m in spec.FACT_METRICS
                 if m in cat_of and r[m] is not None and r[cat_of[m] + "_score"] is not None]
        cats = [(r[c + "_score"], ("category", c)) for c in spec.CATEGORY_NAMES if r[c + "_score"] is not None]
        best = [x for s, x in sorted(facts, key=lambda y: -y[0]) if s >= 70][:3]
        best += [x for s, x in sorted(cats, key=lambda y: -y[0])[:2] if s >= 70]
        best = best[:4] or [x for _, x in sorted(facts, key=lambda y: -y[0])[:3]]
        key = (r["asof"].isoformat(), r.ticker)
        assert got.get((*key, "pro"), []) == best
        cons = got.get((*key, "con"), [])
        risks = [x for x in cons if x[0] == "risk"]
        want = list(risks)
        for _, x in sorted(cats, key=lambda y: y[0]):
            if len(want) < max(3, len(best)):
                want.append(x)
        for _, x in sorted(facts, key=lambda y: y[0]):
            if len(want) < max(3, len(best)) and x not in best:
                want.append(x)
        assert cons == want[:max(3, min(len(best), 4))]
