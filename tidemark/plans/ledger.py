"""Monthly record and settlement of rule selections, and the revenue diffusion index.

`record` and `settle` are one run; `book` and `months` give the ledger and the closed months of all runs as one plan. The
ledger is a DataFrame in and a DataFrame out; settled rows never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import weighted
from tidemark.operators.asof import on_dates
from tidemark.operators.ranks import average_rank_pct, top_n
from tidemark.params import Params

# ---- fixed values: rules and the strategy whose gate they need ------------------------------
RULES = ["value_mix", "growth_mix", "growth_only", "profitability_only", "valuation_only", "pbr_only",
         "consensus_upside", "consensus_revision", "growth_and_revision"]
GATED = {"value_mix": "value", "growth_mix": "growth", "growth_and_revision": "growth"}

LEDGER_SCHEMA = ("asof date, rule string, rank int, ticker string, name string, score double, entry_price double, "
                 "exit_asof date, exit_price double, ret_pct double")


class StalePrices(RuntimeError):
    """Prices are too old for the date; nothing may be recorded or settled."""


def check_fresh(prices: DataFrame, asof: str | Column, p: Params) -> int:
    """Days between the last price and `asof`; refuses beyond the limit. Reads one value."""
    day = F.lit(asof).cast("date") if isinstance(asof, str) else asof
    row = prices.agg(F.datediff(day, F.max("date")).alias("lag")).first()
    if row is None or row["lag"] is None:
        raise StalePrices("no prices")
    if row["lag"] > p.max_price_lag_days:
        raise StalePrices(f"prices end {row['lag']} days before {asof}")
    return int(row["lag"])


def close_at(prices: DataFrame, asof: Column) -> DataFrame:
    return (prices.where(F.col("date") <= asof).groupBy("ticker")
            .agg(F.max_by("close_adj", F.when(F.col("close_adj").isNotNull(), F.col("date"))).alias("price")))


def rule_scores(d: DataFrame, p: Params) -> DataFrame:
    """Long (asof, ticker, name, rule, score) rows; gated rules keep only passing stocks.

    `d`: graded rows with <strategy>_pass flags and n_brokers, upside, revision.
    """
    # the rank spreads its missing values by all columns of a row: only those that the rules read are read and moved
    d = d.select("asof", "ticker", "name", *[f"{s}_pass" for s in dict.fromkeys(GATED.values())], *[f"{c}_score" for c in spec.CATEGORY_NAMES],
                 "n_brokers", "upside", "revision", F.when(F.col("pbr") > 0, F.col("pbr")).alias("_pbr"))
    d = average_rank_pct(d, ["asof"], "_pbr", "_pbr_pct")
    enough = F.col("n_brokers") >= p.min_brokers
    rev = F.when(enough, F.col("revision"))
    growth = weighted(spec.STRATEGY_WEIGHTS["growth"])
    value = {
        "value_mix": weighted(spec.STRATEGY_WEIGHTS["value"]), "growth_mix": growth,
        "growth_only": F.col("growth_score"), "profitability_only": F.col("profitability_score"),
        "valuation_only": F.col("valuation_score"), "pbr_only": 100.0 - F.col("_pbr_pct"),
        "consensus_upside": F.when(enough, F.col("upside")),
        "consensus_revision": rev + F.coalesce("n_brokers", F.lit(0)) / 1000.0,
        "growth_and_revision": F.when(rev > 0, growth),
    }
    gate = lambda r: F.coalesce(F.col(f"{GATED[r]}_pass"), F.lit(False)) if r in GATED else F.lit(True)
    arr = F.array(*[F.struct(F.lit(r).alias("rule"), F.round(F.when(gate(r), value[r]), 8).alias("score")) for r in RULES])
    return (d.select("asof", "ticker", "name", F.explode(arr).alias("r")).select("asof", "ticker", "name", "r.*")
             .where("score IS NOT NULL"))


def selections(scores: DataFrame, n: int) -> DataFrame:
    return top_n(scores, ["rule", "asof"], "score", n).withColumn("score", F.bround("score", 2))


def record(ledger: DataFrame, picks: DataFrame, prices: DataFrame, asof: Column, p: Params) -> DataFrame:
    """Ledger with this month's picks; unsettled rows close to the date are replaced. Stale prices record nothing."""
    check_fresh(prices.where(F.col("date") <= asof), asof, p)
    days = F.abs(F.datediff(asof, F.col("asof")))
    kept = ledger.where(~(F.col("ret_pct").isNull() & (days < p.min_hold_days)))
    add = (picks.join(close_at(prices, asof), "ticker", "left")
           .select(asof.alias("asof"), "rule", F.col("rank").cast("int").alias("rank"), "ticker", "name", "score",
                   F.col("price").alias("entry_price"), F.lit(None).cast("date").alias("exit_asof"),
                   F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("double").alias("ret_pct")))
    return kept.unionByName(add)


def settle(ledger: DataFrame, prices: DataFrame, asof: Column, p: Params) -> DataFrame:
    """Closes open rows held long enough; a row without an exit price stays open. Stale prices settle nothing."""
    check_fresh(prices.where(F.col("date") <= asof), asof, p)
    due = (F.col("ret_pct").isNull() & (F.col("asof") < asof) & (F.datediff(asof, F.col("asof")) >= p.min_hold_days))
    d = ledger.join(close_at(prices, asof), "ticker", "left").withColumn("_due", due)
    d = d.withColumn("exit_asof", F.when(F.col("_due"), asof).otherwise(F.col("exit_asof")))
    d = d.withColumn("exit_price", F.when(F.col("_due"), F.col("price")).otherwise(F.col("exit_price")))
    ret = F.bround((F.col("exit_price") / F.col("entry_price") - 1) * 100.0, 2)
    return (d.withColumn("ret_pct", F.when(F.col("_due"), ret).otherwise(F.col("ret_pct")))
             .select(*ledger.columns))


# ---- every month at once ---------------------------------------------------------------------
def run_dates(runs: DataFrame, prices: DataFrame, p: Params) -> DataFrame:
    """asof, price_date, lag, fresh, next_run, exit_run of every run date.

    A run whose prices are older than the limit is not fresh: it neither records nor settles. Run dates and price days are
    one row per day of the calendar, however large the tables are.
    """
    days = prices.select("date").distinct().agg(F.sort_array(F.collect_set("date")).alias("d")).scalar()
    last = lambda cal, t: F.array_max(F.filter(cal, lambda d: d <= F.col(t)))
    first = lambda cal, t: F.get(F.filter(cal, lambda d: d >= F.col(t)), F.lit(0))
    d = runs.select("asof").distinct().withColumn("_days", days).withColumn("price_date", last(F.col("_days"), "asof")).drop("_days")
    d = d.withColumn("lag", F.datediff("asof", "price_date")).withColumn("fresh", F.coalesce(F.col("lag") <= p.max_price_lag_days, F.lit(False)))
    good = d.where("fresh").agg(F.sort_array(F.collect_set("asof")).alias("r")).scalar()
    d = d.withColumns({"_runs": good, "_after": F.date_add("asof", 1), "_due": F.date_add("asof", p.min_hold_days)})
    return d.select("asof", "price_date", "lag", "fresh", first(F.col("_runs"), "_after").alias("next_run"), first(F.col("_runs"), "_due").alias("exit_run"),
                    F.array_max("_runs").alias("last_run"))


def closes_on_runs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """(ticker, asof, price): last known close of every ticker at every run date."""
    cal = runs.agg(F.sort_array(F.collect_set("asof")).alias("r")).scalar()
    px = prices.where("close_adj IS NOT NULL").select("ticker", "date", "close_adj")
    return on_dates(px, "ticker", "date", cal).select("ticker", "asof", F.col("close_adj").alias("price"))


def book(picks: DataFrame, prices: DataFrame, runs: DataFrame, p: Params) -> DataFrame:
    """The ledger after settling and recording at every run date in turn, as one plan.

    `runs` is `run_dates`. A batch of picks is replaced if the next fresh run follows within the holding time, since nothing
    of it can have settled by then; all other batches stay. The last close never vanishes once it is known, so a row with an
    entry price settles at the first run after its holding time, and one without never does: each run marks it again, and
    the last run's mark is what remains.
    """
    kept = F.col("next_run").isNull() | (F.datediff("next_run", "asof") >= p.min_hold_days)
    live = runs.where(F.col("fresh") & kept).select("asof", "exit_run", "last_run")
    px = closes_on_runs(runs, prices)
    d = picks.join(live, "asof").join(px.withColumnRenamed("price", "entry_price"), ["ticker", "asof"], "left")
    d = d.withColumn("exit_asof", F.when(F.col("exit_run").isNotNull(), F.when(F.col("entry_price").isNotNull(), F.col("exit_run")).otherwise(F.col("last_run"))))
    d = d.join(px.select("ticker", F.col("asof").alias("exit_asof"), F.col("price").alias("exit_price")), ["ticker", "exit_asof"], "left")
    ret = F.bround((F.col("exit_price") / F.col("entry_price") - 1) * 100.0, 2)
    return d.select("asof", "rule", F.col("rank").cast("int").alias("rank"), "ticker", "name", "score", "entry_price", "exit_asof", "exit_price", ret.alias("ret_pct"))


def months(ledger: DataFrame, prices: DataFrame, runs: DataFrame, snapshots: DataFrame, diffusion: DataFrame) -> DataFrame:
    """One row for every settled month: rule means, two benchmarks, diffusion, universe size.

    `snapshots`: (asof, ticker, market_cap) of the universe at each run date.
    """
    done = ledger.where("ret_pct IS NOT NULL")
    rules = done.groupBy("asof", "exit_asof").pivot("rule", RULES).agg(F.bround(F.avg("ret_pct"), 2))
    px = closes_on_runs(runs, prices)
    spans = done.select("asof", "exit_asof").distinct()
    r = (snapshots.select("asof", "ticker", "market_cap").join(spans, "asof")
         .join(px.withColumnRenamed("price", "_p0"), ["ticker", "asof"])
         .join(px.select("ticker", F.col("asof").alias("exit_asof"), F.col("price").alias("_p1")), ["ticker", "exit_asof"])
         .withColumn("_r", (F.col("_p1") / F.col("_p0") - 1) * 100.0).where("_r IS NOT NULL AND market_cap IS NOT NULL"))
    bench = r.groupBy("asof").agg(F.bround(F.avg("_r"), 2).alias("bench_eq"),
                                  F.bround(F.sum(F.col("_r") * F.col("market_cap")) / F.sum("market_cap"), 2).alias("bench_cap"),
                                  F.count(F.lit(1)).alias("n_universe"))
    spread = diffusion.select("asof", F.bround(F.col("diffusion") * 100.0, 1).alias("diffusion"))
    return (rules.join(bench, "asof").join(spread, "asof", "left").withColumn("days", F.datediff("exit_asof", "asof"))
            .select("asof", "exit_asof", "days", "bench_eq", "bench_cap", "diffusion", "n_universe", *RULES))


def close_month(ledger: DataFrame, entry: Column, exit_: Column, prices: DataFrame, snapshot: DataFrame,
                diffusion: DataFrame) -> DataFrame:
    """The row of one settled month; `snapshot` has no date of its own."""
    spark = ledger.sparkSession
    runs = spark.range(1).select(F.explode(F.array(entry, exit_)).alias("asof"))
    one = ledger.where(F.col("asof") == entry).withColumn("exit_asof", exit_)
    return months(one, prices, runs, snapshot.withColumn("asof", entry), diffusion)


def replace_month(monthly: DataFrame, row: DataFrame) -> DataFrame:
    """Month rows with those of `row` in place of earlier ones of the same date."""
    return monthly.join(row.select("asof").distinct(), "asof", "left_anti").unionByName(row)


def diffusion_index(feats: DataFrame, min_quarters: int = 3) -> DataFrame:
    """Share of companies with revenue growth in at least three of four quarters, per date."""
    yes = F.coalesce(F.col("rev_growth_q_of_4") >= min_quarters, F.lit(False)).cast("double")
    return feats.groupBy("asof").agg(F.avg(yes).alias("diffusion"), F.count(F.lit(1)).alias("n"))


def scoreboard(monthly: DataFrame) -> DataFrame:
    """Cumulative result per rule over its own months, against the equal-weight bench."""
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES if r in monthly.columns])
    d = monthly.select("asof", "bench_eq", F.explode(rows).alias("r")).select("asof", "bench_eq", "r.*").where("v IS NOT NULL")
    diff = F.col("v") - F.col("bench_eq")
    return d.groupBy("rule").agg(
        ((F.product(1 + F.col("v") / 100.0) - 1) * 100.0).alias("cumulative"), F.avg("v").alias("mean"),
        F.avg(diff).alias("vs_bench"), F.sum((diff > 0).cast("int")).alias("wins"), F.count(F.lit(1)).alias("months"),
        F.max("v").alias("best"), F.min("v").alias("worst"))

