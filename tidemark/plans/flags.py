"""Loss history, cash runway and restructure flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.params import Params


def loss_streak(annual: DataFrame, col: str = "operating_income_ttm") -> DataFrame:
    """Trailing run of negative annual values per ticker; a NULL or a gain ends it."""
    stop = F.max(F.when(F.col(col).isNull() | (F.col(col) >= 0), F.col("year")))
    last = annual.groupBy("ticker").agg(stop.alias("_stop"),
                                        F.collect_set("year").alias("_years"))
    # one entry per fiscal year of a ticker
    return last.select("ticker", F.size(F.filter(
        "_years", lambda y: F.col("_stop").isNull() | (y > F.col("_stop")))).alias("loss_streak"))


def loss_flag(p: Params, streak="loss_streak", track="track", debt="debt_ratio", ocf="ocf_ttm") -> Column:
    s = F.col(streak)
    critical = (F.col(debt) > p.critical_debt_ratio) & (F.col(ocf) < 0)
    return (F.when((F.col(track) == spec.PHARMA) | (s == 0), None)
             .when(critical, "CRITICAL").when(s >= p.loss_fail, "STRUCT_FAIL")
             .when(s >= p.loss_doubt, "STRUCT_DOUBT").otherwise("TEMP_LOSS"))


def cash_runway(cash, burn) -> Column:
    return F.when(burn > 0, cash / burn)


def runway_grade(quarters: Column, p: Params) -> Column:
    return F.when(quarters < p.runway_danger, "D").when(quarters < p.runway_warn, "C")


def _relative(now: Column, before: Column) -> Column:
    """Change over |before|; from zero it is unbounded in the direction of the move."""
    inf = F.lit(float("inf"))
    return (F.when(before != 0, (now - before) / F.abs(before))
             .when(now > before, inf).when(now < before, -inf))


def restructure_events(t: DataFrame, p: Params, part: list[str] | None = None) -> DataFrame:
    """Periods in or after a spin-off or merger: equity and assets jump together.

    A rise counts only when profit does not explain it. Each hit is carried to the following
    periods, where trailing sums still mix two companies.
    """
    part = part or ["ticker"]
    w = W.partitionBy(*part).orderBy("period")
    eq, prev = F.col("equity"), F.lag("equity").over(w)
    assets, prev_a = F.col("assets"), F.lag("assets").over(w)
    d = t.select(*part, "period",
                 (eq - prev).alias("_delta"),
                 _relative(eq, prev).alias("_change"), _relative(assets, prev_a).alias("_achange"),
                 F.abs(F.col("net_income_ttm")).alias("_ni"))
    together = (F.col("_achange") * F.col("_change") > 0) & (
        F.abs("_achange") > p.restructure_drop * 0.5)
    explained = F.coalesce(F.col("_delta") <= F.col("_ni") * p.restructure_explained, F.lit(False))
    hit = together & ((F.col("_change") < -p.restructure_drop)
                      | ((F.col("_change") > p.restructure_rise) & ~explained))
    return (d.where(hit)
            .select(*part, "period", "_change", "_achange",
                    F.explode(F.sequence(F.lit(0), F.lit(p.restructure_carry))).alias("carried"))
            .select(*part, (F.col("period") + F.col("carried")).alias("period"), "carried",
                    F.when(F.col("carried") == 0, F.col("_change")).alias("equity_change"),
                    F.when(F.col("carried") == 0, F.col("_achange")).alias("assets_change")))


def with_reliability(d: DataFrame, events: DataFrame, part: list[str] | None = None) -> DataFrame:
    keys = [*(part or ["ticker"]), "period"]
    hit = events.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return d.join(hit, keys, "left").withColumn("ttm_reliable", F.col("_hit").isNull()).drop("_hit")
