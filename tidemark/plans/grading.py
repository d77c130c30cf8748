"""Peer-relative percentile scores and letter grades.

A peer group is dealt to one task and ranked there metric after metric, so adding a metric adds a sort, not a shuffle. Groups
too large for that are ranked in long format over value buckets: (date, track, peer, metric) is the rank group.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.exprs import letter_grade
from tidemark.operators.asof import previous_versions
from tidemark.operators.ranks import WHOLE_GROUP, row_ranks
from tidemark.params import Params

WHOLE_TRACK = "__TRACK__"


def track_categories(track: str | None) -> dict[str, list[tuple[str, float, int]]]:
    return {**spec.CATEGORIES, **spec.TRACK_CATEGORIES.get(track, {})}


def _sizes(d: DataFrame, p: Params, date: str) -> DataFrame:
    """One row per (date, track, sector): peer, and `_peers`, the members of the peer group at that date."""
    need = F.when(F.col("track") == spec.FINANCE, p.min_peers_finance).otherwise(p.min_peers)
    sizes = d.groupBy(date, "track", "sector").agg(F.count(F.lit(1)).alias("_members")).select(
        date, "track", "sector", "_members",
        F.when(F.col("_members") >= need, F.col("sector")).otherwise(WHOLE_TRACK).alias("peer"))
    return sizes.withColumn("_peers", F.sum("_members").over(W.partitionBy(date, "track", "peer"))).drop("_members")


def _peers(d: DataFrame, p: Params, date: str) -> DataFrame:
    """Adds peer and `_peers`, the members of the peer group at that date."""
    d = d.withColumn("sector", F.coalesce("sector", F.lit("00")))
    return d.join(F.broadcast(_sizes(d, p, date)), [date, "track", "sector"])


def with_peer(d: DataFrame, p: Params, date: str = "asof") -> DataFrame:
    """Sector when it has enough members at that date, else the whole track."""
    return _peers(d, p, date).drop("_peers")


def _metrics() -> list[str]:
    every = (m for t in (None, *spec.TRACK_CATEGORIES) for ms in track_categories(t).values() for m, _, _ in ms)
    return list(dict.fromkeys(every))


def _known_track() -> Column:
    return F.when(F.col("track").isin(*spec.TRACK_CATEGORIES), F.col("track")).otherwise(spec.GENERAL)


def _role() -> Column:
    """Struct (number of the category, weight, sign) of metric number `m` in the row's track; constant arrays."""
    names = _metrics()
    nothing = F.lit(None).cast("struct<cat:int,w:double,sign:int>")

    def table(track: str) -> Column:
        mine = {m: (c, w, s) for c, ms in track_categories(track).items() for m, w, s in ms}
        return F.array(*[F.struct(F.lit(spec.CATEGORY_NAMES.index(mine[m][0])).alias("cat"), F.lit(float(mine[m][1])).alias("w"),
                                  F.lit(mine[m][2]).alias("sign")) if m in mine else nothing for m in names])

    out = F.when(_known_track() == spec.GENERAL, F.get(table(spec.GENERAL), F.col("m")))
    for t in spec.TRACK_CATEGORIES:
        out = out.when(F.col("track") == t, F.get(table(t), F.col("m")))
    return out


def _users(m: str) -> list[str]:
    """Tracks in which a metric counts."""
    return [t for t in (spec.GENERAL, *spec.TRACK_CATEGORIES) if any(m == x for ms in track_categories(t).values() for x, _, _ in ms)]


def metric_rows(d: DataFrame, ids: list[str]) -> DataFrame:
    """Long rows (track, peer, m, value) of the metrics that count for the track of each row. NULL values drop out."""
    known = _known_track()
    entries = [F.struct(F.lit(i).alias("m"), F.when(known.isin(*_users(m)), F.col(m).cast("double")).alias("value"))
               for i, m in enumerate(_metrics()) if m in d.columns]
    return (d.select(*ids, "track", "peer", F.explode(F.array(*entries)).alias("e"))
             .select(*ids, "track", "peer", "e.*").where(F.col("value").isNotNull()))


def _sums_of_spread(d: DataFrame, p: Params, date: str, key: str) -> DataFrame:
    """date, key, _num, _den per category, for peer groups of any size: one row per metric, ranked over value buckets."""
    ranked = row_ranks(metric_rows(d, [date, key, "_peers"]), [date, "track", "peer", "m"], "value", "_peers").where(
        F.col("n_ranked") >= p.min_ranked)
    # a rank moves as a whole number, and the rows of a rank group lie together, so both shrink in the shuffle
    ranked = ranked.withColumn("_r", _role()).select(
        date, key, "_r.*", (F.col("n_below") * 2 + F.col("n_equal") + 1).alias("twice"), "n_ranked").repartition(date, key)
    pct = F.col("twice") / 2.0 / F.col("n_ranked") * 100.0
    ranked = ranked.withColumn("pct", F.when(F.col("sign") > 0, pct).otherwise(100.0 - pct))
    mine = lambda c, x: F.sum(F.when(F.col("cat") == spec.CATEGORY_NAMES.index(c), x))
    return ranked.groupBy(date, key).agg(*[
        x for c in spec.CATEGORY_NAMES for x in (mine(c, F.col("pct") * F.col("w")).alias(f"_num_{c}"), mine(c, F.col("w")).alias(f"_den_{c}"))])


def _sums_of_whole(d: DataFrame, p: Params, date: str, key: str) -> DataFrame:
    """The same for peer groups of at most `WHOLE_GROUP` rows: each is dealt to one task and sorted there once per metric, so a row
    moves once for all its metrics. `_group` numbers the peer groups."""
    names, known = [m for m in _metrics() if m in d.columns], _known_track()
    d = d.select(date, key, "track", "_group", *[
        F.when(known.isin(*_users(m)) & ~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in names])
    # the rank of a row in twice and the rows with a value, of one metric after the other; the percentile takes the place of the value
    for m in names:
        order = W.partitionBy("_group").orderBy(F.col(m).asc_nulls_last())
        n = F.count(m).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        upto = F.count(m).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
        d = d.withColumn(m, F.when(F.col(m).isNotNull() & (n >= p.min_ranked), (F.rank().over(order) + upto) / 2.0 / n * 100.0))
    sums = {}
    for c in spec.CATEGORY_NAMES:
        num, den = F.lit(None).cast("double"), F.lit(None).cast("double")
        for t in (spec.GENERAL, *spec.TRACK_CATEGORIES):
            parts = [(F.col(m) if sign > 0 else 100.0 - F.col(m), float(w)) for m, w, sign in track_categories(t)[c] if m in names]
            if not parts:
                continue
            some = F.coalesce(*[x for x, _ in parts]).isNotNull()
            total = lambda xs: reduce(add, [F.coalesce(x, F.lit(0.0)) for x in xs])
            here = (known == t) & some
            num = F.when(here, total([x * w for x, w in parts])).otherwise(num)
            den = F.when(here, total([F.when(x.isNotNull(), w) for x, w in parts])).otherwise(den)
        sums |= {f"_num_{c}": num, f"_den_{c}": den}
    return d.select(date, key, *[x.alias(n) for n, x in sums.items()])


def grade(d: DataFrame, p: Params, *, date: str = "asof", key: str = "ticker", whole: int = WHOLE_GROUP) -> DataFrame:
    """Adds sector, peer, <category>_score/_grade/_n, quality_score, coverage, scores_present."""
    d = d.withColumn("sector", F.coalesce("sector", F.lit("00")))
    # one row per (date, track, sector), so one task can number the groups
    sizes = _sizes(d, p, date)
    by = [date, "track", "sector"]
    small = sizes.where(F.col("_peers") <= whole).withColumn("_group", F.dense_rank().over(W.orderBy(date, "track", "peer"))).select(*by, "_group")
    large = sizes.where(F.col("_peers") > whole)
    sums = _sums_of_whole(d.join(F.broadcast(small), by), p, date, key).unionByName(
        _sums_of_spread(d.join(F.broadcast(large), by), p, date, key))
    at = lambda kind, c: F.sum(f"_{kind}_{c}")
    scores = sums.groupBy(date, key).agg(*[
        x for c in spec.CATEGORY_NAMES for x in (
            F.round(at("num", c) / at("den", c), 10).alias(f"{c}_score"),
            F.round(F.coalesce(at("den", c), F.lit(0.0)), 2).alias(f"{c}_n"))])
    out = d.join(F.broadcast(sizes.drop("_peers")), by).join(scores, [date, key], "left")
    out = out.withColumns({f"{c}_n": F.coalesce(f"{c}_n", F.lit(0.0)) for c in spec.CATEGORY_NAMES})
    out = out.withColumns({f"{c}_grade": letter_grade(f"{c}_score") for c in spec.CATEGORY_NAMES})
    prof, stab = F.col("profitability_score"), F.col("stability_score")
    return out.withColumns({
        "quality_score": F.round(F.coalesce((prof + stab) / 2.0, prof, stab), 10),
        "coverage": sum((F.col(f"{c}_n").isNotNull().cast("int") for c in spec.CATEGORY_NAMES), F.lit(0)),
        "scores_present": sum((F.col(f"{c}_score").isNotNull().cast("int")
                               for c in spec.CATEGORY_NAMES), F.lit(0)),
    })


def missing_sector(d: DataFrame, p: Params, *keys: str) -> DataFrame:
    """Share of rows without a sector, with a warning flag (one row per `keys`)."""
    miss = (F.coalesce(F.col("sector"), F.lit("00")) == "00").cast("double")
    return (d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(miss).alias("missing_share"))
             .withColumn("warn", F.col("missing_share") > p.missing_sector_warn))


def breadth(graded: DataFrame, p: Params, by: list[str], score: str = "quality_score") -> DataFrame:
    """Per date and group of `by`: share of members whose score fell by the drop threshold since the latest older date."""
    pairs = previous_versions(graded, "asof", "_before")
    a = graded.select("ticker", F.col("asof").alias("_before"), F.col(score).alias("_prev"))
    b = graded.select("asof", "ticker", *by, F.col(score).alias("_now")).join(F.broadcast(pairs), "asof")  # one row per date
    both = b.join(a, ["ticker", "_before"]).where(F.col("_prev").isNotNull() & F.col("_now").isNotNull())
    worse = (F.col("_now") - F.col("_prev") <= -p.breadth_drop).cast("double")
    return both.groupBy("asof", *by).agg(F.avg(worse).alias("worse_share"), F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Rows per value of a column, missing values as a row of their own, most frequent first in `rank`."""
    g = df.groupBy(*(keys or []), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return g.withColumn("rank", F.row_number().over(part))
