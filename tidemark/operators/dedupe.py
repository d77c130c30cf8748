"""Keep-first / keep-last per key as aggregations.

`max_by` over a struct combines on the map side, so a key that holds a large share of all
rows never travels to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_extreme(df: DataFrame, keys: list[str], order: list[Column], *, last: bool) -> DataFrame:
    rest = [x for x in df.columns if x not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*[F.col(f"`{x}`") for x in rest]), F.struct(*order))
    out = df.groupBy(*keys).agg(row.alias("_row"))
    return out.select(*keys, *[F.col(f"_row.`{x}`").alias(x) for x in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return keep_extreme(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], last=True)


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return keep_extreme(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], last=False)


def union_by_priority(frames: list[DataFrame], keys: list[str], *order) -> DataFrame:
    """Union of stores in which a later store wins on the same key."""
    tagged = [f.withColumn("_store", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_last(both, keys, "_store", *order).drop("_store")
