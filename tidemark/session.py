"""Session settings every job of the library expects."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS_PER_PARTITION = 100_000  # rows of the largest input table for one shuffled partition

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast after a check of the real size: estimates miss rows added by explode
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # let small stages use all cores; large stages are cut by the advisory size as usual
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.files.openCostInBytes": "1MB",
    # hash joins without a sort where every shuffled partition turned out small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def partitions_for(spark: SparkSession, rows: int) -> None:
    """Shuffles of an input of `rows` rows start with at least so many partitions that a partition holds a bounded share of the
    rows, whatever number the session was given; adaptive execution joins small ones again. Never lowers the number."""
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    n = -(-rows // ROWS_PER_PARTITION)
    if n > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, str(n))


@contextmanager
def by_part_of_key(spark: SparkSession) -> Iterator[None]:
    """Within this block, plans that are run join sides that are already dealt by a part of the join key where they are.

    For sides that windows have dealt by ticker and that meet by (ticker, date): a ticker has one row per date, so its part
    stays small. Not for all jobs: sides dealt by month alone would meet in as many tasks as there are months.
    """
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
                # such a stage widens and repeats its rows without a shuffle in between: smaller parts keep its sorts in memory
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
