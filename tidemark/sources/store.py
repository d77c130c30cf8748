"""Tables that outlive a run: partitioned by date, replaced partition by partition, or published behind a check.

A store is a folder that all executors share. Two kinds of tables live in it:

* dated tables: `put` writes the partitions that its rows hold and leaves all others as they are, so a month is replaced
  without reading the rest, and a reader of one month lists one partition;
* published tables: `publish` writes a new version beside the old one, checks it, and only then appends one row to the
  table's manifest. Readers follow the last row, so a run that fails anywhere before leaves the old version in place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq long, version string, rows long, keys long"


class Refused(RuntimeError):
    """A publish that would lose data."""


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever file system its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # ---- dated tables ----------------------------------------------------------------------------
    def put(self, df: DataFrame, name: str, by: str = "asof") -> None:
        """Writes the partitions of `df`; those of other dates stay. One file per date and task that holds rows of it."""
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(name)))

    def dated(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.path(name))

    # ---- published tables --------------------------------------------------------------------------
    def manifest(self, name: str) -> DataFrame:
        """Versions of a table, none if it was never published."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path(name)}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def current(self, name: str):
        """The last manifest row, or None."""
        return self.manifest(name).orderBy(F.col("seq").desc(), "version").first()

    def published(self, name: str) -> DataFrame:
        row = self.current(name)
        if row is None:
            raise LookupError(f"{name} has never been published")
        return self.spark.read.parquet(f"{self.path(name)}/{row.version}")

    def publish(self, df: DataFrame, name: str, keys: list[str], *, complete: bool = True, keep: int = 2) -> str:
        """Writes and checks a new version and switches readers to it. Refuses an incomplete run, missing keys, and fewer
        distinct keys than before; the refused version is deleted. Versions older than the last `keep` go."""
        if not complete:
            raise Refused("incomplete run")
        before = self.current(name)
        version = f"v-{uuid.uuid4().hex}"
        staged = f"{self.path(name)}/{version}"
        df.write.parquet(staged)
        # counted on what was written, not on a plan that could give other rows
        back = self.spark.read.parquet(staged)
        missing = F.sum(F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0, 1).otherwise(0))
        seen = back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), missing.alias("missing")).first()
        why = None
        if seen.missing:
            why = f"rows without {', '.join(keys)}"
        elif before is not None and seen["keys"] < before["keys"]:
            why = f"{', '.join(keys)} would fall from {before['keys']} to {seen['keys']}"
        if why:
            remove(self.spark, staged)
            raise Refused(why)
        row = [((before.seq if before else 0) + 1, version, seen["rows"] or 0, seen["keys"])]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path(name)}/manifest")
        for old in self.manifest(name).where(F.col("seq") <= row[0][0] - keep).collect():  # one row per version
            remove(self.spark, f"{self.path(name)}/{old.version}")
        return version
