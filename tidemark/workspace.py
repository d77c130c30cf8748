"""Lazy tables of one input folder; the expensive shared ones are written once and read back."""

from __future__ import annotations

from functools import cached_property
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import adapters
from tidemark.params import Params
from tidemark.plans import grading, ledger, panel, portfolio, statements, strategies, style, universe
from tidemark.session import by_part_of_key, partitions_for
from tidemark.sources.store import Store, remove
from tidemark.sources.tables import materialise, scratch_folder


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, p: Params = adapters.PARAMS):
        self.spark, self.folder, self.p = spark, folder.rstrip("/"), p
        self._serial = count()

    @cached_property
    def rows(self) -> int:
        """Rows of lineitem, the largest table; read from the footers. A folder without it holds texts or events only."""
        try:
            return self.spark.read.parquet(f"{self.folder}/lineitem.parquet").count()
        except AnalysisException:
            return 0

    @cached_property
    def scratch(self) -> str:
        return scratch_folder(self.spark)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Written once under a name of its own: a later run never replaces files still in use."""
        return materialise(df, self.scratch, f"{name}-{next(self._serial)}")

    @cached_property
    def store(self) -> Store:
        """Dated and published tables of this workspace."""
        return Store(self.spark, f"{self.scratch}/store")

    def close(self) -> None:
        """Deletes everything this workspace has written; frames that read it are of no use afterwards."""
        remove(self.spark, self.scratch)
        _OPEN.pop((self.spark.sparkContext.applicationId, self.folder), None)

    @cached_property
    def prices(self) -> DataFrame:
        return self.stored(adapters.prices(self.spark, self.folder), "prices")

    @cached_property
    def fin_quarterly(self) -> DataFrame:
        return self.stored(adapters.fin_quarterly(self.spark, self.folder), "fin_quarterly")

    @cached_property
    def raw_statements(self) -> DataFrame:
        """Statement lines as filed, an input that several jobs read."""
        return self.stored(adapters.raw_statements(self.fin_quarterly), "raw_statements")

    @cached_property
    def ttm(self) -> DataFrame:
        return self.stored(statements.ttm(self.fin_quarterly), "ttm")

    @cached_property
    def tracks(self) -> DataFrame:
        return adapters.tracks(self.spark, self.folder)

    @cached_property
    def market(self) -> DataFrame:
        return adapters.market(self.prices)

    @cached_property
    def snapshots(self) -> DataFrame:
        dates = adapters.rebalance_dates(self.prices)
        return self.stored(universe.snapshots(self.market, dates, self.p), "snapshots")

    @cached_property
    def shares(self) -> DataFrame:
        """Share counts net of treasury shares, from the last snapshot row of each ticker at the newest month date."""
        seen = self.snapshots.where(F.col("asof_date") <= self.newest)
        rest = [x for x in seen.columns if x != "ticker"]
        last = seen.groupBy("ticker").agg(F.max_by(F.struct(*rest), "asof_date").alias("_r")).select("ticker", "_r.*")
        corp = adapters.company_list(self.spark, self.folder).select("corp_code", "ticker")
        treasury = statements.treasury_shares(adapters.treasury_list(self.spark, self.folder)).join(corp, "corp_code")
        return statements.outstanding_shares(statements.total_shares(last), treasury)

    @cached_property
    def dates(self) -> Column:
        return panel.cohort_dates(self.prices)

    @cached_property
    def newest(self) -> Column:
        """The last month date: the day of the reports that describe one date."""
        return F.array_max(self.dates)

    @cached_property
    def news_asof(self) -> Column:
        """The day of the last mention."""
        return self.mentions.agg(F.date_trunc("day", F.max("pub")).alias("d")).scalar()

    def _cohorts(self, fixed_shares: DataFrame | None = None) -> DataFrame:
        d = panel.cohorts(self.ttm, self.prices, self.snapshots, self.tracks, self.p, fixed_shares=fixed_shares, dates=self.dates)
        keep = {*panel.cohort_columns()}
        return d.select(*[c for c in d.columns if c in keep])

    def stored_cohorts(self, name: str, fixed_shares: DataFrame | None = None) -> DataFrame:
        d = self._cohorts(fixed_shares)
        with by_part_of_key(self.spark):
            return self.stored(d, name)

    @cached_property
    def cohorts(self) -> DataFrame:
        return self.stored_cohorts("cohorts")

    @cached_property
    def graded(self) -> tuple[DataFrame, list[str]]:
        """Panel rows with gate features and the scores of all strategies, and the names of the panel columns among them.

        One plan grades and scores, so wide rows move and are written once for both tables.
        """
        d = self._with_strategies(self.cohorts)
        return self.stored(d, "scored"), [c for c in d.columns if c not in ("_s", *strategies.FEATURES)]

    def _with_strategies(self, cohorts: DataFrame) -> DataFrame:
        d = panel.with_strategies(grading.grade(cohorts, self.p), self.ttm, self.dates, self.p)
        keep = {*panel.scored_columns(), "_s"}
        return d.select(*[c for c in d.columns if c in keep])

    @cached_property
    def months(self) -> DataFrame:
        """The dates of the scored rows. Without a stored table they come from the plan that makes its rows, not stored before: no grade
        or score decides whether there is a row, so Spark leaves out what dates do not need."""
        rows = self.graded[0] if "graded" in self.__dict__ else self._with_strategies(self._cohorts())
        with by_part_of_key(self.spark):
            return self.stored(rows.select("asof").distinct(), "months")

    @cached_property
    def runs(self) -> DataFrame:
        """The run dates of the ledger; stored, as Spark would else look up the price days of a run on every row that joins it."""
        return self.stored(ledger.run_dates(self.months, self.prices, self.p), "runs")

    @cached_property
    def panel(self) -> DataFrame:
        rows, columns = self.graded
        return rows.select(*columns)

    @cached_property
    def fixed_panel(self) -> DataFrame:
        """Style scores of the panel with the newest share counts in every month, as style baskets over a short history use it."""
        shares = self.shares.select("ticker", F.col("shares_outstanding").alias("shares_out"))
        rows = grading.grade(self.stored_cohorts("fixed_cohorts", shares), self.p)
        return self.stored(rows.select("asof", "ticker", *style.STYLES.values()), "fixed_panel")

    @cached_property
    def scored(self) -> DataFrame:
        """Panel rows per strategy; stored once per panel row and repeated when read."""
        return panel.by_strategy(self.graded[0])

    @cached_property
    def gate_panel(self) -> DataFrame:
        """Scored rows with a forward return; not stored, as it costs one narrow scan more and each reader takes few columns."""
        return panel.gate_panel(self.scored)

    @cached_property
    def prepared(self) -> DataFrame:
        return self.stored(panel.prepare(self.gate_panel.select(*panel.research_columns()), self.p), "prepared")

    @cached_property
    def asofs(self) -> Column:
        """Sorted array of the months that have research rows, which are those of the prepared rows."""
        return self.gate_panel.agg(F.sort_array(F.collect_set("asof")).alias("d")).scalar()

    @cached_property
    def monthly_returns(self) -> DataFrame:
        return self.stored(portfolio.monthly_returns(self.prices, self.asofs, self.p), "monthly_returns")

    @cached_property
    def mentions(self) -> DataFrame:
        return adapters.mentions(self.spark, self.folder)


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of this session and folder, so queries share the stored tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    partitions_for(spark, _OPEN[key].rows)
    return _OPEN[key]
