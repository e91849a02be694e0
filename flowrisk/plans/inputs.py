"""Stages shared by the registered queries: the weekly pipeline over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.operators import graph as G
from flowrisk.operators import resolve as R
from flowrisk.operators import series as S
from flowrisk.operators import stress as X
from flowrisk.session import has_stage, stage
from flowrisk.sources import tables as T

# Parameters of the registered queries.
MIN_VOLUME = 10_000.0
FIT_END = "2001-01-01"
EVENT = ("2001-01-01", "2001-03-31")
CALM = ("2000-01-01", "2000-03-31")
PANEL_ROLL = X.HOURLY


class Inputs:
    """Relations of one dataset. Properties that several branches read are cached stages."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _stage(self, name: str, build) -> DataFrame:
        return stage(self.spark, (self.dir, name), build)

    def _once(self, name: str, build) -> DataFrame:
        """The stage if another query has written it, else the relation itself, for a single reader."""
        return self._stage(name, build) if has_stage(self.spark, (self.dir, name)) else build()

    # -------------------------------------------------------------- resolution
    def transfers(self) -> DataFrame:
        return T.transfers(self.spark, self.dir)

    def tokens(self) -> DataFrame:
        return T.tokens(self.spark)

    def seed(self) -> DataFrame:
        return T.seed(self.spark, self.dir)

    def seed_names(self) -> DataFrame:
        return self.seed().select("name").distinct()

    def book(self) -> DataFrame:
        return self._stage("book", lambda: R.address_book(self.seed(), T.address_labels(self.spark, self.dir)))

    def resolved(self, unit: str = "week") -> DataFrame:
        return self._stage(
            f"resolved-{unit}",
            lambda: R.resolved_flows(self.transfers(), self.tokens(), self.book(), unit, MIN_VOLUME),
        )

    def flows(self) -> DataFrame:
        return self._stage("flows", lambda: R.top_k_entities(self.resolved(), self.seed_names(), 12))

    def seed_flows(self) -> DataFrame:
        return self._stage("seed-flows", lambda: R.seed_only(self.resolved(), self.seed_names()))

    # -------------------------------------------------------------- graph, panel
    def documented(self) -> DataFrame:
        return T.documented_edges(self.spark)

    def edges(self, flows: DataFrame | None = None) -> DataFrame:
        if flows is not None:
            return G.build_graph(flows, G.median_edge_volume(flows), self.documented())
        return self._stage("edges", lambda: self.edges(self.flows()))

    def entities(self, flows: DataFrame | None = None) -> DataFrame:
        return X.flow_entities(self.flows() if flows is None else flows, self.seed_names().withColumnRenamed("name", "entity"))

    def panel(self) -> DataFrame:
        return self._stage("panel", lambda: X.flow_stress(self.flows(), self.entities(), PANEL_ROLL))

    # -------------------------------------------------------------- market
    def quotes(self) -> DataFrame:
        return S.last_quote(T.price_points(self.spark, self.dir), "hour")

    def prices(self, unit: str = "week") -> DataFrame:
        return T.priority_prices(self.spark, self.dir, unit)

    def returns(self) -> DataFrame:
        return self._stage("week-returns", lambda: S.log_returns(S.price_panel(self.prices())))

    def entity_assets(self) -> DataFrame:
        return T.entity_assets(self.spark, self.dir)

    def pegs(self) -> DataFrame:
        return T.peg_prices(self.spark, self.dir, "week")

    def tvl(self) -> DataFrame:
        return T.nation_tvl(self.spark, self.dir, "week")

    def types(self) -> DataFrame:
        return R.entity_types(self.flows(), T.seed_types(self.spark, self.dir))

    def before(self, df: DataFrame, col: str, cut: str = FIT_END) -> DataFrame:
        return df.where(F.col(col) < F.lit(cut).cast("timestamp_ntz"))
