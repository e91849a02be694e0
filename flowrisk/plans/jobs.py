"""End-to-end jobs over a user's own relations; each result is a table.

``Evaluation`` builds the pipeline once (flows, graph, stress, fit, system) and offers every
analysis on it. ``evaluate``, ``validate``, ``robustness`` and ``events`` run the usual sets.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.tails import spearman
from flowrisk.functions.time import at, between
from flowrisk.operators import address as A
from flowrisk.operators import backtest as V
from flowrisk.operators import baselines as B
from flowrisk.operators import battery as Y
from flowrisk.operators import graph as G
from flowrisk.operators import resolve as R
from flowrisk.operators import scenarios as C
from flowrisk.operators import series as S
from flowrisk.operators import stress as X
from flowrisk.operators import structural as M
from flowrisk.session import write_table
from flowrisk.sources.sinks import save_result


@dataclass(frozen=True)
class Relations:
    """Inputs of a job. ``prices(ts, key, price)`` and ``tvl(ts, key, value)`` are bucketed like the flows."""

    transfers: DataFrame
    tokens: DataFrame
    seed: DataFrame
    labels: DataFrame
    prices: DataFrame
    entity_assets: DataFrame
    seed_types: DataFrame | None = None
    refs: DataFrame | None = None
    tvl: DataFrame | None = None
    documented: DataFrame | None = None
    market: str | None = None
    rates: DataFrame | None = None  # (bucket, sym, rate) in USD; tokens without a rate count one to one


@dataclass(frozen=True)
class Settings:
    """Parameters; the defaults are those of the hourly run."""

    fit_end: str
    event: tuple[str, str]
    calm: tuple[str, str] | None = None
    start: str | None = None
    end: str | None = None
    unit: str = "hour"
    min_volume: float = 1e3
    top_k: int = 12
    min_usd: float = 1e5
    roll: X.Roll = field(default=X.HOURLY)
    typed: bool = False  # type-specific stress instead of flow stress
    seeds_in_panel: bool = True
    peg: tuple[str, str] | None = None  # (asset, series) of an extra or averaged peg series
    alpha: float = 1.0
    q: float = 0.95
    tail: float = 0.05
    draws: int = 150
    seed: int = 7
    var_window: int = 72
    granger_alpha: float = 0.10
    pcorr: float = 0.2
    abduction: str = "observed"
    graph_cutoff: str | None = None  # build the graph from earlier flows only
    dense_calendar: bool = False  # fill empty buckets between observed ones


# Parameters of the daily run.
DAILY = dict(unit="day", min_volume=5e6, min_usd=1e6, roll=X.DAILY, typed=True, draws=300, var_window=100)


class Evaluation:
    """One pipeline: resolution, graph, stress, structural fit and the analyses on top."""

    def __init__(self, rel: Relations, s: Settings, flows: DataFrame | None = None, edges: DataFrame | None = None,
                 panel: DataFrame | None = None, resolved: DataFrame | None = None):
        """Relations that are given take the place of the derived ones."""
        self.rel, self.s = rel, s
        given = {"resolved": resolved, "flows": flows, "edges": edges, "panel": panel}
        self.__dict__.update({k: v for k, v in given.items() if v is not None})

    # ------------------------------------------------------------ pipeline
    @cached_property
    def seed_names(self) -> DataFrame:
        return self.rel.seed.select("name").distinct()

    @cached_property
    def resolved(self) -> DataFrame:
        s, rel = self.s, self.rel
        book = write_table(R.address_book(rel.seed, rel.labels), "book")
        return write_table(R.resolved_flows(rel.transfers, rel.tokens, book, s.unit, s.min_volume, s.start, s.end, rel.rates), "resolved")

    @cached_property
    def flows(self) -> DataFrame:
        return write_table(R.top_k_entities(self.resolved, self.seed_names, self.s.top_k), "flows")

    @cached_property
    def edges(self) -> DataFrame:
        flows = self.flows if self.s.graph_cutoff is None else self.flows.where(F.col("bucket") < at(self.s.graph_cutoff))
        return write_table(G.build_graph(flows, self.s.min_usd, self.rel.documented), "edges")

    @cached_property
    def panel(self) -> DataFrame:
        s, rel = self.s, self.rel
        if s.typed:
            types = R.entity_types(self.flows, rel.seed_types)
            out = X.typed_stress(self.flows, types, rel.refs, rel.prices, rel.tvl, rel.market, s.roll)
        else:
            extra = self.seed_names.withColumnRenamed("name", "entity") if s.seeds_in_panel else None
            out = X.flow_stress(self.flows, X.flow_entities(self.flows, extra), s.roll, s.unit if s.dense_calendar else None)
        if s.peg is not None:
            peg = X.peg_stress(X.calendar(self.flows), rel.prices, *s.peg, s.roll)
            known = out.select("key").distinct()
            out = X.with_peg(out, peg).unionByName(peg.join(F.broadcast(known), "key", "left_anti"))
        return write_table(out, "panel")

    @cached_property
    def returns(self) -> DataFrame:
        return write_table(S.log_returns(S.price_panel(self.rel.prices)), "returns")

    def _fit(self, models: DataFrame, names: list[str], panel: DataFrame, flows: DataFrame, flow_lag: int = 0,
             min_rows: int = 1) -> tuple[DataFrame, DataFrame]:
        rows = write_table(M.design(M.equations(models, panel, names), panel, flows, flow_lag), "design")
        return rows, M.fit(rows.where(F.col("ts") < at(self.s.fit_end)), self.s.alpha, min_rows=min_rows)

    @cached_property
    def model(self) -> tuple[DataFrame, DataFrame]:
        return self._fit(M.as_models(observed=self.edges), ["observed"], self.panel, self.flows)

    def _inside(self, df: DataFrame, window: tuple[str, str]) -> DataFrame:
        return df.where(between(F.col("ts"), *window, closed=True))

    def system(self, window: tuple[str, str] | None = None) -> DataFrame:
        rows, coef = self.model
        levels = C.entity_levels(self.panel, self.s.fit_end, self.s.event[0], self.s.q)
        return C.systems(self._inside(rows, window or self.s.event), coef, levels)

    @cached_property
    def event_system(self) -> DataFrame:
        return self.system()

    # ------------------------------------------------------------ analyses
    @cached_property
    def deltas(self) -> DataFrame:
        rows, coef = self.model
        pool = M.predict(rows.where(F.col("ts") < at(self.s.fit_end)), coef).select("model", "child", "pos", "u")
        steps = self.event_system.agg(F.max((F.size("drive") / F.size("init")).cast("int"))).scalar()
        shocks = C.residual_draws(pool, steps, self.s.draws, self.s.seed)
        return write_table(C.tail_losses(self.event_system, shocks, self.s.q), "deltas")

    def ranking(self) -> DataFrame:
        return C.exported_risk(self.deltas).select("entity", "exported_risk")

    def attribution(self, sources: list[str] | None = None, window: tuple[str, str] | None = None) -> DataFrame:
        window = window or self.s.event
        rows, coef = self.model
        paths, shocks = C.observed_window(M.predict(rows, coef), self.panel, *window, self.s.abduction, self.s.fit_end)
        system = self.event_system if window == self.s.event else self.system(window)
        return C.attribution(system, paths, shocks, sources).drop("model")

    def _event_scores(self, flow_lag: int = 0, min_rows: int = 1, **graphs: DataFrame) -> DataFrame:
        rows, coef = self._fit(M.as_models(**graphs), list(graphs), self.panel, self.flows, flow_lag, min_rows)
        return M.scores(M.predict(self._inside(rows, self.s.event), coef))

    def falsification(self, flow_lag: int = 0, min_rows: int = 1) -> DataFrame:
        e = self.edges
        return self._event_scores(flow_lag, min_rows, true_direction=e, reversed_edges=G.reverse(e), symmetric=G.symmetric(e))

    def edge_types(self) -> DataFrame:
        """Scores with the documented or the observed edges turned around."""
        e = self.edges
        doc = F.col("source") == G.DOCUMENTED
        out = self._event_scores(0, 5, true=e, reverse_documented=G.reverse_where(e, doc), reverse_observed=G.reverse_where(e, ~doc))
        count = lambda c: e.where(c).agg(F.count("*")).scalar()
        return out.withColumns({"n_documented": count(doc), "n_observed": count(~doc)})

    def graph_sources(self) -> DataFrame:
        return M.scores(self.graph_source_predictions)

    @cached_property
    def graph_source_predictions(self) -> DataFrame:
        """Event predictions of the observed and the estimated graphs over the entities that have an asset."""
        nodes = write_table(
            self.rel.entity_assets.join(self.panel.select(F.col("key").alias("entity")).distinct(), "entity", "left_semi"), "nodes"
        )
        r = write_table(G.mapped_returns(self.returns.where(F.col("ts") < at(self.s.fit_end)), nodes), "entity-returns")
        models = write_table(M.as_models(
            observed=G.induced(self.edges, nodes), granger=B.granger_graph(r, self.s.granger_alpha),
            partial_corr=B.partial_correlation_graph(r, self.s.pcorr),
        ), "graphs")
        keys = nodes.select(F.col("entity").alias("key"))
        panel = self.panel.join(F.broadcast(keys), "key", "left_semi")
        rows, coef = self._fit(models, ["observed", "granger", "partial_corr"], panel, G.induced(self.flows, nodes))
        return write_table(M.predict(self._inside(rows, self.s.event), coef).select("model", "child", "ts", "y", "yhat"), "predictions")

    def sensitivity(self) -> DataFrame:
        return M.edge_sensitivity(M.equations(M.as_models(observed=self.edges), self.panel, ["observed"]), self.panel).drop("model")

    def divergence(self) -> DataFrame:
        """Rank correlation of exported risk with the price-based measures."""
        risk = self.ranking().join(self.rel.entity_assets, "entity")
        base = B.delta_covar(self.returns, q=self.s.tail).select(
            "asset", F.lit("delta_covar").alias("baseline"), (-F.col("delta_covar")).alias("risk")
        ).unionByName(B.tail_mean(self.returns, self.s.tail).select("asset", F.lit("mes").alias("baseline"), (-F.col("mes")).alias("risk")))
        return spearman(risk.join(base, "asset"), "exported_risk", "risk", "baseline")

    def seed_only(self) -> Evaluation:
        """The same pipeline with everything but the seeds collapsed."""
        return Evaluation(self.rel, self.s, write_table(R.seed_only(self.flows, self.seed_names), "seed-flows"))

    def without_residual(self) -> Evaluation:
        """The same stress and graph with the residual entity left out."""
        panel = write_table(self.panel.where(F.col("key") != R.RESIDUAL), "named-panel")
        return Evaluation(self.rel, self.s, G.without_node(self.flows), G.without_node(self.edges), panel)

    def varied(self, edges: DataFrame | None = None, panel: DataFrame | None = None) -> Evaluation:
        """The same flows with another graph or another stress panel, refitted."""
        panel = self.panel if panel is None else write_table(panel, "panel")
        return Evaluation(self.rel, self.s, self.flows, self.edges if edges is None else write_table(edges, "edges"), panel)

    # ------------------------------------------------------------ robustness
    @cached_property
    def deterministic_ranking(self) -> DataFrame:
        return write_table(C.exported_risk(C.deterministic_deltas(self.event_system)), "deterministic")

    def _replay(self) -> tuple[DataFrame, DataFrame]:
        rows, coef = self.model
        return C.observed_window(M.predict(rows, coef), self.panel, *self.s.event, self.s.abduction, self.s.fit_end)

    def noisy_system(self, copies: int, sd: float, flows_too: bool) -> DataFrame:
        """The event system under ``copies`` draws of noise on the coefficients."""
        rows, coef = self.model
        noisy = C.perturbed(coef, copies, sd, self.s.seed, flows_too)
        levels = C.entity_levels(self.panel, self.s.fit_end, self.s.event[0], self.s.q)
        return C.systems(C.for_models(self._inside(rows, self.s.event), noisy.select("model").distinct()), noisy, levels)

    def shapley(self, target: str, players: list[str]) -> DataFrame:
        """Shares of the players in the loss of the target; 2^players scenarios."""
        return C.shapley(C.coalition_losses(self.event_system, *self._replay(), target, players), players).drop("model")

    def attribution_sensitivity(self, source: str, target: str, copies: int = 40, sd: float = 0.15) -> DataFrame:
        """One row: the share of ``source`` in the loss of ``target``, and its spread under noise on the coefficients."""
        paths, shocks = self._replay()
        noisy = self.noisy_system(copies, sd, False)
        share = lambda y, u: C.attribution(y, paths, u, [source]).where(F.col("target") == target)
        out = share(noisy, C.for_models(shocks, noisy)).agg(
            F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("sd"), F.avg((F.col("share") > 0).cast("double")).alias("frac_positive")
        )
        return out.select(share(self.event_system, shocks).select("share").scalar().alias("base_share"), "*")

    def ranking_stability(self, copies: int = 25, sd: float = 0.15) -> DataFrame:
        """One row: agreement of the deterministic ranking with those under noise on the coefficients."""
        noisy = C.exported_risk(C.deterministic_deltas(self.noisy_system(copies, sd, True)))
        return C.compare_rankings(self.deterministic_ranking, noisy).agg(
            F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.avg("top3_overlap").alias("mean_top3_overlap"), F.count("*").alias("n_copies")
        )

    def weak_edges_dropped(self) -> DataFrame:
        """Agreement of the ranking with that of the graph without its least robust quarter of edges."""
        weak = write_table(Y.weakest_edges(self.sensitivity()), "weak-edges")
        other = self.varied(edges=G.without_edges(self.edges, weak)).deterministic_ranking
        return C.compare_rankings(self.deterministic_ranking, other).drop("model").withColumn("n_dropped", weak.agg(F.count("*")).scalar())

    def latent_shock_robustness(self, strengths: tuple[float, ...] = (0.3, 0.6), seed: int = 11) -> DataFrame:
        """Per strength: agreement of the ranking with that under a common shock to all series."""
        shock = write_table(X.latent_shock(self.panel, seed), "latent-shock")
        parts = [
            C.compare_rankings(self.deterministic_ranking, self.varied(panel=X.inject(self.panel, shock, x)).deterministic_ranking)
            .select(F.lit(float(x)).alias("strength"), "rho", "n", "top3_overlap")
            for x in strengths
        ]
        return reduce(DataFrame.unionByName, parts)


def evaluate(e: Evaluation, sources: list[str] | None = None) -> dict[str, DataFrame]:
    """The evaluation run: graph, fit, rankings, attribution, falsification, backtests."""
    rows, coef = e.model
    out = {
        "graph": e.edges,
        "stress": e.panel,
        "coefficients": M.coefficient_table(coef).drop("model"),
        "residual_std": M.residual_std(M.predict(rows.where(F.col("ts") < at(e.s.fit_end)), coef)).drop("model"),
        "ranking": e.ranking(),
        "delta_covar": B.delta_covar(e.returns, q=e.s.tail),
        "mes": B.tail_mean(e.returns, e.s.tail),
        "divergence": e.divergence(),
        "attribution": e.attribution(sources),
        "falsification": e.falsification(),
        "backtests": V.backtest_var(e.returns, e.s.var_window, e.s.tail),
    }
    if e.rel.seed_types is not None:
        out["entity_types"] = R.entity_types(e.flows, e.rel.seed_types)
    return out


def validate(e: Evaluation, transmitters: list[str], absorbers: list[str]) -> dict[str, DataFrame]:
    """The validity battery on the same pipeline."""
    keys = e.panel.select(F.col("key").alias("entity")).distinct()
    scores = write_table(e.graph_sources(), "scores")
    seed_ranking = e.seed_only().ranking().withColumnRenamed("exported_risk", "seed_risk")
    out = {
        "external_validity": Y.external_validity(e.ranking(), transmitters, absorbers),
        "placebo": Y.placebo(e.attribution(), G.reachability(G.induced(e.edges, keys))),
        "sensitivity": e.sensitivity(),
        "resolution_robustness": Y.ranking_agreement(e.ranking(), seed_ranking, "exported_risk", "seed_risk"),
        "graph_sources": scores,
        "graph_verdict": Y.graph_verdict(scores, "observed"),
        "direction_verdict": Y.direction_verdict(e.falsification()),
    }
    if e.s.calm is not None:
        out["temporal_placebo"] = Y.temporal_placebo(e.attribution(window=e.s.calm))
    return out


def robustness(e: Evaluation, target: str, players: list[str], nonflow: DataFrame | None = None, resamples: int = 2000) -> dict[str, DataFrame]:
    """The robustness battery on the same pipeline.

    ``players`` share the loss of ``target`` (Shapley), the first of them is the source of the attribution under noise.
    ``nonflow(entity, kind, asset)`` names the price series of a panel without flows (see ``stress.nonflow_stress``).
    """
    nodes = e.flows.select(F.explode(F.array("src", "dst")).alias("entity")).distinct()
    out = {
        "bootstrap": Y.paired_bootstrap(e.graph_source_predictions, "observed", "granger", resamples, e.s.seed),
        "lagged_flow": e.falsification(flow_lag=1, min_rows=5),
        "edge_types": e.edge_types(),
        "shapley": e.shapley(target, players),
        "attribution_sensitivity": e.attribution_sensitivity(players[0], target),
        "ranking_without_residual": e.without_residual().ranking(),
        "coverage": G.volume_coverage(e.flows, nodes),
        "ranking_stability": e.ranking_stability(),
        "weak_edges_dropped": e.weak_edges_dropped(),
        "latent_shock_robustness": e.latent_shock_robustness(),
    }
    if nonflow is not None:
        panel = X.nonflow_stress(X.calendar(e.flows), e.rel.prices, nonflow, e.s.roll)
        out["nonflow_falsification"] = e.varied(panel=panel).falsification(min_rows=5)
    return out


def events(rel: Relations, runs: dict[str, Settings], min_pre: int = 4) -> DataFrame:
    """The same pipeline per event: (event, ok, n_entities, n_pre, n_event, n_edges, model scores).

    An event without enough buckets before or inside its window gives one row with ``ok`` false. The transfers are
    scanned and resolved once for the periods of all events; what is fitted per event are its bucketed flows.
    """
    out = None
    book = write_table(R.address_book(rel.seed, rel.labels), "book")
    periods = {name: R.Period(s.unit, s.min_volume, s.start, s.end) for name, s in runs.items()}
    resolved = write_table(R.resolved_periods(rel.transfers, rel.tokens, book, periods, rel.rates), "resolved-periods")
    for name, s in runs.items():
        e = Evaluation(rel, s, resolved=resolved.where(F.col("period") == name).drop("period"))
        cal = X.calendar(e.flows)
        n = cal.agg(
            F.count_if(F.col("ts") < at(s.event[0])).alias("n_pre"),
            F.count_if(between(F.col("ts"), *s.event, closed=True)).alias("n_event"),
        ).first()
        ok = n["n_pre"] >= min_pre and n["n_event"] >= 1
        head = [F.lit(name).alias("event"), F.lit(ok).alias("ok"), F.lit(n["n_pre"]).cast("long").alias("n_pre"), F.lit(n["n_event"]).cast("long").alias("n_event")]
        if ok:
            sizes = [
                e.panel.agg(F.count_distinct("key")).scalar().alias("n_entities"), e.edges.agg(F.count("*")).scalar().alias("n_edges"),
            ]
            part = e.falsification().select(*head, *sizes, "model", "wrmse", "corr", "n")
        else:
            none, zero = F.lit(None), F.lit(0).cast("long")
            part = cal.sparkSession.range(1).select(
                *head, zero.alias("n_entities"), zero.alias("n_edges"), none.cast("string").alias("model"),
                none.cast("double").alias("wrmse"), none.cast("double").alias("corr"), zero.alias("n"),
            )
        out = part if out is None else out.unionByName(part)
    return out


def resolution(rel: Relations, symbol: str, start: str | None = None, end: str | None = None, **options) -> dict[str, DataFrame]:
    """Address resolution on the transfers of one token: report, held-out scores, feature importances, clusters (``address.resolution``)."""
    tokens = rel.tokens.where(F.col("sym") == symbol)
    edges = A.address_edges(rel.transfers, tokens, start, end)
    return A.resolution(edges, write_table(R.dedupe_labels(rel.labels), "labels"), **options)


def save_all(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        save_result(df, f"{path}/{name}", fmt)
