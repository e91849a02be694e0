"""Structural fits, one-step scoring, falsification and sensitivity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.output import rounded
from flowrisk.functions.time import between
from flowrisk.operators import baselines as B
from flowrisk.operators import battery as Y
from flowrisk.operators import graph as G
from flowrisk.operators import structural as M
from flowrisk.plans.baseline_queries import solve_sql
from flowrisk.plans.inputs import EVENT, FIT_END, Inputs
from flowrisk.plans.oracle import CTES, compose
from flowrisk.plans.queries import query
from flowrisk.plans.stress_queries import nonflow_panel
from flowrisk.session import write_table

EVENT_SQL = f"ts >= '{EVENT[0]}' AND ts <= '{EVENT[1]}'"
FIT_SQL = f"ts < '{FIT_END}'"


def structural_sql(p: str, models: str, panel: str = "panel", flows: str = "flows_k", lag: int = 0, fit: str = FIT_SQL, event: str = EVENT_SQL) -> dict[str, str]:
    """Relations <p>_eq, _feat, _coef (w by feature), _b and _pred of a set of models (model, src, dst)."""
    c: dict[str, str] = {}
    c[f"{p}_names"] = f"SELECT DISTINCT model FROM {models}"
    c[f"{p}_par"] = f"""
SELECT model, dst AS child, src AS parent, row_number() OVER (PARTITION BY model, dst ORDER BY src) AS i, count(*) OVER (PARTITION BY model, dst) AS k
FROM {models} WHERE src IN (SELECT key FROM {panel}) AND dst IN (SELECT key FROM {panel})"""
    c[f"{p}_lag"] = f"""
SELECT ts, pos, key, value, lag(value) OVER w AS prev, {'lag(ts) OVER w' if lag else 'ts'} AS fts FROM {panel}
WINDOW w AS (PARTITION BY key ORDER BY ts)"""
    c[f"{p}_feat"] = f"""
SELECT q.model, q.child, k, y.ts, y.pos, q.i, s.prev AS x FROM {p}_par q JOIN {p}_lag y ON y.key = q.child AND y.pos > 1
JOIN {p}_lag s ON s.key = q.parent AND s.ts = y.ts
UNION ALL SELECT q.model, q.child, k, y.ts, y.pos, q.k + q.i, ln(1 + coalesce(f.usd, 0))
FROM {p}_par q JOIN {p}_lag y ON y.key = q.child AND y.pos > 1 LEFT JOIN {flows} f ON f.src = q.parent AND f.dst = q.child AND f.bucket = y.fts"""
    c[f"{p}_all"] = f"""
SELECT model, child, k, ts, i, x FROM {p}_feat WHERE {fit}
UNION ALL SELECT DISTINCT model, child, k, ts, 2 * k + 1, y.value FROM {p}_par q JOIN {p}_lag y ON y.key = q.child AND y.pos > 1 WHERE {fit}"""
    c[f"{p}_gram"] = f"""
SELECT a.model, a.child, a.k, a.i, b.i AS j, count(*) * covar_pop(a.x, b.x) + max(CASE WHEN a.i = b.i THEN 1e0 ELSE 0e0 END) AS g
FROM {p}_all a JOIN {p}_all b ON a.model = b.model AND a.child = b.child AND a.ts = b.ts WHERE a.i <= 2 * a.k GROUP BY ALL"""
    c[f"{p}_mat"] = f"""
SELECT model, child, 2 * k AS n, list(r ORDER BY i) AS m FROM (SELECT model, child, k, i, list(g ORDER BY j) AS r FROM {p}_gram GROUP BY ALL) GROUP BY ALL"""
    c[f"{p}_sol"] = solve_sql(f"{p}_mat", "model, child, n", "n")
    c[f"{p}_w"] = f"SELECT model, child, i, m[i][n + 1] AS w FROM {p}_sol, range(1, n + 1) r(i)"
    c[f"{p}_mean"] = f"""
SELECT n.model, l.key AS child, avg(value) AS ybar FROM {p}_names n, {p}_lag l WHERE pos > 1 AND {fit} GROUP BY ALL"""
    c[f"{p}_b"] = f"""
SELECT a.model, a.child, a.ybar - coalesce(s.wx, 0) AS b FROM {p}_mean a LEFT JOIN (SELECT w.model, w.child, sum(w.w * x.x) AS wx FROM {p}_w w
  JOIN (SELECT model, child, i, avg(x) AS x FROM {p}_all GROUP BY ALL) x ON x.model = w.model AND x.child = w.child AND x.i = w.i GROUP BY ALL) s
  ON s.model = a.model AND s.child = a.child"""
    c[f"{p}_pred"] = f"""
SELECT b.model, b.child, y.ts, y.pos, y.value AS y, b.b + coalesce(s.wx, 0) AS yhat, y.value - b.b - coalesce(s.wx, 0) AS u
FROM {p}_b b JOIN {p}_lag y ON y.key = b.child AND y.pos > 1
LEFT JOIN (SELECT f.model, f.child, f.ts, sum(f.x * w.w) AS wx FROM {p}_feat f JOIN {p}_w w ON f.model = w.model AND f.child = w.child AND f.i = w.i GROUP BY ALL) s
ON s.model = b.model AND s.child = b.child AND s.ts = y.ts"""
    c[f"{p}_scores"] = f"""
SELECT model, sqrt(sum((abs(y) + 0.1e0) * (yhat - y) * (yhat - y)) / sum(abs(y) + 0.1e0)) AS wrmse, sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
  avg(abs(yhat - y)) AS mae, avg((sign(yhat) = sign(y))::INT) AS dir_acc, coalesce(corr(yhat, y), 0) AS corr, count(*) AS n
FROM {p}_pred WHERE {event} GROUP BY model"""
    return c


ROUND_SCORES = "model, round(wrmse, 6) AS wrmse, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(dir_acc, 6) AS dir_acc, round(corr, 6) + 0 AS corr, n"

CTES["m_true"] = "SELECT 'true' AS model, src, dst FROM edges"
TRUE = structural_sql("t", "m_true")
CTES["m_dir"] = """
SELECT 'true_direction' AS model, src, dst FROM edges UNION ALL SELECT 'reversed_edges', dst, src FROM edges
UNION ALL SELECT 'symmetric', src, dst FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
CTES["m_type"] = """
SELECT 'true' AS model, src, dst FROM edges
UNION ALL SELECT 'reverse_documented', CASE WHEN source = 'documented' THEN dst ELSE src END, CASE WHEN source = 'documented' THEN src ELSE dst END FROM edges
UNION ALL SELECT 'reverse_observed', CASE WHEN source = 'documented' THEN src ELSE dst END, CASE WHEN source = 'documented' THEN dst ELSE src END FROM edges"""


# ---------------------------------------------------------------- shared steps
def in_event(df: DataFrame) -> DataFrame:
    return df.where(between(F.col("ts"), *EVENT, closed=True))


def fitted(i: Inputs, models: DataFrame, names: list[str], panel: DataFrame, flows: DataFrame, flow_lag: int = 0,
           min_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """Design rows and coefficients of the models, fitted before the event."""
    rows = write_table(M.design(M.equations(models, panel, names), panel, flows, flow_lag), "design")
    return rows, M.fit(i.before(rows, "ts"), min_rows=min_rows)


def true_model(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Design rows and coefficients of the observed graph, as stages."""
    rows = i._stage("true-rows", lambda: M.design(
        M.equations(M.as_models(true=i.edges()), i.panel(), ["true"]), i.panel(), i.flows()))
    coef = i._stage("true-coef", lambda: M.fit(i.before(rows, "ts")))
    return rows, coef


def event_scores(i: Inputs, models: DataFrame, names: list[str], panel: DataFrame | None = None,
                 flows: DataFrame | None = None, flow_lag: int = 0, min_rows: int = 1) -> DataFrame:
    rows, coef = fitted(i, models, names, i.panel() if panel is None else panel, i.flows() if flows is None else flows, flow_lag, min_rows)
    return M.scores(M.predict(in_event(rows), coef))


def directions(i: Inputs) -> tuple[DataFrame, list[str]]:
    e = i.edges()
    return M.as_models(true_direction=e, reversed_edges=G.reverse(e), symmetric=G.symmetric(e)), [
        "true_direction", "reversed_edges", "symmetric"]


# ---------------------------------------------------------------- fit
@query("structural_coefficients", compose("""
SELECT child, 'intercept' AS kind, '' AS parent, round(b, 6) + 0 AS w FROM t_b
UNION ALL SELECT w.child, CASE WHEN w.i > k THEN 'flow' ELSE 'stress' END, p.parent, round(w.w, 6) + 0 FROM t_w w
JOIN t_par p ON p.child = w.child AND p.i = CASE WHEN w.i > p.k THEN w.i - p.k ELSE w.i END""", **TRUE))
def _coefficients(i: Inputs) -> DataFrame:
    return rounded(M.coefficient_table(true_model(i)[1]).drop("model"))


@query("one_step_predictions", compose(f"SELECT child, ts, round(y, 6) + 0 AS y, round(yhat, 6) + 0 AS yhat, round(u, 6) + 0 AS u FROM t_pred WHERE {EVENT_SQL}", **TRUE))
def _predictions(i: Inputs) -> DataFrame:
    rows, coef = true_model(i)
    return rounded(M.predict(in_event(rows), coef).select("child", "ts", "y", "yhat", "u"))


@query("residual_std", compose(f"SELECT child, round(stddev_samp(u), 6) AS sd FROM t_pred WHERE {FIT_SQL} GROUP BY child", **TRUE))
def _residual_std(i: Inputs) -> DataFrame:
    rows, coef = true_model(i)
    return rounded(M.residual_std(M.predict(i.before(rows, "ts"), coef)).drop("model"))


@query("one_step_scores", compose(f"SELECT {ROUND_SCORES} FROM t_scores", **TRUE))
def _scores(i: Inputs) -> DataFrame:
    rows, coef = true_model(i)
    return rounded(M.scores(M.predict(in_event(rows), coef)))


# ---------------------------------------------------------------- falsification
@query("direction_falsification", compose(f"SELECT {ROUND_SCORES} FROM d_scores", **structural_sql("d", "m_dir")))
def _falsification(i: Inputs) -> DataFrame:
    return rounded(event_scores(i, *directions(i)))


@query("direction_verdict", compose("""
SELECT round(gap, 6) + 0 AS gap, CASE WHEN gap > 0.02 THEN 'SUPPORTED' WHEN gap < -0.02 THEN 'REFUTED' ELSE 'TIE' END AS verdict
FROM (SELECT (r.wrmse - t.wrmse) / t.wrmse AS gap FROM d_scores t, d_scores r WHERE t.model = 'true_direction' AND r.model = 'reversed_edges')""",
    **structural_sql("d", "m_dir")))
def _verdict(i: Inputs) -> DataFrame:
    return rounded(Y.direction_verdict(event_scores(i, *directions(i))))


@query("nonflow_falsification", compose(f"SELECT {ROUND_SCORES} FROM d_scores", **structural_sql("d", "m_dir", "nonflow_panel")))
def _nonflow_falsification(i: Inputs) -> DataFrame:
    panel = i._stage("nonflow-panel", lambda: nonflow_panel(i))
    return rounded(event_scores(i, *directions(i), panel=panel, min_rows=5))


@query("lagged_flow_scores", compose(f"SELECT {ROUND_SCORES} FROM d_scores", **structural_sql("d", "m_dir", lag=1)))
def _lagged(i: Inputs) -> DataFrame:
    return rounded(event_scores(i, *directions(i), flow_lag=1, min_rows=5))


@query("edge_type_falsification", compose(f"""
SELECT {ROUND_SCORES}, (SELECT count(*) FROM edges WHERE source = 'documented') AS n_documented,
  (SELECT count(*) FROM edges WHERE source <> 'documented') AS n_observed FROM y_scores""", **structural_sql("y", "m_type")))
def _edge_types(i: Inputs) -> DataFrame:
    e = i.edges()
    doc = F.col("source") == G.DOCUMENTED
    models = M.as_models(true=e, reverse_documented=G.reverse_where(e, doc), reverse_observed=G.reverse_where(e, ~doc))
    out = event_scores(i, models, ["true", "reverse_documented", "reverse_observed"], min_rows=5)
    count = lambda c: e.where(c).agg(F.count("*")).scalar()
    return rounded(out.withColumns({"n_documented": count(doc), "n_observed": count(~doc)}))


# ---------------------------------------------------------------- observed against estimated graphs
CTES["comp"] = """
SELECT min(entity) AS entity, asset FROM entity_asset WHERE entity IN (SELECT key FROM panel) GROUP BY asset"""
CTES["comp_returns_fit"] = f"""
SELECT ts, entity AS key, value FROM week_complete JOIN comp ON asset = key WHERE ts < '{FIT_END}'"""


def estimated_sql() -> dict[str, str]:
    """The Granger and partial-correlation relations over the comparison entities' fit-window returns."""
    swap = lambda s: (
        s.replace("week_complete", "comp_returns_fit").replace("lagged", "c_lagged").replace("granger_m", "c_granger_m")
        .replace("moments", "c_moments").replace("prec_in", "c_prec_in").replace("FROM prec,", "FROM c_prec,")
    )
    return {
        "c_lagged": swap(CTES["lagged"]), "c_granger_m": swap(CTES["granger_m"]), "c_granger": swap(CTES["granger"]),
        "c_moments": swap(CTES["moments"]), "c_prec_in": swap(CTES["prec_in"]), "c_prec": swap(CTES["prec"]), "c_pcorr": swap(CTES["pcorr"]),
        "c_panel0": "SELECT ts, key, value FROM panel WHERE key IN (SELECT entity FROM comp)",
        "c_panel": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS pos FROM c_panel0",
        "m_graphs": """
SELECT 'observed' AS model, src, dst FROM edges UNION ALL SELECT 'granger', src, dst FROM c_granger WHERE p_value < 0.1
UNION ALL SELECT 'partial_corr', src, dst FROM c_pcorr WHERE abs(pcorr) >= 0.02""",
        "all_graphs": "SELECT unnest(['observed', 'granger', 'partial_corr']) AS model",
    }


def graph_sources_sql(lag: int = 0) -> dict[str, str]:
    c = estimated_sql() | structural_sql("g", "m_graphs", "c_panel", lag=lag)
    c["g_names"] = "SELECT model FROM all_graphs"
    return c


def comparison_nodes(i: Inputs) -> DataFrame:
    """(entity, asset): one entity of the panel per asset."""
    keys = i.panel().select(F.col("key").alias("entity")).distinct()
    return i.entity_assets().join(keys, "entity", "left_semi").groupBy("asset").agg(F.min("entity").alias("entity"))


def graph_sources(i: Inputs) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    nodes = i._stage("comparison-nodes", lambda: comparison_nodes(i))
    r = i._stage("comparison-returns", lambda: i.before(G.mapped_returns(i.returns(), nodes), "ts"))
    models = M.as_models(
        observed=G.induced(i.edges(), nodes), granger=B.granger_graph(r, 0.10), partial_corr=B.partial_correlation_graph(r, 0.02)
    )
    keep = nodes.select(F.col("entity").alias("key"))
    return models, ["observed", "granger", "partial_corr"], i.panel().join(F.broadcast(keep), "key", "left_semi"), G.induced(i.flows(), nodes)


def graph_source_scores(i: Inputs, flow_lag: int = 0) -> DataFrame:
    models, names, panel, flows = graph_sources(i)
    return event_scores(i, i._stage("graph-sources", lambda: models), names, panel, flows, flow_lag)


@query("graph_source_scores", compose(f"SELECT {ROUND_SCORES} FROM g_scores", **graph_sources_sql()))
def _graph_sources(i: Inputs) -> DataFrame:
    return rounded(graph_source_scores(i))


@query("graph_source_scores_lagged_flow", compose(f"SELECT {ROUND_SCORES} FROM g_scores", **graph_sources_sql(lag=1)))
def _graph_sources_lagged(i: Inputs) -> DataFrame:
    return rounded(graph_source_scores(i, flow_lag=1))


@query("graph_source_verdict", compose("""
SELECT b.model AS best_estimated, round(b.wrmse - o.wrmse, 6) + 0 AS gap, o.wrmse < b.wrmse AS supported
FROM g_scores o, (SELECT * FROM g_scores WHERE model <> 'observed' ORDER BY wrmse LIMIT 1) b WHERE o.model = 'observed'""", **graph_sources_sql()))
def _graph_verdict(i: Inputs) -> DataFrame:
    return rounded(Y.graph_verdict(graph_source_scores(i), "observed"))


# ---------------------------------------------------------------- sensitivity
def ols_sql(panel: str = "panel", models: str = "m_true") -> dict[str, str]:
    """Per child OLS on the lagged parent stress over all rows: o_edge(parent, child, coef, t_stat, rv)."""
    c = {k.replace("t_", "o_"): v.replace("t_par", "o_par").replace("t_lag", "o_lag").replace("t_feat", "o_feat")
         for k, v in structural_sql("t", models, panel).items() if k in ("t_par", "t_lag")}
    c["o_all"] = """
SELECT q.model, q.child, k, y.ts, q.i + 1 AS i, s.prev AS x FROM o_par q JOIN o_lag y ON y.key = q.child AND y.pos > 1 JOIN o_lag s ON s.key = q.parent AND s.ts = y.ts
UNION ALL SELECT DISTINCT model, child, k, y.ts, 1, 1e0 FROM o_par q JOIN o_lag y ON y.key = q.child AND y.pos > 1"""
    c["o_y"] = "SELECT DISTINCT q.model, q.child, y.ts, y.value AS y FROM o_par q JOIN o_lag y ON y.key = q.child AND y.pos > 1"
    c["o_gram"] = """
SELECT a.model, a.child, a.k + 1 AS n, a.i, b.i AS j, sum(a.x * b.x) AS g FROM o_all a
JOIN o_all b ON a.model = b.model AND a.child = b.child AND a.ts = b.ts GROUP BY ALL"""
    c["o_mat"] = """
SELECT model, child, n, list(list_concat(r, list_transform(range(1, n + 1), lambda c: CASE WHEN c = i THEN 1e0 ELSE 0e0 END)) ORDER BY i) AS m
FROM (SELECT model, child, n, i, list(g ORDER BY j) AS r FROM o_gram GROUP BY ALL) GROUP BY ALL"""
    c["o_sol"] = solve_sql("o_mat", "model, child, n", "n")
    c["o_xy"] = """
SELECT a.model, a.child, a.i, sum(a.x * y.y) AS xy FROM o_all a JOIN o_y y ON a.model = y.model AND a.child = y.child AND a.ts = y.ts GROUP BY ALL"""
    c["o_beta"] = """
SELECT s.model, s.child, s.n, r.i, any_value(s.m[r.i][s.n + r.i]) AS inv, sum(s.m[r.i][s.n + x.i] * x.xy) AS beta
FROM o_sol s, range(1, n + 1) r(i) JOIN o_xy x ON x.model = s.model AND x.child = s.child GROUP BY ALL"""
    c["o_rss"] = """
SELECT y.model, y.child, count(*) - any_value(f.n) AS dof, sum((y.y - f.fit) * (y.y - f.fit)) AS rss FROM o_y y
JOIN (SELECT a.model, a.child, a.ts, b.n, sum(a.x * b.beta) AS fit FROM o_all a JOIN o_beta b ON a.model = b.model AND a.child = b.child AND a.i = b.i GROUP BY ALL) f
ON f.model = y.model AND f.child = y.child AND f.ts = y.ts GROUP BY ALL"""
    c["o_edge"] = """
SELECT b.model, p.parent, b.child, b.beta AS coef, b.beta / sqrt(b.inv * r.rss / r.dof) AS t_stat,
  0.5e0 * (sqrt(f2 * f2 + 4 * f2) - f2) AS rv
FROM o_beta b JOIN o_rss r ON r.model = b.model AND r.child = b.child JOIN o_par p ON p.model = b.model AND p.child = b.child AND p.i = b.i - 1,
LATERAL (SELECT b.beta * b.beta / (b.inv * r.rss / r.dof) / r.dof AS f2)"""
    return c


def sensitivity(i: Inputs) -> DataFrame:
    eqs = M.equations(M.as_models(true=i.edges()), i.panel(), ["true"])
    return M.edge_sensitivity(eqs, i.panel())


@query("edge_sensitivity", compose("SELECT parent, child, round(coef, 6) + 0 AS coef, round(t_stat, 6) + 0 AS t_stat, round(rv, 6) AS robustness_value FROM o_edge", **ols_sql()))
def _sensitivity(i: Inputs) -> DataFrame:
    return rounded(sensitivity(i).drop("model"))


@query("strongest_edges", compose("""
SELECT parent, child, round(coef, 6) + 0 AS coef, round(t_stat, 6) + 0 AS t_stat, round(rv, 6) AS robustness_value
FROM o_edge ORDER BY abs(t_stat) DESC, child, parent LIMIT 15""", **ols_sql()))
def _strongest(i: Inputs) -> DataFrame:
    return rounded(sensitivity(i).orderBy(F.desc(F.abs("t_stat")), "child", "parent").limit(15).drop("model"))


# ---------------------------------------------------------------- paired bootstrap
def boot_sql(count: int, block: int) -> dict[str, str]:
    c = graph_sources_sql()
    c["bd"] = f"""
SELECT row_number() OVER (ORDER BY g.child, g.ts) - 1 AS pos, count(*) OVER () AS n,
  (abs(g.y) + 0.1e0) * ((g.yhat - g.y) * (g.yhat - g.y) - (o.yhat - o.y) * (o.yhat - o.y)) AS d
FROM g_pred g JOIN g_pred o ON o.model = 'observed' AND g.model = 'granger' AND o.child = g.child AND o.ts = g.ts WHERE {EVENT_SQL.replace('ts', 'g.ts')}"""
    c["bx"] = f"""
SELECT b, ((('0x' || substr(md5(concat_ws(':', 7, b, k // {block})), 1, 8))::BIGINT % n) + k % {block}) % n AS pos
FROM range(0, {count}) r(b), range(0, (SELECT max(n) FROM bd)) s(k), (SELECT max(n) AS n FROM bd)"""
    c["bm"] = "SELECT b, avg(d) AS m FROM bx JOIN bd ON bx.pos = bd.pos GROUP BY b"
    return c


BOOT = """
SELECT round((SELECT avg(d) FROM bd), 6) + 0 AS mean_diff, round(quantile_cont(m, 0.025), 6) + 0 AS ci_low, round(quantile_cont(m, 0.975), 6) + 0 AS ci_high,
  round(avg((m > 0)::INT), 6) AS prob_better, count(*) AS resamples FROM bm"""


def graph_source_errors(i: Inputs) -> DataFrame:
    models, names, panel, flows = graph_sources(i)
    rows, coef = fitted(i, i._stage("graph-sources", lambda: models), names, panel, flows)
    return M.predict(in_event(rows), coef)


@query("paired_bootstrap", compose(BOOT, **boot_sql(2000, 1)))
def _bootstrap(i: Inputs) -> DataFrame:
    return rounded(Y.paired_bootstrap(graph_source_errors(i), "observed", "granger", 2000, seed=7))


@query("paired_block_bootstrap", compose(BOOT, **boot_sql(2000, 8)))
def _block_bootstrap(i: Inputs) -> DataFrame:
    return rounded(Y.paired_bootstrap(graph_source_errors(i), "observed", "granger", 2000, seed=7, block=8))
