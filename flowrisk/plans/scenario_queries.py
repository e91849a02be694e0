"""Interventional, counterfactual and robustness queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.output import rounded
from flowrisk.functions.tails import spearman
from flowrisk.operators import baselines as B
from flowrisk.operators import battery as Y
from flowrisk.operators import graph as G
from flowrisk.operators import resolve as R
from flowrisk.operators import scenarios as C
from flowrisk.operators import stress as X
from flowrisk.operators import structural as M
from flowrisk.plans import jobs
from flowrisk.plans.baseline_queries import spearman_sql, t_tail_sql
from flowrisk.plans.inputs import CALM, EVENT, FIT_END, MIN_VOLUME, PANEL_ROLL, Inputs
from flowrisk.plans.oracle import CTES, compose
from flowrisk.plans.queries import query
from flowrisk.plans.stress_queries import normal_sql
from flowrisk.plans.structural_queries import EVENT_SQL, FIT_SQL, TRUE, fitted, in_event, ols_sql, sensitivity, structural_sql, true_model
from flowrisk.sources import tables as T

DRAWS, SEED = 150, 7


# ---------------------------------------------------------------- SQL counterparts
def system_sql(p: str, panel: str = "panel", window: str = EVENT_SQL, coef: str | None = None, init_end: str = EVENT[0]) -> dict[str, str]:
    """<p>_sys: one row per model with keys, W, drive, init, hi, pre and the observed paths, as lists.

    ``coef`` names a relation prefix holding w, b of other models over the features of ``p``.
    """
    q = coef or p
    c: dict[str, str] = {}
    c[f"{q}_key"] = f"SELECT key, row_number() OVER (ORDER BY key) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM {panel})"
    c[f"{q}_edge"] = f"""
SELECT w.model, w.child, e.parent, sum(w.w) AS w FROM {q}_w w JOIN {p}_par e ON e.child = w.child AND e.i = w.i {'' if coef else 'AND e.model = w.model'} GROUP BY ALL"""
    c[f"{q}_wrow"] = f"""
SELECT b.model, a.i, list(coalesce(e.w, 0e0) ORDER BY c.i) AS r FROM {q}_b b JOIN {q}_key a ON a.key = b.child CROSS JOIN {q}_key c
LEFT JOIN {q}_edge e ON e.model = b.model AND e.child = b.child AND e.parent = c.key GROUP BY ALL"""
    c[f"{q}_flowterm"] = f"""
SELECT w.model, f.child, f.ts, sum(w.w * f.x) AS v FROM {q}_w w JOIN {p}_feat f ON f.child = w.child AND f.i = w.i {'' if coef else 'AND f.model = w.model'}
WHERE f.i > f.k AND {window.replace('ts', 'f.ts')} GROUP BY ALL"""
    c[f"{q}_drow"] = f"""
SELECT b.model, t.ts, list(b.b + coalesce(f.v, 0) ORDER BY b.child) AS d FROM {q}_b b
CROSS JOIN (SELECT DISTINCT ts FROM {panel} WHERE {window}) t LEFT JOIN {q}_flowterm f ON f.model = b.model AND f.child = b.child AND f.ts = t.ts GROUP BY ALL"""
    c[f"{q}_level"] = f"""
SELECT key, arg_max(value, ts) FILTER (ts < '{init_end}') AS init, quantile_cont(value, 0.95) AS hi,
  quantile_cont(value, 0.5) FILTER ({FIT_SQL}) AS pre, list(value ORDER BY ts) FILTER ({window}) AS path FROM {panel} GROUP BY key"""
    c[f"{q}_sys"] = f"""
SELECT w.model, len(l.keys) AS n, w.w AS w, d.drive, l.* FROM (SELECT model, list(r ORDER BY i) AS w FROM {q}_wrow GROUP BY model) w
JOIN (SELECT model, list(d ORDER BY ts) AS drive FROM {q}_drow GROUP BY model) d ON w.model = d.model
CROSS JOIN (SELECT list(key ORDER BY key) AS keys, list(init ORDER BY key) AS init, list(hi ORDER BY key) AS hi, list(pre ORDER BY key) AS pre,
  list(path ORDER BY key) AS path FROM {q}_level) l"""
    return c


def run_sql(p: str, scen: str, shock: str | None, out: str) -> str:
    """Recursion over the steps of scenarios (model, block, sid, frc) with shocks (model, block, u)."""
    u = "+ coalesce(h.u[r.t + 1][i], 0)" if shock else ""
    join = f"LEFT JOIN {shock} h ON h.model = r.model AND h.block = r.block" if shock else ""
    return f"""
WITH RECURSIVE r(model, block, sid, t, s, loss) AS (
  SELECT c.model, c.block, c.sid, 0, y.init, list_transform(y.init, lambda x: 0e0) FROM {scen} c JOIN {p}_sys y ON y.model = c.model
  UNION ALL SELECT model, block, sid, t + 1, s2, list_transform(s2, lambda x, i: loss[i] + greatest(x, 0)) FROM (
    SELECT r.model, r.block, r.sid, r.t, r.loss,
      list_transform(y.init, lambda x, i: coalesce(c.frc[i][r.t + 1], y.drive[r.t + 1][i] + list_inner_product(y.w[i], r.s) {u})) AS s2
    FROM r JOIN {p}_sys y ON y.model = r.model JOIN {scen} c ON c.model = r.model AND c.block = r.block AND c.sid = r.sid {join}
    WHERE r.t < len(y.drive)))
SELECT r.model, r.block, r.sid, {out} AS loss FROM r JOIN {p}_sys y ON y.model = r.model WHERE r.t = len(y.drive)"""


def levels_sql(p: str, blocks: str = "SELECT 0 AS block") -> str:
    """Every source at its high level (odd sid) and at zero (even sid)."""
    return f"""
SELECT y.model, b.block, 2 * (i - 1) + h AS sid, list_transform(y.keys, lambda x, j: CASE WHEN j = i THEN
  list_transform(y.drive, lambda d: CASE WHEN h = 1 THEN y.hi[i] ELSE 0e0 END) END) AS frc
FROM {p}_sys y, range(1, y.n + 1) a(i), range(0, 2) l(h), ({blocks}) b"""


def delta_sql(p: str, run: str) -> str:
    return f"""
SELECT r.model, y.keys[sid // 2 + 1] AS source, y.keys[j] AS target, quantile_cont(loss[j], 0.95) FILTER (sid % 2 = 1) AS tail_hi,
  quantile_cont(loss[j], 0.95) FILTER (sid % 2 = 0) AS tail_lo
FROM {run} r JOIN {p}_sys y ON y.model = r.model, range(1, y.n + 1) t(j) WHERE j <> sid // 2 + 1 GROUP BY ALL"""


def exported_sql(delta: str) -> str:
    return f"SELECT model, source AS entity, sum(greatest(tail_hi - tail_lo, 0)) AS exported_risk FROM {delta} GROUP BY ALL"


def det_sql(p: str) -> dict[str, str]:
    return {
        f"{p}_dscen": levels_sql(p), f"{p}_drun": run_sql(p, f"{p}_dscen", None, "r.loss"),
        f"{p}_ddelta": delta_sql(p, f"{p}_drun"), f"{p}_dexp": exported_sql(f"{p}_ddelta"),
    }


def draws_sql(p: str, draws: int, joint: bool = False, fit: str = FIT_SQL, window: str = EVENT_SQL) -> dict[str, str]:
    who = "'all'" if joint else "c.child"
    return {
        f"{p}_pool": f"SELECT model, child, pos, u, min(pos) OVER (PARTITION BY model, child) AS first, count(*) OVER (PARTITION BY model, child) AS n FROM {p}_pred WHERE {fit}",
        f"{p}_shock": f"""
WITH c AS (SELECT DISTINCT model, child, first, n FROM {p}_pool),
u AS (SELECT c.model, b AS block, st, c.child, q.u FROM c, range(0, {draws}) r(b), range(1, (SELECT max(len(drive)) FROM {p}_sys) + 1) s(st)
  JOIN {p}_pool q ON q.model = c.model AND q.child = c.child AND q.pos = c.first + ('0x' || substr(md5(concat_ws(':', {SEED}, {who}, b, st)), 1, 8))::BIGINT % c.n)
SELECT model, block, list(r ORDER BY st) AS u FROM (SELECT model, block, st, list(u ORDER BY child) AS r FROM u GROUP BY ALL) GROUP BY ALL""",
        f"{p}_mscen": levels_sql(p, f"SELECT range AS block FROM range(0, {draws})"),
        f"{p}_mrun": run_sql(p, f"{p}_mscen", f"{p}_shock", "r.loss"),
        f"{p}_delta": delta_sql(p, f"{p}_mrun"),
        f"{p}_exp": exported_sql(f"{p}_delta"),
    }


def attribution_sql(p: str, window: str = EVENT_SQL, observed: bool = True, shock_of: str | None = None) -> dict[str, str]:
    """<p>_attr: replay against pre-crisis level for every source; shocks are the window's residuals."""
    s = shock_of or p
    per_model = "" if shock_of is None else f"SELECT y.model, u FROM {p}_sys y, "
    u = "u" if observed else "0e0"
    base = f"(SELECT model, list(r ORDER BY ts) AS u FROM (SELECT model, ts, list({u} ORDER BY child) AS r FROM {s}_pred WHERE {window} GROUP BY ALL) GROUP BY ALL)"
    return {
        f"{p}_au": f"{per_model or 'SELECT model, u FROM '}{base} x",
        f"{p}_ashock": f"SELECT a.model, i AS block, a.u FROM {p}_au a JOIN {p}_sys y ON y.model = a.model, range(1, y.n + 1) r(i)",
        f"{p}_ascen": f"""
SELECT y.model, i AS block, h AS sid, list_transform(y.keys, lambda x, j: CASE WHEN j = i THEN
  CASE WHEN h = 0 THEN y.path[i] ELSE list_transform(y.drive, lambda d: y.pre[i]) END END) AS frc
FROM {p}_sys y, range(1, y.n + 1) a(i), range(0, 2) l(h)""",
        f"{p}_arun": run_sql(p, f"{p}_ascen", f"{p}_ashock", "r.loss"),
        f"{p}_attr": f"""
SELECT a.model, y.keys[a.block] AS source, y.keys[j] AS target, a.loss[j] AS loss_replay, b.loss[j] AS loss_counterfactual,
  a.loss[j] - b.loss[j] AS attribution, CASE WHEN a.loss[j] > 1e-9 THEN (a.loss[j] - b.loss[j]) / a.loss[j] ELSE 0 END AS share
FROM {p}_arun a JOIN {p}_arun b ON a.model = b.model AND a.block = b.block AND a.sid = 0 AND b.sid = 1 JOIN {p}_sys y ON y.model = a.model,
range(1, y.n + 1) t(j) WHERE j <> a.block""",
    }


SYS = TRUE | system_sql("t")
DET = SYS | det_sql("t")
MC = SYS | draws_sql("t", DRAWS)
ATTR = SYS | attribution_sql("t")
ROUND_ATTR = """source, target, round(loss_replay, 6) AS loss_replay, round(loss_counterfactual, 6) AS loss_counterfactual,
  round(attribution, 6) + 0 AS attribution, round(share, 6) + 0 AS share"""


# ---------------------------------------------------------------- shared steps
def true_system(i: Inputs, window: tuple[str, str] = EVENT) -> DataFrame:
    def build() -> DataFrame:
        rows, coef = true_model(i)
        inside = rows.where(C.between(F.col("ts"), *window, closed=True))
        return C.systems(inside, coef, C.entity_levels(i.panel(), FIT_END, EVENT[0]))

    return i._stage(f"true-system-{window[0]}", build)


def residual_pool(i: Inputs, rows: DataFrame, coef: DataFrame) -> DataFrame:
    return M.predict(i.before(rows, "ts"), coef).select("model", "child", "pos", "u")


def window_length(system: DataFrame):
    return system.agg(F.max((F.size("drive") / F.size("init")).cast("int"))).scalar()


def monte_carlo(i: Inputs, rows: DataFrame, coef: DataFrame, system: DataFrame, draws: int = DRAWS, joint: bool = False) -> DataFrame:
    shocks = C.residual_draws(residual_pool(i, rows, coef), window_length(system), draws, SEED, joint)
    return C.tail_losses(system, shocks)


def true_deltas(i: Inputs) -> DataFrame:
    return i._stage("true-deltas", lambda: monte_carlo(i, *true_model(i), true_system(i)))


def true_attribution(i: Inputs, window: tuple[str, str] = EVENT, abduction: str = "observed") -> DataFrame:
    rows, coef = true_model(i)
    paths, shocks = C.observed_window(M.predict(rows, coef), i.panel(), *window, abduction, FIT_END)
    return C.attribution(true_system(i, window), paths, shocks)


def leading_entities(i: Inputs, n: int) -> list[str]:
    """Named entities by throughput; a handful of names."""
    top = R.throughput(i.flows()).where(F.col("entity") != R.RESIDUAL).orderBy(F.desc("usd"), "entity").limit(n)
    return [r["entity"] for r in top.collect()]


CTES["leader"] = """
SELECT entity, row_number() OVER (ORDER BY usd DESC, entity) AS rn FROM (SELECT entity, sum(usd) AS usd
  FROM (SELECT src AS entity, usd FROM flows_k UNION ALL SELECT dst, usd FROM flows_k) GROUP BY entity) WHERE entity <> 'retail'"""


# ---------------------------------------------------------------- interventional
@query("deterministic_exported_risk", compose("SELECT entity, round(exported_risk, 6) AS exported_risk FROM t_dexp", **DET))
def _det(i: Inputs) -> DataFrame:
    return rounded(C.exported_risk(C.deterministic_deltas(true_system(i))).drop("model"))


@query("tail_loss_matrix", compose("""
SELECT source, target, round(tail_hi, 6) AS tail_hi, round(tail_lo, 6) AS tail_lo, round(tail_hi - tail_lo, 6) + 0 AS delta FROM t_delta""", **MC))
def _tails(i: Inputs) -> DataFrame:
    return rounded(true_deltas(i).drop("model"))


@query("systemic_ranking", compose("SELECT entity, round(exported_risk, 6) AS exported_risk FROM t_exp", **MC))
def _ranking(i: Inputs) -> DataFrame:
    return rounded(C.exported_risk(true_deltas(i)).drop("model"))


@query("systemic_ranking_joint_draws", compose("SELECT entity, round(exported_risk, 6) AS exported_risk FROM t_exp", **(SYS | draws_sql("t", DRAWS, joint=True))))
def _ranking_joint(i: Inputs) -> DataFrame:
    deltas = monte_carlo(i, *true_model(i), true_system(i), joint=True)
    return rounded(C.exported_risk(deltas).drop("model"))


# ---------------------------------------------------------------- counterfactual
@query("counterfactual_attribution", compose(f"SELECT {ROUND_ATTR} FROM t_attr", **ATTR))
def _attribution(i: Inputs) -> DataFrame:
    return rounded(true_attribution(i).drop("model"))


@query("counterfactual_attribution_fit_window", compose(f"SELECT {ROUND_ATTR} FROM t_attr", **(SYS | attribution_sql("t", observed=False))))
def _attribution_fit(i: Inputs) -> DataFrame:
    return rounded(true_attribution(i, abduction="fit_window").drop("model"))


SHAP = SYS | attribution_sql("t") | {
    "p_shock": "SELECT a.model, m AS block, a.u FROM t_au a, range(0, 8) r(m)",
    "p_scen": """
SELECT y.model, m AS block, 0 AS sid, list_transform(y.keys, lambda x, j: CASE WHEN x = t.entity THEN NULL
  WHEN (x = p1.entity AND m % 2 = 1) OR (x = p2.entity AND m // 2 % 2 = 1) OR (x = p3.entity AND m // 4 = 1) THEN y.path[j]
  ELSE list_transform(y.drive, lambda d: y.pre[j]) END) AS frc
FROM t_sys y, range(0, 8) r(m), leader t, leader p1, leader p2, leader p3 WHERE t.rn = 4 AND p1.rn = 1 AND p2.rn = 2 AND p3.rn = 3""",
    "p_run": run_sql("t", "p_scen", "p_shock", "r.loss[list_position(y.keys, (SELECT entity FROM leader WHERE rn = 4))]"),
}


@query("shapley_attribution", compose("""
SELECT l.entity AS player, round(sum(CASE bit_count(a.block) WHEN 1 THEN 2e0 ELSE 1e0 END / CASE bit_count(a.block) WHEN 1 THEN 6e0 WHEN 2 THEN 6e0 ELSE 3e0 END
  * (b.loss - a.loss)), 6) + 0 AS shapley, round((SELECT arg_max(loss, block) - arg_min(loss, block) FROM p_run), 6) + 0 AS total_effect
FROM leader l JOIN p_run a ON a.block // (1 << (l.rn - 1)) % 2 = 0 JOIN p_run b ON b.block = a.block + (1 << (l.rn - 1)) WHERE l.rn <= 3 GROUP BY l.entity"""
    .replace("CASE bit_count(a.block) WHEN 1 THEN 2e0 ELSE 1e0 END / CASE bit_count(a.block) WHEN 1 THEN 6e0 WHEN 2 THEN 6e0 ELSE 3e0 END",
             "CASE bit_count(a.block) WHEN 1 THEN 1e0 ELSE 2e0 END / 6e0"), **SHAP))
def _shapley(i: Inputs) -> DataFrame:
    players = leading_entities(i, 4)
    target = players.pop()
    rows, coef = true_model(i)
    paths, shocks = C.observed_window(M.predict(rows, coef), i.panel(), *EVENT)
    losses = C.coalition_losses(true_system(i), paths, shocks, target, players)
    return rounded(C.shapley(losses, players).drop("model"))


# ---------------------------------------------------------------- coefficient noise
def noisy_sql(count: int, seed: int, flows_too: bool) -> dict[str, str]:
    stress = normal_sql(str(seed), "'stress'", "c", "w.child", "i - 1")
    flow = normal_sql(str(seed), "'flow'", "c", "w.child", "i - k - 1")
    return {
        "n_w": f"""
SELECT format('copy-{{:03d}}', c) AS model, w.child, w.i, w.w * (1 + CASE WHEN w.i <= q.k THEN 0.15e0 * {stress}
  ELSE {'0.15e0 * ' + flow if flows_too else '0'} END) AS w
FROM (SELECT w.*, i FROM t_w w) w JOIN (SELECT DISTINCT child, k FROM t_par) q ON q.child = w.child, range(0, {count}) r(c)""",
        "n_b": f"SELECT format('copy-{{:03d}}', c) AS model, child, b FROM t_b, range(0, {count}) r(c)",
    } | system_sql("t", coef="n")


def perturbed_system(i: Inputs, count: int, flows_too: bool) -> DataFrame:
    rows, coef = true_model(i)
    noisy = C.perturbed(coef, count, 0.15, SEED, flows_too)
    names = noisy.select("model").distinct()
    return C.systems(C.for_models(in_event(rows), names), noisy, C.entity_levels(i.panel(), FIT_END, EVENT[0]))


NOISE_A = ATTR | noisy_sql(40, SEED, False) | attribution_sql("n", shock_of="t")


@query("attribution_sensitivity", compose("""
WITH s AS (SELECT share FROM n_attr WHERE source = (SELECT entity FROM leader WHERE rn = 1) AND target = (SELECT entity FROM leader WHERE rn = 2))
SELECT round((SELECT share FROM t_attr WHERE source = (SELECT entity FROM leader WHERE rn = 1) AND target = (SELECT entity FROM leader WHERE rn = 2)), 6) + 0 AS base_share,
  round(avg(share), 6) + 0 AS mean_share, round(stddev_pop(share), 6) AS sd, round(avg((share > 0)::INT), 6) AS frac_positive FROM s""", **NOISE_A))
def _attr_sensitivity(i: Inputs) -> DataFrame:
    source, target = leading_entities(i, 2)
    rows, coef = true_model(i)
    paths, shocks = C.observed_window(M.predict(rows, coef), i.panel(), *EVENT)
    base = C.attribution(true_system(i), paths, shocks, [source]).where(F.col("target") == target)
    noisy = perturbed_system(i, 40, False)
    shares = C.attribution(noisy, paths, C.for_models(shocks, noisy), [source]).where(F.col("target") == target)
    out = shares.agg(
        F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("sd"), F.avg((F.col("share") > 0).cast("double")).alias("frac_positive")
    )
    return rounded(out.select(base.select("share").scalar().alias("base_share"), "*"))


def compare_sql(base: str, other: str) -> str:
    """Per model of ``other``: rank correlation with ``base`` and overlap of the top three."""
    pairs = f"(SELECT o.model, o.entity, b.exported_risk AS x, o.exported_risk AS y FROM {other} o JOIN {base} b ON b.entity = o.entity)"
    return f"""
SELECT r.model, rho, n, overlap FROM ({spearman_sql(pairs, 'x', 'y', 'model')}) r
JOIN (SELECT o.model, count(b.entity) / 3e0 AS overlap FROM (SELECT model, entity, row_number() OVER (PARTITION BY model ORDER BY exported_risk DESC, entity) AS rn FROM {other}) o
  LEFT JOIN (SELECT entity FROM {base} ORDER BY exported_risk DESC, entity LIMIT 3) b ON b.entity = o.entity WHERE rn <= 3 GROUP BY o.model) t ON t.model = r.model"""


@query("ranking_stability", compose(f"""
SELECT round(avg(rho), 6) AS mean_rho, round(min(rho), 6) AS min_rho, round(avg(overlap), 6) AS mean_top3_overlap, count(*) AS n_copies FROM ({compare_sql('t_dexp', 'n_dexp')})""",
    **(DET | noisy_sql(25, SEED, True) | det_sql("n"))))
def _stability(i: Inputs) -> DataFrame:
    base = C.exported_risk(C.deterministic_deltas(true_system(i)))
    other = C.exported_risk(C.deterministic_deltas(perturbed_system(i, 25, True)))
    r = C.compare_rankings(base, other)
    return rounded(r.agg(F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.avg("top3_overlap").alias("mean_top3_overlap"), F.count("*").alias("n_copies")))


# ---------------------------------------------------------------- refits
def det_ranking(i: Inputs, models: DataFrame, names: list[str], panel: DataFrame) -> DataFrame:
    rows, coef = fitted(i, models, names, panel, i.flows())
    return C.exported_risk(C.deterministic_deltas(C.systems(in_event(rows), coef, C.entity_levels(panel, FIT_END, EVENT[0]))))


DROP = DET | ols_sql() | {
    "weak": "SELECT parent, child FROM (SELECT *, row_number() OVER (ORDER BY rv, child, parent) AS rn, count(*) OVER () AS n FROM o_edge) WHERE rn <= greatest(1, n // 4)",
    "m_drop": "SELECT 'dropped' AS model, src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM weak w WHERE w.parent = e.src AND w.child = e.dst)",
} | structural_sql("x", "m_drop") | system_sql("x") | det_sql("x")


@query("weak_edges_dropped", compose(f"SELECT round(rho, 6) AS rho, n, round(overlap, 6) AS top3_overlap, (SELECT count(*) FROM weak) AS n_dropped FROM ({compare_sql('t_dexp', 'x_dexp')})", **DROP))
def _drop(i: Inputs) -> DataFrame:
    weak = i._stage("weak-edges", lambda: Y.weakest_edges(sensitivity(i)))
    other = det_ranking(i, M.as_models(dropped=G.without_edges(i.edges(), weak)), ["dropped"], i.panel())
    base = C.exported_risk(C.deterministic_deltas(true_system(i)))
    return rounded(C.compare_rankings(base, other).drop("model").withColumn("n_dropped", weak.agg(F.count("*")).scalar()))


def latent_sql() -> dict[str, str]:
    c = dict(DET)
    for name, strength in (("la", "0.3e0"), ("lb", "0.6e0")):
        c[f"{name}_panel"] = f"SELECT p.ts, p.key, p.pos, p.value + {strength} * l.shock AS value FROM panel p JOIN latent l ON l.ts = p.ts"
        c |= structural_sql(name, "m_true", f"{name}_panel") | system_sql(name, f"{name}_panel") | det_sql(name)
    return c


@query("latent_shock_robustness", compose(f"""
SELECT 0.3e0 AS strength, round(rho, 6) AS rho, n, round(overlap, 6) AS top3_overlap FROM ({compare_sql('t_dexp', 'la_dexp')})
UNION ALL SELECT 0.6e0, round(rho, 6), n, round(overlap, 6) FROM ({compare_sql('t_dexp', 'lb_dexp')})""", **latent_sql()))
def _latent(i: Inputs) -> DataFrame:
    base = i._stage("true-deterministic", lambda: C.exported_risk(C.deterministic_deltas(true_system(i))))
    shock = i._stage("latent-shock", lambda: X.latent_shock(i.panel(), 11))
    out = None
    for strength in (0.3, 0.6):
        panel = i._stage(f"latent-panel-{strength}", lambda s=strength: X.inject(i.panel(), shock, s))
        r = C.compare_rankings(base, det_ranking(i, M.as_models(true=i.edges()), ["true"], panel)).select(F.lit(strength).alias("strength"), "rho", "n", "top3_overlap")
        out = r if out is None else out.unionByName(r)
    return rounded(out)


# ---------------------------------------------------------------- battery
@query("placebo", compose("""
WITH a AS (SELECT abs(attribution) AS a, r.src IS NOT NULL AS linked FROM t_attr LEFT JOIN reach r ON r.src = source AND r.dst = target)
SELECT count(*) FILTER (linked) AS n_connected, count(*) FILTER (NOT linked) AS n_unconnected, round(coalesce(avg(a) FILTER (linked), 0), 6) AS mean_connected,
  round(coalesce(avg(a) FILTER (NOT linked), 0), 6) AS mean_unconnected, round(coalesce(max(a) FILTER (NOT linked), 0), 6) AS max_unconnected,
  coalesce(max(a) FILTER (NOT linked), 0) < 1e-6 AS passes FROM a""", **ATTR))
def _placebo(i: Inputs) -> DataFrame:
    keys = i.panel().select(F.col("key").alias("entity")).distinct()
    return rounded(Y.placebo(true_attribution(i), G.reachability(G.induced(i.edges(), keys))))


CALM_SQL = f"ts >= '{CALM[0]}' AND ts <= '{CALM[1]}'"


@query("temporal_placebo", compose("SELECT round(avg(abs(attribution)), 6) AS mean_calm, round(max(abs(attribution)), 6) AS max_calm FROM t_attr",
                                   **(TRUE | system_sql("t", window=CALM_SQL) | attribution_sql("t", window=CALM_SQL))))
def _temporal(i: Inputs) -> DataFrame:
    return rounded(Y.temporal_placebo(true_attribution(i, CALM)))


@query("external_validity", compose("""
WITH r AS (SELECT entity, exported_risk AS v FROM t_exp)
SELECT round(avg(v) FILTER (entity IN ('NATION_0', 'NATION_1', 'retail')) - avg(v) FILTER (entity IN ('NATION_2', 'NATION_3', 'NATION_4')), 6) + 0 AS separation,
  (SELECT round(avg((t.v > a.v)::INT), 6) FROM r t, r a WHERE t.entity IN ('NATION_0', 'NATION_1', 'retail') AND a.entity IN ('NATION_2', 'NATION_3', 'NATION_4')) AS concordance
FROM r""", **MC))
def _external(i: Inputs) -> DataFrame:
    ranking = C.exported_risk(true_deltas(i))
    return rounded(Y.external_validity(ranking, ["NATION_0", "NATION_1", "retail"], ["NATION_2", "NATION_3", "NATION_4"]))


CTES["m_seed"] = "SELECT 'seed' AS model, src, dst FROM edges_seed"
SEED_MC = MC | structural_sql("s", "m_seed", "panel_seed", "flows_seed") | system_sql("s", "panel_seed") | draws_sql("s", DRAWS)


def agreement_select(pairs: str, x: str, y: str) -> str:
    return f"""
SELECT round(rho, 6) AS rho, n, round({t_tail_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)::DOUBLE')}, 6) AS p_value
FROM ({spearman_sql(pairs, x, y)})"""


@query("resolution_robustness", compose(agreement_select(
    "(SELECT a.exported_risk AS x, b.exported_risk AS y FROM t_exp a JOIN s_exp b ON a.entity = b.entity)", "x", "y"), **SEED_MC))
def _resolution(i: Inputs) -> DataFrame:
    flows = i.seed_flows()
    panel = i._stage("seed-panel", lambda: X.flow_stress(flows, i.entities(flows), PANEL_ROLL))
    edges = i._stage("seed-edges", lambda: i.edges(flows))
    rows, coef = fitted(i, M.as_models(seed=edges), ["seed"], panel, flows)
    coef = i._stage("seed-coef", lambda: coef)
    system = i._stage("seed-system", lambda: C.systems(in_event(rows), coef, C.entity_levels(panel, FIT_END, EVENT[0])))
    other = C.exported_risk(monte_carlo(i, rows, coef, system))
    full = C.exported_risk(true_deltas(i))
    return rounded(Y.ranking_agreement(full.select("entity", "exported_risk"), other.select("entity", F.col("exported_risk").alias("seed_risk")), "exported_risk", "seed_risk"))


CTES["m_nores"] = "SELECT 'named' AS model, src, dst FROM edges WHERE src <> 'retail' AND dst <> 'retail'"
CTES["panel_nores"] = "SELECT * FROM panel WHERE key <> 'retail'"
NORES = structural_sql("v", "m_nores", "panel_nores") | system_sql("v", "panel_nores") | draws_sql("v", 120)


@query("ranking_without_residual", compose("SELECT entity, round(exported_risk, 6) AS exported_risk FROM v_exp", **NORES))
def _no_residual(i: Inputs) -> DataFrame:
    panel = i.panel().where(F.col("key") != R.RESIDUAL)
    rows, coef = fitted(i, M.as_models(named=G.without_node(i.edges())), ["named"], panel, G.without_node(i.flows()))
    coef = i._stage("named-coef", lambda: coef)
    system = i._stage("named-system", lambda: C.systems(in_event(rows), coef, C.entity_levels(panel, FIT_END, EVENT[0])))
    return rounded(C.exported_risk(monte_carlo(i, rows, coef, system, 120)).drop("model"))


@query("baseline_divergence", compose(f"""
SELECT 'delta_covar' AS baseline, * FROM ({agreement_select('(SELECT exported_risk AS x, -delta_covar AS y FROM t_exp JOIN entity_asset e USING (entity) JOIN dcv d ON d.asset = e.asset)', 'x', 'y')})
UNION ALL SELECT 'mes', * FROM ({agreement_select('(SELECT exported_risk AS x, -mes AS y FROM t_exp JOIN entity_asset e USING (entity) JOIN mes d ON d.asset = e.asset)', 'x', 'y')})""", **MC))
def _divergence(i: Inputs) -> DataFrame:
    ranking = C.exported_risk(true_deltas(i)).join(i.entity_assets(), "entity")
    both = B.delta_covar(i.returns()).select("asset", F.lit("delta_covar").alias("baseline"), (-F.col("delta_covar")).alias("risk")).unionByName(
        B.tail_mean(i.returns()).select("asset", F.lit("mes").alias("baseline"), (-F.col("mes")).alias("risk")))
    return rounded(spearman(ranking.join(both, "asset"), "exported_risk", "risk", "baseline").select("baseline", "rho", "n", "p_value"))


# ---------------------------------------------------------------- several events
EVENT_RUNS = {
    "autumn-1997": ("1997-01-06", "1998-01-05", "1997-10-06", "1997-12-29"),
    "summer-1999": ("1998-09-07", "1999-09-06", "1999-06-07", "1999-08-30"),
    "too-short": ("2000-01-03", "2000-03-06", "2000-01-10", "2000-02-28"),
}
EVENT_TOP_K, EVENT_MIN_USD = 10, 1e5


def event_sql() -> dict[str, str]:
    from flowrisk.plans.oracle import collapsed, flow_series, flow_stress, keep_set

    c: dict[str, str] = {}
    for k, (start, end, e0, e1) in enumerate(EVENT_RUNS.values()):
        p = f"e{k}"
        c[f"{p}_res"] = f"SELECT * FROM flows WHERE bucket >= '{start}' AND bucket < '{end}'"
        c[f"{p}_keep"] = keep_set(f"{p}_res", EVENT_TOP_K)
        c[f"{p}_flows"] = collapsed(f"{p}_res", f"{p}_keep")
        c[f"{p}_edges"] = f"SELECT src, dst, sum(usd) AS usd FROM {p}_flows GROUP BY ALL HAVING sum(usd) >= {EVENT_MIN_USD}"
        c[f"{p}_ents"] = f"SELECT src AS entity FROM {p}_flows UNION SELECT dst FROM {p}_flows"
        c[f"{p}_series"] = flow_series(f"{p}_flows", f"{p}_ents")
        c[f"{p}_panel0"] = flow_stress(f"{p}_series", 14, 3)
        c[f"{p}_panel"] = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS pos FROM {p}_panel0"
        c[f"{p}_models"] = f"""
SELECT 'true_direction' AS model, src, dst FROM {p}_edges UNION ALL SELECT 'reversed_edges', dst, src FROM {p}_edges
UNION ALL SELECT 'symmetric', src, dst FROM (SELECT src, dst FROM {p}_edges UNION SELECT dst, src FROM {p}_edges)"""
        c |= structural_sql(f"{p}d", f"{p}_models", f"{p}_panel", f"{p}_flows", fit=f"ts < '{e0}'", event=f"ts >= '{e0}' AND ts <= '{e1}'")
    return c


def event_select(k: int, name: str, e0: str, e1: str, ok: bool) -> str:
    p = f"e{k}"
    cal = f"(SELECT DISTINCT bucket FROM {p}_flows)"
    head = f"""SELECT '{name}' AS event, {str(ok).lower()} AS ok, (SELECT count(*) FROM {cal} WHERE bucket < '{e0}') AS n_pre,
  (SELECT count(*) FROM {cal} WHERE bucket >= '{e0}' AND bucket <= '{e1}') AS n_event"""
    if not ok:
        return f"{head}, 0::BIGINT AS n_entities, 0::BIGINT AS n_edges, NULL::VARCHAR AS model, NULL::DOUBLE AS wrmse, NULL::DOUBLE AS corr, 0::BIGINT AS n"
    return f"""{head}, (SELECT count(*) FROM {p}_ents) AS n_entities, (SELECT count(*) FROM {p}_edges) AS n_edges, model, round(wrmse, 6) AS wrmse,
  round(corr, 6) + 0 AS corr, n FROM {p}d_scores"""


@query("event_runs", compose(
    "\nUNION ALL ".join(event_select(k, name, e0, e1, name != "too-short") for k, (name, (_s, _e, e0, e1)) in enumerate(EVENT_RUNS.items())),
    **event_sql()))
def _events(i: Inputs) -> DataFrame:
    rel = jobs.Relations(i.transfers(), i.tokens(), i.seed(), T.address_labels(i.spark, i.dir), i.prices(), i.entity_assets())
    runs = {
        name: jobs.Settings(fit_end=e0, event=(e0, e1), start=start, end=end, unit="week", min_volume=MIN_VOLUME, top_k=EVENT_TOP_K,
                            min_usd=EVENT_MIN_USD, roll=X.EVENT, seeds_in_panel=False)
        for name, (start, end, e0, e1) in EVENT_RUNS.items()
    }
    return rounded(jobs.events(rel, runs))
