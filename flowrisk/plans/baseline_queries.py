"""Price-based baselines and VaR backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowrisk.functions.output import rounded
from flowrisk.functions.tails import spearman
from flowrisk.operators import backtest as V
from flowrisk.operators import baselines as B
from flowrisk.operators import graph as G
from flowrisk.operators import series as S
from flowrisk.plans.inputs import Inputs
from flowrisk.plans.oracle import CTES, complete, compose
from flowrisk.plans.queries import query

CTES["sys"] = """
SELECT r.ts, r.key, r.value, (t.total - r.value) / (t.n - 1) AS sys
FROM week_complete r JOIN (SELECT ts, sum(value) AS total, count(*) AS n FROM week_complete GROUP BY ts) t ON r.ts = t.ts"""
CTES["mes"] = """
SELECT s.key AS asset, avg(value) AS mes FROM sys s JOIN (SELECT key, quantile_cont(sys, 0.05) AS cut FROM sys GROUP BY key) c ON s.key = c.key
WHERE sys <= cut GROUP BY s.key"""


@query("tail_mean_returns", compose("SELECT asset, round(mes, 6) AS mes, rank() OVER (ORDER BY mes) AS rank FROM mes"))
def _mes(i: Inputs) -> DataFrame:
    return rounded(B.tail_mean(i.returns(), 0.05))


# Every line through two points is a candidate; the one of least pinball loss is the regression.
CTES["qr_line"] = """
SELECT p.key, (r.sys - p.sys) / (r.value - p.value) AS b, p.sys - (r.sys - p.sys) / (r.value - p.value) * p.value AS a
FROM sys p JOIN sys r ON p.key = r.key AND p.ts < r.ts AND p.value <> r.value"""
CTES["qr"] = """
SELECT key, min_by(a, loss) AS a, min_by(b, loss) AS b
FROM (SELECT l.key, a, b, sum(CASE WHEN sys >= a + b * value THEN 0.05e0 * (sys - a - b * value) ELSE 0.95e0 * (a + b * value - sys) END) AS loss
  FROM qr_line l JOIN sys s ON l.key = s.key GROUP BY l.key, a, b) GROUP BY key"""
CTES["dcv"] = """
SELECT v.key AS asset, v.q05 AS var_q, a + b * v.q05 AS covar_q, b * (v.q05 - v.q50) AS delta_covar
FROM (SELECT key, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50 FROM sys GROUP BY key) v JOIN qr ON qr.key = v.key"""


@query("delta_covar", compose("""
SELECT asset, round(var_q, 6) AS var_q, round(covar_q, 6) AS covar_q, round(delta_covar, 6) AS delta_covar,
  rank() OVER (ORDER BY delta_covar) AS rank FROM dcv"""))
def _delta_covar(i: Inputs) -> DataFrame:
    return rounded(B.delta_covar(i.returns(), q=0.05))


# Over hours the pairs are too many. The loss of the best line of a given slope is convex in the slope, so the slope is closed in on.
CTES["hour_complete"] = complete("hour_returns")
CTES["hour_sys"] = """
SELECT r.ts, r.key, r.value, (t.total - r.value) / (t.n - 1) AS sys
FROM hour_complete r JOIN (SELECT ts, sum(value) AS total, count(*) AS n FROM hour_complete GROUP BY ts) t ON r.ts = t.ts"""


def slope_sql(points: str, q: float, reach: float = 100.0, rounds: int = 110) -> str:
    """(key, a, b) of least pinball loss of ``sys`` on ``value``, by thirds of the slopes within ``reach``."""
    rest = lambda b: f"list_sort(list_transform(y, lambda v, i: v - ({b}) * x[i]))"
    loss = lambda r, a: f"list_sum(list_transform({r}, lambda v: CASE WHEN v >= {a} THEN {q}e0 * (v - {a}) ELSE {q - 1}e0 * (v - {a}) END))"
    at = f"ceil({q}e0 * len(y))::INT"
    return f"""
WITH RECURSIVE s(key, x, y, lo, hi, k) AS (
  SELECT key, list(value ORDER BY ts), list(sys ORDER BY ts), -{reach}e0, {reach}e0, 0 FROM {points} GROUP BY key
  UNION ALL
  SELECT key, x, y, CASE WHEN f1 > f2 THEN m1 ELSE lo END, CASE WHEN f1 > f2 THEN hi ELSE m2 END, k + 1 FROM (
    SELECT *, {loss('r1', 'a1')} AS f1, {loss('r2', 'a2')} AS f2 FROM (
      SELECT *, r1[{at}] AS a1, r2[{at}] AS a2 FROM (
        SELECT *, {rest('m1')} AS r1, {rest('m2')} AS r2 FROM (
          SELECT *, lo + (hi - lo) / 3 AS m1, hi - (hi - lo) / 3 AS m2 FROM s WHERE k < {rounds})))))
SELECT key, b, ({rest('b')})[{at}] AS a FROM (SELECT *, (lo + hi) / 2 AS b FROM s WHERE k = {rounds})"""


CTES["hour_qr"] = slope_sql("hour_sys", 0.05)
CTES["hour_dcv"] = """
SELECT v.key AS asset, v.q05 AS var_q, a + b * v.q05 AS covar_q, b * (v.q05 - v.q50) AS delta_covar
FROM (SELECT key, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50 FROM hour_sys GROUP BY key) v JOIN hour_qr qr ON qr.key = v.key"""


@query("delta_covar_hourly", compose("""
SELECT asset, round(var_q, 6) AS var_q, round(covar_q, 6) AS covar_q, round(delta_covar, 6) AS delta_covar,
  rank() OVER (ORDER BY delta_covar) AS rank FROM hour_dcv"""))
def _delta_covar_hourly(i: Inputs) -> DataFrame:
    return rounded(B.delta_covar(S.log_returns(S.price_panel(i.quotes())), q=0.05))


CTES["moments"] = """
SELECT x.key AS i, y.key AS j, count(*) AS n, covar_samp(x.value, y.value) AS cov, corr(x.value, y.value) AS corr
FROM week_complete x JOIN week_complete y ON x.ts = y.ts GROUP BY 1, 2"""


@query("covariance_matrix", compose("SELECT i, j, n, round(cov, 8) + 0 AS cov, round(corr, 6) + 0 AS corr FROM moments"))
def _covariance(i: Inputs) -> DataFrame:
    return rounded(S.covariance(i.returns()), 6, cov=8)


@query("correlation_graph", compose("SELECT i AS src, j AS dst, round(abs(corr), 6) AS weight FROM moments WHERE i <> j AND abs(corr) >= 0.05"))
def _correlation(i: Inputs) -> DataFrame:
    return rounded(B.correlation_graph(i.returns(), 0.05))


CTES["lagged"] = """
SELECT * FROM (SELECT ts, key, value, lag(value) OVER (PARTITION BY key ORDER BY ts) AS prev FROM week_complete) WHERE prev IS NOT NULL"""


def t_tail_sql(t: str, dof: str) -> str:
    """P(|T| > |t|) by the finite sums for whole degrees of freedom, terms from log-gamma."""
    c2 = f"({dof} / ({dof} + {t} * {t}))"
    s = f"(abs({t}) / sqrt({dof} + {t} * {t}))"
    even = f"{s} * list_sum(list_transform(range(0, greatest(({dof})::BIGINT // 2, 0)), lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1e0) - 0.5e0 * ln(pi()) + k * ln({c2}))))"
    odd = (
        f"2 / pi() * (atan(abs({t}) / sqrt({dof})) + {s} * coalesce(list_sum(list_transform(range(0, greatest((({dof})::BIGINT - 1) // 2, 0)), "
        f"lambda k: exp(lgamma(k + 1e0) - lgamma(k + 1.5e0) + lgamma(1.5e0) + (2 * k + 1) * 0.5e0 * ln({c2})))), 0))"
    )
    return f"(1 - CASE WHEN ({dof})::BIGINT % 2 = 0 THEN {even} ELSE {odd} END)"


CTES["granger_m"] = """
SELECT a.key AS src, b.key AS dst, count(*) AS n, (count(*) - 1) * var_samp(b.prev) AS s11, (count(*) - 1) * var_samp(a.prev) AS s22,
  (count(*) - 1) * covar_samp(a.prev, b.prev) AS s12, (count(*) - 1) * covar_samp(b.prev, b.value) AS s1y,
  (count(*) - 1) * covar_samp(a.prev, b.value) AS s2y, (count(*) - 1) * var_samp(b.value) AS syy
FROM lagged a JOIN lagged b ON a.ts = b.ts AND a.key <> b.key GROUP BY 1, 2"""
CTES["granger"] = f"""
WITH b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (n - 3)::DOUBLE AS dof, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM granger_m),
t AS (SELECT *, b2 / sqrt((syy - b1 * s1y - b2 * s2y) / dof * s11 / det) AS t FROM b)
SELECT src, dst, n, dof::BIGINT AS dof, t AS t_stat, {t_tail_sql('t', 'dof')} AS p_value FROM t"""


@query("granger_tests", compose("SELECT src, dst, round(t_stat, 6) AS t_stat, dof, round(p_value, 6) AS p_value, n FROM granger"))
def _granger_tests(i: Inputs) -> DataFrame:
    return rounded(B.granger_tests(i.returns()))


@query("granger_graph", compose("SELECT src, dst, round(p_value, 6) AS p_value FROM granger WHERE p_value < 0.3"))
def _granger(i: Inputs) -> DataFrame:
    return rounded(B.granger_graph(i.returns(), alpha=0.3))


def solve_sql(table: str, by: str, size: str) -> str:
    """Gauss-Jordan elimination on ``table(by, m)``, ``m`` a list of rows; gives the reduced matrix."""
    return f"""
WITH RECURSIVE gj({by}, p, m, k) AS (SELECT {by}, 1, m, {size} FROM {table}
  UNION ALL SELECT {by}, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v: v / m[p][p])
    ELSE list_transform(r, lambda v, c: v - r[p] / m[p][p] * m[p][c]) END), k FROM gj WHERE p <= k)
SELECT {by}, m FROM gj WHERE p = k + 1"""


CTES["prec_in"] = """
WITH rows AS (SELECT i, list(cov ORDER BY j) AS r, row_number() OVER (ORDER BY i) AS pos FROM moments GROUP BY i),
n AS (SELECT count(*) AS n FROM rows)
SELECT 1 AS g, list(list_concat(r, list_transform(range(1, n + 1), lambda c: CASE WHEN c = pos THEN 1e0 ELSE 0e0 END)) ORDER BY i) AS m,
  list(i ORDER BY i) AS names, any_value(n) AS n FROM rows, n"""
CTES["prec"] = solve_sql("prec_in", "g, names, n", "n")
CTES["pcorr"] = """
SELECT names[b] AS src, names[a] AS dst, -m[a][n + b] / sqrt(m[a][n + a] * m[b][n + b]) AS pcorr
FROM prec, range(1, n + 1) x(a), range(1, n + 1) y(b) WHERE a <> b"""


@query("partial_correlations", compose("SELECT src, dst, round(pcorr, 6) + 0 AS pcorr FROM pcorr"))
def _pcorr(i: Inputs) -> DataFrame:
    return rounded(B.partial_correlations(i.returns()))


@query("partial_correlation_graph", compose("SELECT src, dst, round(pcorr, 6) AS pcorr FROM pcorr WHERE abs(pcorr) >= 0.05"))
def _pcorr_graph(i: Inputs) -> DataFrame:
    return rounded(B.partial_correlation_graph(i.returns(), 0.05))


@query("entity_return_panel", compose("SELECT ts, entity AS key, round(value, 6) + 0 AS value FROM week_complete JOIN entity_asset ON asset = key"))
def _entity_returns(i: Inputs) -> DataFrame:
    return rounded(G.mapped_returns(i.returns(), i.entity_assets()))


CTES["var_week"] = """
SELECT ts, key, value, CASE WHEN count(*) OVER w = 100 THEN quantile_cont(value, 0.05) OVER w END AS var FROM week_returns
WINDOW w AS (PARTITION BY key ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"""
CTES["var_hour"] = """
SELECT ts, key, value, CASE WHEN count(*) OVER w = 72 THEN quantile_cont(value, 0.05) OVER w END AS var FROM hour_returns
WINDOW w AS (PARTITION BY key ORDER BY ts ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)"""


@query("rolling_var", compose("SELECT ts, key, round(value, 6) + 0 AS value, round(var, 6) + 0 AS var FROM var_week"))
def _rolling_var(i: Inputs) -> DataFrame:
    return rounded(V.rolling_var(i.returns(), 100, 0.05))


def chi1_tail_sql(x: str) -> str:
    h = f"(greatest({x}, 0) / 2)"
    return (
        f"greatest(1 - 2 / sqrt(pi()) * exp(-{h}) * CASE WHEN {h} = 0 THEN 0 ELSE list_sum(list_transform(range(0, 251), "
        f"lambda n: exp((n + 0.5e0) * ln({h}) + lgamma(1.5e0) - lgamma(n + 1.5e0)))) END, 0)"
    )


def backtest_sql(var: str, q: float) -> str:
    ll = lambda n, p: f"({n}) * ln({p} + 1e-12)"
    return f"""
WITH h AS (SELECT key, ts, (value < var)::INT AS hit FROM {var} WHERE var IS NOT NULL),
p AS (SELECT *, lag(hit) OVER (PARTITION BY key ORDER BY ts) AS prev FROM h),
c AS (SELECT key, count(*) AS n, sum(hit)::BIGINT AS failures, count(*) FILTER (prev = 0 AND hit = 0) AS n00,
  count(*) FILTER (prev = 0 AND hit = 1) AS n01, count(*) FILTER (prev = 1 AND hit = 0) AS n10, count(*) FILTER (prev = 1 AND hit = 1) AS n11 FROM p GROUP BY key),
d AS (SELECT *, failures / n AS rate, coalesce(n01 / nullif(n00 + n01, 0), 0) AS pi01, coalesce(n11 / nullif(n10 + n11, 0), 0) AS pi11,
  (n01 + n11) / (n00 + n01 + n10 + n11) AS pi_ FROM c),
l AS (SELECT *, -2 * ({ll('failures', q)} + {ll('n - failures', 1 - q)} - {ll('failures', 'rate')} - {ll('n - failures', '1 - rate')}) AS lr_pof,
  -2 * ({ll('n00 + n10', '1 - pi_')} + {ll('n01 + n11', 'pi_')} - {ll('n00', '1 - pi01')} - {ll('n01', 'pi01')} - {ll('n10', '1 - pi11')} - {ll('n11', 'pi11')}) AS lr_ind FROM d)
SELECT key, n, failures, round(rate, 6) AS rate, round(lr_pof, 6) + 0 AS lr_pof, round({chi1_tail_sql('lr_pof')}, 6) AS p_pof,
  round(lr_ind, 6) + 0 AS lr_ind, round({chi1_tail_sql('lr_ind')}, 6) AS p_ind, round(lr_pof + lr_ind, 6) + 0 AS lr_cc,
  round(exp(-greatest(lr_pof + lr_ind, 0) / 2), 6) AS p_cc FROM l"""


@query("var_backtest", compose(backtest_sql("var_week", 0.05)))
def _backtest(i: Inputs) -> DataFrame:
    return rounded(V.backtest_var(i.returns(), 100, 0.05))


@query("var_backtest_hourly", compose(backtest_sql("var_hour", 0.05)))
def _backtest_hourly(i: Inputs) -> DataFrame:
    return rounded(V.backtest_var(S.log_returns(S.price_panel(i.quotes())), 72, 0.05))


def spearman_sql(pairs: str, x: str, y: str, by: str = "") -> str:
    """Average ranks, their correlation and its p value; ``by`` names the group columns."""
    part = f"PARTITION BY {by} " if by else ""
    rank = lambda c: (
        f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2e0"
    )
    head = f"{by}, " if by else ""
    return f"SELECT {head}corr(rx, ry) AS rho, count(*) AS n FROM (SELECT *, {rank(x)} AS rx, {rank(y)} AS ry FROM {pairs}) {'GROUP BY ' + by if by else ''}"


@query("baseline_rank_agreement", compose(f"""
SELECT round(rho, 6) AS rho, n, round({t_tail_sql('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)::DOUBLE')}, 6) AS p_value
FROM ({spearman_sql('(SELECT delta_covar, mes FROM dcv JOIN mes ON dcv.asset = mes.asset)', 'delta_covar', 'mes')})"""))
def _rank_agreement(i: Inputs) -> DataFrame:
    pairs = B.delta_covar(i.returns()).join(B.tail_mean(i.returns()).select("asset", "mes"), "asset")
    return rounded(spearman(pairs, "delta_covar", "mes"))


