"""Blocked dense algebra and the estimates on it against numpy, with tiles small enough that every product crosses blocks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowrisk.functions.tails import t_two_sided
from flowrisk.operators import baselines as B
from flowrisk.operators import dense as D
from flowrisk.operators import series as S


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(D, "TILE", 4)
    monkeypatch.setattr(D, "STEPS", 16)
    monkeypatch.setattr(D, "HELD", 2)


def returns(keys, steps, seed, same=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(steps, keys)) * 0.02
    x[1:] += 0.3 * np.roll(x[:-1], 1, axis=1)
    if same:
        x[:, same[1]] = x[:, same[0]]
    return x


def panel(spark, x):
    steps, keys = x.shape
    pdf = pd.DataFrame({
        "ts": np.repeat(pd.date_range("2024-01-01", periods=steps, freq="h").values.astype("datetime64[us]"), keys),
        "key": np.tile([f"k{j:03d}" for j in range(keys)], steps), "value": x.ravel(),
    })
    return spark.createDataFrame(pdf, "ts timestamp_ntz, key string, value double")


def number(key):
    return int(key[1:])


@pytest.mark.parametrize(("keys", "steps", "same"), [(11, 60, None), (11, 60, (2, 9)), (9, 60, (0, 1)), (4, 30, None), (1, 9, None)])
def test_partial_correlations(spark, keys, steps, same):
    x = returns(keys, steps, keys, same)
    p = np.linalg.pinv(np.atleast_2d(np.cov(x, rowvar=False)))
    d = np.sqrt(np.diag(p))
    expected = -p / np.outer(d, d)
    got = {(number(r.src), number(r.dst)): r.pcorr for r in B.partial_correlations(panel(spark, x)).collect()}
    assert len(got) == keys * (keys - 1)
    assert all(v == pytest.approx(expected[b, a], abs=1e-9) for (a, b), v in got.items())


def test_partial_correlations_need_observations(spark):
    assert B.partial_correlations(panel(spark, returns(6, 7, 1))).count() == 0
    assert B.partial_correlations(panel(spark, returns(3, 9, 1)).limit(0)).count() == 0


def test_granger(spark):
    x = returns(10, 50, 3, (2, 7))

    def t_statistic(i, j):
        y = x[1:, j]
        design = np.column_stack([np.ones(len(y)), x[:-1, j], x[:-1, i]])
        inverse = np.linalg.pinv(design.T @ design)
        beta = inverse @ design.T @ y
        error = y - design @ beta
        return beta[2] / np.sqrt(max(inverse[2, 2] * (error @ error) / (len(y) - 3), 1e-18))

    got = B.granger_tests(panel(spark, x)).collect()
    assert len(got) == 90 and {r.n for r in got} == {49}
    for r in got:
        assert r.t_stat == pytest.approx(t_statistic(number(r.src), number(r.dst)), rel=1e-8)
    assert B.granger_graph(panel(spark, x[:15])).count() == 0


def test_covariance_in_tiles(spark):
    x = returns(9, 40, 5)
    c, rho = np.cov(x, rowvar=False), np.corrcoef(x, rowvar=False)
    got = S.covariance(panel(spark, x)).collect()
    assert len(got) == 81
    for r in got:
        assert r["cov"] == pytest.approx(c[number(r.i), number(r.j)], abs=1e-14)
        assert r["corr"] == pytest.approx(rho[number(r.i), number(r.j)], abs=1e-12)


def finite_sum(t, n):
    """P(|T| > t) for whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(n))
    c, s = math.cos(theta), math.sin(theta)
    term = total = 1.0 if n % 2 == 0 else (c if n > 1 else 0.0)
    for k in range(1, (n - 2) // 2 + 1 if n % 2 == 0 else (n - 3) // 2 + 1):
        term *= ((2 * k - 1) / (2 * k) if n % 2 == 0 else 2 * k / (2 * k + 1)) * c * c
        total += term
    return 1 - s * total if n % 2 == 0 else 1 - 2 / math.pi * (theta + s * total)


def test_t_tail(spark):
    rows = [(t, n) for t in (0.0, 0.1, 0.5, 1.0, 1.7, 1.74, 2.0, 3.0, 7.0, 40.0) for n in (1, 2, 3, 8, 31, 200, 5001)]
    tail = t_two_sided(F.col("t"), F.col("n")).alias("p")
    for r in spark.createDataFrame(rows, "t double, n int").select("t", "n", tail).collect():
        assert r.p == pytest.approx(finite_sum(r.t, r.n), abs=1e-12)
    # With many degrees of freedom Student's t is normal.
    for r in spark.createDataFrame([(t, 1_000_000_000) for t in (0.3, 1.7, 1.8, 4.0, -4.0)], "t double, n int").select("t", tail).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), rel=1e-6)
    odd = spark.createDataFrame([(float("inf"), 5), (float("nan"), 5), (None, 5)], "t double, n int").select(tail).collect()
    assert odd[0].p == 0 and math.isnan(odd[1].p) and odd[2].p is None
