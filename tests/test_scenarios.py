"""Scenario runs on sparse systems, cut into many parts, against a plain loop."""

import numpy as np
import pytest

from flowrisk.functions.linalg import System, quantile
from flowrisk.operators import scenarios as C


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(2)
    n, steps, draws = 90, 6, 5
    dst, src = np.unique(rng.integers(0, n, (150, 2)), axis=0).T
    return {
        "n": n, "steps": steps, "dst": dst, "src": src, "val": rng.normal(size=len(dst)) * 0.4, "drive": rng.normal(size=(steps, n)) * 0.1,
        "init": rng.normal(size=n), "hi": np.abs(rng.normal(size=n)), "pre": rng.normal(size=n) * 0.1, "shocks": rng.normal(size=(draws, steps, n)) * 0.2,
    }


@pytest.fixture(scope="module")
def system(spark, world):
    w = {k: v.ravel().tolist() if isinstance(v, np.ndarray) else v for k, v in world.items()}
    keys = [f"k{i:03d}" for i in range(w["n"])]
    row = ("m", keys, w["dst"], w["src"], w["val"], w["drive"], w["init"], w["hi"], w["pre"])
    return spark.createDataFrame([row], "model string, keys array<string>, w_dst array<int>, w_src array<int>, w_val array<double>, "
                                        "drive array<double>, init array<double>, hi array<double>, pre array<double>")


def plain(world, force, shocks=None):
    w = np.zeros((world["n"], world["n"]))
    w[world["dst"], world["src"]] = world["val"]
    state, loss = world["init"].copy(), np.zeros(world["n"])
    for t in range(world["steps"]):
        state = w @ state + world["drive"][t] + (0 if shocks is None else shocks[t])
        for k, path in force.items():
            state[k] = path[t]
        loss += np.maximum(state, 0)
    return loss


def number(key):
    return int(key[1:])


@pytest.mark.parametrize("held", [1 << 22, 2000])
def test_tail_losses(spark, world, system, monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(System, "WORK", 300)
    shocks = spark.createDataFrame([("m", i, s.ravel().tolist()) for i, s in enumerate(world["shocks"])], "model string, block long, shocks array<double>")
    got = C.tail_losses(system, shocks.repartition(3)).collect()
    assert len(got) == world["n"] * (world["n"] - 1)
    hold = lambda k, v: {k: np.full(world["steps"], v)}
    for k in (0, 17, 89):
        high = np.quantile([plain(world, hold(k, world["hi"][k]), s) for s in world["shocks"]], 0.95, axis=0)
        low = np.quantile([plain(world, hold(k, 0.0), s) for s in world["shocks"]], 0.95, axis=0)
        for r in got:
            if number(r.source) == k:
                j = number(r.target)
                assert (r.tail_hi, r.tail_lo) == pytest.approx((high[j], low[j]))


def test_replays_and_coalitions(spark, world, system):
    rng = np.random.default_rng(5)
    paths = {k: rng.normal(size=world["steps"]) for k in range(0, world["n"], 2)}
    table = spark.createDataFrame([(f"k{k:03d}", p.tolist()) for k, p in paths.items()], "key string, path array<double>")
    shock = world["shocks"][0]
    shocks = spark.createDataFrame([("m", shock.ravel().tolist())], "model string, shocks array<double>")
    got = C.attribution(system, table, shocks).collect()
    assert len(got) == len(paths) * (world["n"] - 1)  # sources without a path are left out
    level = lambda k: np.full(world["steps"], world["pre"][k])
    replay, counter = plain(world, {4: paths[4]}, shock), plain(world, {4: level(4)}, shock)
    for r in got:
        if r.source == "k004":
            assert (r.loss_replay, r.loss_counterfactual) == pytest.approx((replay[number(r.target)], counter[number(r.target)]))
    assert C.attribution(system, table, shocks, ["k006"]).select("source").distinct().count() == 1
    players = [8, 2, 30]
    losses = {r.coalition: r.loss for r in C.coalition_losses(system, table, shocks, "k005", [f"k{p:03d}" for p in players]).collect()}
    assert len(losses) == 8
    for c, loss in losses.items():
        force = {k: level(k) for k in range(world["n"]) if k != 5} | {p: paths[p] for b, p in enumerate(players) if c >> b & 1}
        assert loss == pytest.approx(plain(world, force, shock)[5])


def test_quantile_interpolates():
    x = np.random.default_rng(1).normal(size=(21, 3))
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert quantile(x, q) == pytest.approx(np.quantile(x, q, axis=0))
