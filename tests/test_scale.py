"""Operators that once met in one task or one driver loop: spectra, scans, sweeps, bootstraps and quantile lines against plain versions."""

import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowrisk.functions.linalg import pinball_line
from flowrisk.operators import address as A
from flowrisk.operators import baselines as B
from flowrisk.operators import battery as Y
from flowrisk.operators import graph as G
from flowrisk.operators import stress as X
from flowrisk.session import write_table
from flowrisk.sources import tables as T


def test_spectrum_over_eight_decades(spark):
    rng = np.random.default_rng(4)
    n, dim = 40, 9
    values = np.zeros(n)
    values[:14] = 10.0 ** -np.arange(14) * np.where(np.arange(14) % 3 == 1, -1, 1)
    basis = np.linalg.qr(rng.normal(size=(n, n)))[0]
    m = basis * values @ basis.T
    i, j = np.indices(m.shape)
    rows = spark.createDataFrame(pd.DataFrame({"i": [f"a{x:02d}" for x in i.ravel()], "j": [f"a{x:02d}" for x in j.ravel()], "w": m.ravel()}))
    vectors, sigma = A.leading_eigenvectors(rows.repartition(3), dim, oversample=4)
    assert sigma == pytest.approx(np.abs(values[:dim]).tolist(), rel=1e-5)
    got = np.array([r.q for r in vectors.orderBy("addr").collect()])
    for c in range(dim):
        assert abs(got[:, c] @ basis[:, c]) == pytest.approx(abs(values[c]), rel=1e-5)


def test_orthonormal_keeps_the_width(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(30, 6)) * 10.0 ** -np.arange(0, 12, 2)
    y[:, 5] = 0.0
    table = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(y)], "addr string, q array<double>")
    q = np.array([r.q for r in A.orthonormal(table.repartition(4), 6).collect()])
    gram = q.T @ q
    assert np.linalg.matrix_rank(gram, tol=0.5) == 5 and gram.shape == (6, 6)
    assert np.sort(np.diag(gram)) == pytest.approx([0, 1, 1, 1, 1, 1], abs=1e-12)


@pytest.mark.parametrize("first", [0, 1, 3])
@pytest.mark.parametrize("n", [1, 4, 5, 9, 200])
def test_affine_scan(spark, monkeypatch, n, first):
    monkeypatch.setattr(X, "AR_BLOCK", 4)
    rng = np.random.default_rng(n)
    a, b = rng.uniform(-0.9, 1.0, n), rng.normal(size=n)
    steps = spark.createDataFrame([(first + i, float(a[i]), float(b[i])) for i in range(n)], "pos long, a double, b double")
    x, want = 0.0, []
    for i in range(n):
        x = a[i] * x + b[i]
        want.append(x)
    assert [r.x for r in X.affine_scan(steps, n).orderBy("pos").collect()] == pytest.approx(want)


def test_running_totals_by_piece_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 500, 3000) / 7
    df = spark.createDataFrame(pd.DataFrame({"score": x, "c": 1}))
    for rows in (10, 100_000):
        monkeypatch.setattr(A, "PIECE_ROWS", rows)
        got = {r["score"]: (r["c"], r["c_here"]) for r in A.running_totals(df, "score", ["c"]).collect()}
        assert got == {v: ((x >= v).sum(), (x == v).sum()) for v in np.unique(x)}
    assert A.running_totals(df.limit(0), "score", ["c"]).count() == 0


@pytest.mark.parametrize("block", [1, 4])
def test_bootstrap_draws(spark, block):
    rng = np.random.default_rng(9)
    rows = [(m, c, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t)).to_pydatetime(), float(y), float(y + rng.normal())) for c in "ab" for t in range(9) for y in [rng.normal()] for m in ("p", "q")]
    pred = spark.createDataFrame(rows, "model string, child string, ts timestamp_ntz, y double, yhat double")
    table = pd.DataFrame(rows, columns=["model", "child", "ts", "y", "yhat"])
    table["e"] = (table.y.abs() + 0.1) * (table.yhat - table.y) ** 2
    wide = table.pivot(index=["child", "ts"], columns="model", values="e").sort_index()
    d = (wide["q"] - wide["p"]).to_numpy()
    n = len(d)
    word = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16)
    means = [np.mean([d[(word(3, r, k // block) % n + k % block) % n] for k in range(n)]) for r in range(40)]
    got = Y.paired_bootstrap(pred, "p", "q", 40, 3, block).first()
    assert (got.mean_diff, got.ci_low, got.ci_high, got.resamples) == pytest.approx((d.mean(), *np.quantile(means, [0.025, 0.975]), 40))
    assert got.prob_better == pytest.approx(np.mean(np.array(means) > 0))


def loss(x, y, a, b, q):
    r = y - a - b * x
    return np.where(r >= 0, q * r, (q - 1) * r).sum()


@pytest.mark.parametrize("seed", range(12))
def test_pinball_line_with_ties(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 25))
    x, y = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float)  # many repeated and collinear points
    for q in (0.05, 0.25, 0.5, 0.9):
        a, b = pinball_line(x, y, q)
        lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i, j in itertools.combinations(range(n), 2) if x[i] != x[j]]
        best = min((loss(x, y, y[i] - s * x[i], s, q) for s, i in lines), default=loss(x, y, a, b, q))
        assert loss(x, y, a, b, q) == pytest.approx(best, abs=1e-9)


def test_quantile_regression_of_many_keys(spark):
    rng = np.random.default_rng(3)
    pdf = pd.concat([pd.DataFrame({"key": f"k{k}", "ts": range(50), "x": rng.normal(size=50), "y": rng.normal(size=50)}) for k in range(6)])
    flat = pd.DataFrame({"key": "flat", "ts": range(5), "x": 1.0, "y": [1.0, 2, 3, 4, 5]})
    table = spark.createDataFrame(pd.concat([pdf, flat]), "key string, ts long, x double, y double")
    got = {r.key: (r.a, r.b) for r in B.quantile_regression(table.union(table.limit(1).withColumn("x", F.lit(None).cast("double"))), 0.2).collect()}
    assert got["flat"] == pytest.approx((1.8, 0.0)) and len(got) == 7
    for k, (a, b) in got.items():
        own = pdf[pdf.key == k]
        x, y = own.x.to_numpy(), own.y.to_numpy()
        for i, j in itertools.combinations(range(len(own)), 2):
            s = (y[j] - y[i]) / (x[j] - x[i])
            assert loss(x, y, a, b, 0.2) <= loss(x, y, y[i] - s * x[i], s, 0.2) + 1e-9


def test_vectors_are_written_once_per_multiplication_in_blocks(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 7, "PIECE_ENTRIES": 5, "TASK_ENTRIES": 16}.items():
        monkeypatch.setattr(A, name, value, raising=False)
    written = []
    monkeypatch.setattr(A, "write_table", lambda df, name="step": written.append((name, write_table(df, name))) or written[-1][1])
    rng = np.random.default_rng(9)
    pairs = [(f"n{a}", f"n{b}", float(v)) for a, b, v in zip(*rng.integers(0, 30, size=(2, 200)), rng.uniform(1, 9, 200))]
    edges = spark.createDataFrame(pairs, "from_addr string, to_addr string, volume double")
    vectors, sigma = A.embed(edges, dim=3, oversample=27, rounds=4)
    blocks = [df.count() for name, df in written if name == "block"]
    assert len(blocks) == 1 + 2 * 4 + 1 and set(blocks) == {5}
    names = sorted({x for p in pairs for x in p[:2]})
    w = np.zeros((len(names), len(names)))
    for a, b, v in pairs:
        w[names.index(a), names.index(b)] += np.log1p(v)
        w[names.index(b), names.index(a)] += np.log1p(v)
    root = np.sqrt(w.sum(1))
    val, vec = np.linalg.eigh(w / np.outer(root, root))
    order = np.argsort(-np.abs(val))[:3]
    assert sigma == pytest.approx(np.abs(val[order]))
    got = {r.addr: r.q for r in vectors.collect()}
    assert sorted(got) == names
    assert np.abs([got[x][0] for x in names]) == pytest.approx(np.abs(vec[:, order[0]]) * sigma[0], abs=1e-6)


def test_a_large_scan_is_cut_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "TASK_ROWS", 20, raising=False)
    spark.range(0, 1000, 1, 16).select((F.col("id") % 400).alias("k"), "id").write.parquet(str(tmp_path / "t"))
    table, other = spark.read.parquet(str(tmp_path / "t")), spark.range(400).withColumnRenamed("id", "k")
    monkeypatch.setattr(type(table.rdd), "getNumPartitions", lambda rdd: 16)
    cut = T.spread(table, "k")
    monkeypatch.undo()
    assert cut.rdd.getNumPartitions() == 50
    joined = cut.join(other.hint("merge"), "k")
    assert joined.count() == 1000
    assert joined.rdd.getNumPartitions() == 50


def test_adjacency_sums_pairs_before_they_are_turned(spark, capsys):
    rows = [("x", "y", 3.0), ("y", "x", 5.0), ("x", "z", 2.0), ("z", "z", 4.0)]
    adj = G.normalized_adjacency(spark.createDataFrame(rows, "src string, dst string, volume double"))
    w = np.zeros((3, 3))
    for a, b, v in rows:
        w["xyz".index(a), "xyz".index(b)] += np.log1p(v)
        w["xyz".index(b), "xyz".index(a)] += np.log1p(v)
    want = w / np.sqrt(np.outer(w.sum(1) + 1e-9, w.sum(1) + 1e-9))
    got = adj.collect()
    assert {(r.i, r.j): pytest.approx(r.w) for r in got} == {(a, b): want["xyz".index(a), "xyz".index(b)] for a, b in ("xy", "yx", "xz", "zx", "zz")}
    assert len(got) == 5
    adj.explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.index("Generate inline") < optimized.index("Aggregate [")
