"""Windows in slices against plain ones, and several periods from one scan."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.operators import backtest as V
from flowrisk.operators import resolve as R
from flowrisk.operators import series as S
from flowrisk.operators import slices
from flowrisk.operators import stress as X
from flowrisk.plans.inputs import Inputs
from flowrisk.sources import tables as T

START = dt.datetime(2024, 2, 28, 20)


@pytest.fixture
def panel(spark):
    """Two uneven series with gaps and a series of one row."""
    rng = np.random.default_rng(5)
    rows = [("one", START, 1.0)]
    for key, n in (("a", 150), ("b", 61)):
        hours = np.cumsum(rng.choice([1, 1, 2, 40], n))
        rows += [(key, START + dt.timedelta(hours=int(h)), None if rng.random() < 0.2 else float(rng.integers(1, 50))) for h in hours]
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, value double").repartition(5)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select("key", "ts", *cols).collect())


def test_positions(spark, panel):
    want = panel.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("ts")))
    assert rows_of(slices.positions(panel), "pos") == rows_of(want, "pos")
    assert slices.positions(panel.limit(0)).count() == 0
    lost = panel.withColumn("key", F.when(F.col("key") != "b", F.col("key")))
    assert slices.positions(lost).count() == panel.where("key <> 'b'").count()


@pytest.mark.parametrize("rows", [1, 7, 10, 64, 1000])
def test_sliced_frames(panel, rows):
    s = slices.sliced(panel, 6, rows)
    assert rows_of(slices.own(s), "value") != [] and slices.own(s).count() == panel.count()
    assert s.where("NOT halo").groupBy("key", "slice").count().agg(F.max("count")).first()[0] <= max(rows, 6)
    text = lambda w: F.to_json(F.collect_list("value").over(w))
    whole, cut = S.rolling(7), S.rolling(7, *slices.SLICED)
    assert rows_of(slices.own(s.withColumn("x", text(cut))), "x") == rows_of(panel.withColumn("x", text(whole)), "x")


def test_frames_in_frames(panel):
    def z(df, w):
        return df.withColumn("m", S.rolling_mean(F.col("value"), w, 2)).withColumn("z", F.round(S.zscore(F.col("m"), w, 3), 9))

    got = slices.own(z(slices.sliced(panel, 10, 12), S.rolling(5, *slices.SLICED)))
    assert rows_of(got, "z") == rows_of(z(panel, S.rolling(5)), "z")


def test_a_calendar_numbers_the_rows_of_a_grid(panel, monkeypatch):
    times = panel.select("ts").distinct()
    full = S.on_grid(S.grid(times, panel), panel)
    got = slices.sliced(full, 5, 16, times)
    assert rows_of(got, "pos", "slice", "halo") == rows_of(slices.sliced(full, 5, 16), "pos", "slice", "halo")
    monkeypatch.setattr(slices, "SLICE_ROWS", 16)
    text = F.to_json(F.struct("value"))
    assert rows_of(slices.fill_forward(full, "value", calendar=times), text) == rows_of(slices.fill_forward(full, "value"), text)


def test_fill_forward_over_days(panel):
    past = W.partitionBy("key").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    want = panel.withColumn("value", F.last("value", ignorenulls=True).over(past))
    by_none = lambda t: (t[0], t[1], t[2] is None, t[2] or 0)
    assert sorted(map(by_none, rows_of_any(slices.fill_forward(panel, "value")))) == sorted(map(by_none, rows_of_any(want)))


def rows_of_any(df):
    return [tuple(r) for r in df.select("key", "ts", "value").collect()]


def test_var_and_returns_with_small_slices(spark, panel, monkeypatch):
    full = slices.fill_forward(panel.where("key <> 'one'"), "value").where("value IS NOT NULL").select("ts", "key", F.col("value").alias("price"))
    whole = [sorted(map(str, f.collect())) for f in (S.log_returns(full), V.rolling_var(S.log_returns(full), 9), V.backtest_var(S.log_returns(full), 9, 0.2))]
    monkeypatch.setattr(slices, "SLICE_ROWS", 11)
    cut = [sorted(map(str, f.collect())) for f in (S.log_returns(full), V.rolling_var(S.log_returns(full), 9), V.backtest_var(S.log_returns(full), 9, 0.2))]
    assert cut == whole
    p = full.where("key = 'a'").toPandas().sort_values("ts")
    r = np.log(p.price / p.price.shift()).dropna()
    got = V.rolling_var(S.log_returns(full), 9).where("key = 'a'").toPandas().sort_values("ts")
    np.testing.assert_allclose(got.value, r)
    np.testing.assert_allclose(got["var"].astype(float), r.rolling(9).quantile(0.05).shift(), rtol=1e-12)


def test_flow_stress_with_small_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(START + dt.timedelta(hours=int(h)), *rng.choice(["a", "b", "c"], 2, replace=False).tolist(), float(rng.integers(1, 99))) for h in rng.integers(0, 120, 300)]
    flows = spark.createDataFrame(pd.DataFrame(rows, columns=["bucket", "src", "dst", "usd"])).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    whole = rows_of(X.flow_stress(flows, X.flow_entities(flows), X.EVENT), F.round("value", 9))
    monkeypatch.setattr(slices, "SLICE_ROWS", 5)
    assert rows_of(X.flow_stress(flows, X.flow_entities(flows), X.EVENT), F.round("value", 9)) == whole


def test_a_long_series_is_spread(spark):
    n = 300_000
    p = spark.range(n).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 30).cast("timestamp_ntz").alias("ts"), (F.col("id") % 97).cast("double").alias("value"))
    s = slices.sliced(p, 100).withColumn("m", F.avg("value").over(S.rolling(100, *slices.SLICED)))
    sizes = [r["count"] for r in s.groupBy("slice").count().collect()]
    assert len(sizes) >= 5 and max(sizes) <= slices.SLICE_ROWS + 100
    assert slices.own(s).agg(F.count("*"), F.sum("pos")).first() == (n, n * (n + 1) // 2)


def test_periods_share_one_scan(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    book = R.address_book(i.seed(), T.address_labels(spark, "/root/testdata/sf0.001"))
    periods = {
        "late": R.Period("week", 1e4, "1997-01-01", "1998-01-01"), "overlap": R.Period("day", 0.0, "1997-06-01", "1997-09-01"),
        "none": R.Period("week", 1e4, "2050-01-01", None),
    }
    got = R.resolved_periods(i.transfers(), i.tokens(), book, periods)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    one = R.resolved_flows(i.transfers(), i.tokens(), book)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == one.count("Relation ")
    cols = ["bucket", "src", "dst", "n_tx", "src_prov", "dst_prov", F.round("usd", 3)]
    found = 0
    for name, p in periods.items():
        want = R.resolved_flows(i.transfers(), i.tokens(), book, p.unit, p.min_volume, p.start, p.end)
        rows = sorted(map(tuple, want.select(*cols).collect()))
        assert sorted(map(tuple, got.where(F.col("period") == name).select(*cols).collect())) == rows
        found += len(rows)
    assert found and got.where("period = 'none'").count() == 0
