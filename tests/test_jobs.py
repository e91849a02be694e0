"""The end-to-end jobs on the smallest dataset."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from flowrisk.operators import stress as X
from flowrisk.plans import jobs
from flowrisk.plans.inputs import Inputs
from flowrisk.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_evaluation_and_validation(spark, tmp_path):
    i = Inputs(spark, SF)
    assets = i.entity_assets()
    refs = assets.selectExpr("entity", "asset AS peg_ref", "entity AS tvl_ref", "asset AS price_ref")
    rel = jobs.Relations(
        i.transfers(), i.tokens(), i.seed(), T.address_labels(spark, SF), i.pegs(), assets.where("substr(entity, 8) < '5' AND length(entity) = 8"),
        T.seed_types(spark, SF), refs, i.tvl(), i.documented(), market="2-HIGH",
    )
    s = jobs.Settings(fit_end="2001-01-01", event=("2001-01-01", "2001-03-31"), calm=("2000-01-01", "2000-03-31"), unit="week",
                      min_volume=1e4, min_usd=3e5, roll=X.DAILY, typed=True, draws=20, var_window=100)
    e = jobs.Evaluation(rel, s)
    tables = jobs.evaluate(e) | jobs.validate(e, ["retail"], ["NATION_0", "NATION_1"])
    jobs.save_all(tables, str(tmp_path), "json")
    for name in tables:
        rows = [json.loads(x) for f in Path(tmp_path, name).glob("*.json") for x in f.read_text().splitlines()]
        assert rows, name
    placebo = tables["placebo"].first()
    assert placebo["passes"]
    assert tables["ranking"].count() == e.panel.select("key").distinct().count()


def test_robustness(spark):
    i = Inputs(spark, SF)
    rel = jobs.Relations(i.transfers(), i.tokens(), i.seed(), T.address_labels(spark, SF), i.prices(), i.entity_assets(), documented=i.documented())
    s = jobs.Settings(fit_end="2001-01-01", event=("2001-01-01", "2001-03-31"), unit="week", min_volume=1e4, min_usd=3e5, draws=10)
    e = jobs.Evaluation(rel, s)
    source, second, target = (r["entity"] for r in e.deterministic_ranking.orderBy(F.desc("exported_risk"), "entity").limit(3).collect())
    nonflow = i.entity_assets().select("entity", F.lit("drawdown").alias("kind"), "asset")
    tables = {k: df.toPandas() for k, df in jobs.robustness(e, target, [source, second], nonflow, resamples=50).items()}
    assert all(len(t) for t in tables.values())
    shap = tables["shapley"]
    assert abs(shap["shapley"].sum() - shap["total_effect"][0]) < 1e-9
    assert tables["bootstrap"]["resamples"][0] == 50
    assert set(tables["edge_types"]["model"]) == {"true", "reverse_documented", "reverse_observed"}
    assert set(tables["lagged_flow"]["model"]) == set(tables["nonflow_falsification"]["model"]) == {"true_direction", "reversed_edges", "symmetric"}
    assert "retail" not in set(tables["ranking_without_residual"]["entity"])
    assert tables["ranking_stability"]["n_copies"][0] == 25
    assert sorted(tables["latent_shock_robustness"]["strength"]) == [0.3, 0.6]
    assert tables["weak_edges_dropped"]["n_dropped"][0] >= 1
    assert 0 <= tables["attribution_sensitivity"]["frac_positive"][0] <= 1
    coverage = tables["coverage"].iloc[0]
    assert 0 <= coverage["named_both_sides"] <= coverage["touching_named"] <= 1


def test_hourly_settings_with_an_extra_peg(spark):
    i = Inputs(spark, SF)
    rel = jobs.Relations(i.transfers(), i.tokens(), i.seed(), T.address_labels(spark, SF), i.pegs(), i.entity_assets())
    s = jobs.Settings(fit_end="2001-01-01", event=("2001-01-01", "2001-03-31"), unit="week", min_volume=1e4, peg=("1-URGENT", "market_peg"))
    keys = {r["key"] for r in jobs.Evaluation(rel, s).panel.select("key").distinct().collect()}
    assert "market_peg" in keys
