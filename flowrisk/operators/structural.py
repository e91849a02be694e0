"""Structural equations: one regularised linear equation per entity and model.

``S(child, t) = b + sum a S(parent, t-1) + sum c log1p F(parent -> child, t) + U``

A model is a named edge set; all models are fitted by the same job.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.functions.linalg import ols_from_gram, regression_partials, ridge_from_gram, total_gram
from flowrisk.operators.slices import SLICED, own, sliced
from flowrisk.operators.joins import bounded
from flowrisk.session import write_table


def as_models(**edges: DataFrame) -> DataFrame:
    """Union of named edge sets: (model, src, dst)."""
    out = None
    for name, e in edges.items():
        part = e.select(F.lit(name).alias("model"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


def equations(models: DataFrame, panel: DataFrame, names: list[str]) -> DataFrame:
    """(model, child, parents[]) for every series of the panel; parents are series of the panel.

    Parallel edges keep their multiplicity. Bounded by models x entities.
    """
    keys = panel.select("key").distinct()
    children = keys.select(F.explode(F.array(*map(F.lit, names))).alias("model"), F.col("key").alias("child"))
    known = models.join(keys.withColumnRenamed("key", "src"), "src", "left_semi")
    par = known.groupBy("model", F.col("dst").alias("child")).agg(
        F.array_sort(F.collect_list("src")).alias("parents")
    )
    empty = F.array().cast("array<string>")
    return children.join(par, ["model", "child"], "left").withColumn("parents", F.coalesce("parents", empty))


def design(eqs: DataFrame, panel: DataFrame, flows: DataFrame, flow_lag: int = 0) -> DataFrame:
    """(model, child, parents[], ts, pos, y, xs[]), rows from the second bucket on.

    ``xs`` lists the lagged stress of the parents, then log1p of their flows to the child.
    Per timestamp the lagged stress is one bounded map, and per child and timestamp so are
    its inflows; the features are looked up by the parent list of the equation.
    """
    w = W.partitionBy(*SLICED).orderBy("ts")
    lagged = own(sliced(panel, 1).withColumns({"prev": F.lag("value").over(w), "prev_ts": F.lag("ts").over(w)}))
    past = lagged.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("key", "prev"))).alias("past"))
    inflow = flows.groupBy(F.col("dst").alias("child"), F.col("bucket").alias("flow_ts")).agg(
        F.map_from_entries(F.collect_list(F.struct("src", F.log1p("usd")))).alias("inflow")
    )
    rows = lagged.where("pos > 1").select(
        F.col("key").alias("child"), "ts", "pos", F.col("value").alias("y"),
        F.col("prev_ts" if flow_lag else "ts").alias("flow_ts"),
    )
    rows = rows.join(past, "ts").join(inflow, ["child", "flow_ts"], "left")
    zero = F.lit(0.0)
    xs = F.concat(
        F.transform("parents", lambda p: F.coalesce(F.try_element_at("past", p), zero)),
        F.transform("parents", lambda p: F.coalesce(F.try_element_at("inflow", p), zero)),
    )
    return rows.join(bounded(eqs), "child").select("model", "child", "parents", "ts", "pos", "y", xs.alias("xs"))


def _grams(rows: DataFrame) -> DataFrame:
    return rows.select("model", "child", "xs", "y").mapInPandas(
        regression_partials, "model string, child string, gram array<double>"
    )


def fit(rows: DataFrame, alpha: float = 1.0, min_rows: int = 1) -> DataFrame:
    """Ridge coefficients (model, child, parents[], w_stress[], w_flow[], b, n) of the design rows.

    Tasks add up Gram matrices; only those meet in the solve. Equations without parents or
    with fewer than ``min_rows`` rows get the mean.
    """

    def solve(key: tuple[Any, ...], parts: pd.DataFrame) -> pd.DataFrame:
        b, w, n = ridge_from_gram(total_gram(parts), alpha)
        return pd.DataFrame({"model": [key[0]], "child": [key[1]], "b": [b], "w": [w], "n": [n]})

    schema = "model string, child string, b double, w array<double>, n long"
    coef = _grams(rows).groupBy("model", "child").applyInPandas(solve, schema)
    mean = rows.groupBy("model", "child", "parents").agg(F.avg("y").alias("ybar"))
    k = F.size("parents")
    short = F.col("n") < min_rows
    zeros = F.array_repeat(F.lit(0.0), k)
    # A fit has several readers (predictions, systems, residual draws), so it is written once.
    return write_table(coef.join(mean, ["model", "child"]).select(
        "model", "child", "parents",
        F.when(short, zeros).otherwise(F.slice("w", 1, k)).alias("w_stress"),
        F.when(short, zeros).otherwise(F.slice("w", k + 1, k)).alias("w_flow"),
        F.when(short, F.col("ybar")).otherwise(F.col("b")).alias("b"),
        "n",
    ), "coef")


def coefficient_table(coef: DataFrame) -> DataFrame:
    """Long form (model, child, kind, parent, w)."""
    entries = F.concat(
        F.array(F.struct(F.lit("intercept").alias("kind"), F.lit("").alias("parent"), F.col("b").alias("w"))),
        F.zip_with("parents", "w_stress", lambda p, w: F.struct(F.lit("stress").alias("kind"), p.alias("parent"), w.alias("w"))),
        F.zip_with("parents", "w_flow", lambda p, w: F.struct(F.lit("flow").alias("kind"), p.alias("parent"), w.alias("w"))),
    )
    return coef.select("model", "child", F.inline(entries))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def predict(rows: DataFrame, coef: DataFrame) -> DataFrame:
    """Design rows with the one-step prediction ``yhat`` and the residual ``u``."""
    c = bounded(coef.select("model", "child", "b", F.concat("w_stress", "w_flow").alias("w")))
    out = rows.join(c, ["model", "child"]).withColumn("yhat", F.col("b") + dot(F.col("w"), F.col("xs")))
    return out.withColumn("u", F.col("y") - F.col("yhat")).drop("b", "w")


def residual_std(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model", "child").agg(F.coalesce(F.stddev_samp("u"), F.lit(0.0)).alias("sd"))


def scores(pred: DataFrame) -> DataFrame:
    """Per model: weighted RMSE (weight |y| + 0.1), RMSE, MAE, directional accuracy, correlation, n."""
    w, e2 = F.abs("y") + 0.1, F.pow(F.col("yhat") - F.col("y"), 2)
    varies = (F.stddev_pop("yhat") > 0) & (F.stddev_pop("y") > 0)
    return pred.groupBy("model").agg(
        F.sqrt(F.sum(w * e2) / F.sum(w)).alias("wrmse"),
        F.sqrt(F.avg(e2)).alias("rmse"),
        F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae"),
        F.avg((F.signum("yhat") == F.signum("y")).cast("double")).alias("dir_acc"),
        F.when(varies, F.corr("yhat", "y")).otherwise(0.0).alias("corr"),
        F.count("*").alias("n"),
    )


def robustness_value(t: Column, dof: Column, q: float = 1.0) -> Column:
    """Share of residual variance a confounder must explain on both sides to nullify the edge."""
    f2 = F.pow(F.lit(q) * F.abs(t), 2) / dof
    return 0.5 * (F.sqrt(f2 * f2 + 4 * f2) - f2)


def edge_sensitivity(eqs: DataFrame, panel: DataFrame) -> DataFrame:
    """(model, parent, child, coef, t_stat, robustness_value) by OLS on lagged parent stress alone."""
    empty_flows = panel.sparkSession.createDataFrame([], "bucket timestamp_ntz, src string, dst string, usd double")
    k = F.size("parents")
    rows = design(eqs.where(F.size("parents") > 0), panel, empty_flows).withColumn("xs", F.slice("xs", 1, k))

    def solve(key: tuple[Any, ...], parts: pd.DataFrame) -> pd.DataFrame:
        beta, t, dof = ols_from_gram(total_gram(parts))
        return pd.DataFrame({
            "model": [key[0]], "child": [key[1]], "beta": [beta[1:]], "t": [t[1:]], "dof": [dof],
        })

    fitted = _grams(rows).groupBy("model", "child").applyInPandas(
        solve, "model string, child string, beta array<double>, t array<double>, dof long"
    )
    entries = F.arrays_zip("parents", "beta", "t")
    return (
        fitted.join(eqs, ["model", "child"])
        .select("model", "child", "dof", F.inline(entries))
        .select(
            "model", F.col("parents").alias("parent"), "child", F.col("beta").alias("coef"),
            F.col("t").alias("t_stat"), robustness_value(F.col("t"), F.col("dof")).alias("robustness_value"),
        )
    )
