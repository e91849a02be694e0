"""Validity checks: verdicts, placebo, bootstrap, external validity, ranking agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.functions.draws import hash_index
from flowrisk.functions.tails import spearman
from flowrisk.operators.joins import bounded
from flowrisk.session import write_table

TIE = 0.02


def direction_verdict(scores: DataFrame, true: str = "true_direction", other: str = "reversed_edges") -> DataFrame:
    """(gap, verdict): relative error gap of the turned graph; within two per cent it is a tie."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("wrmse")))
    g = scores.agg(((pick(other) - pick(true)) / pick(true)).alias("gap"))
    verdict = F.when(F.col("gap") > TIE, "SUPPORTED").when(F.col("gap") < -TIE, "REFUTED").otherwise("TIE")
    return g.withColumn("verdict", verdict)


def graph_verdict(scores: DataFrame, observed: str) -> DataFrame:
    """(best_estimated, gap, supported): the observed graph against the best estimated one."""
    est = F.col("model") != observed
    s = scores.agg(
        F.max(F.when(~est, F.col("wrmse"))).alias("obs"),
        F.min_by(F.when(est, F.struct("model", "wrmse")), F.when(est, F.struct("wrmse", "model"))).alias("best"),
    )
    return s.select(
        F.col("best.model").alias("best_estimated"), (F.col("best.wrmse") - F.col("obs")).alias("gap"),
        (F.col("obs") < F.col("best.wrmse")).alias("supported"),
    )


def paired_bootstrap(pred: DataFrame, a: str, b: str, resamples: int, seed: int, block: int = 1) -> DataFrame:
    """Interval of the mean weighted-error difference ``b - a`` over resampled observations.

    Positions are numbered over entities and times of the event window. Resample r draws
    position k from a hash of (seed, r, k div block); ``block`` > 1 keeps runs of
    neighbouring observations together. The differences, one number per entity and step of the window, are one list.
    """
    w = F.abs("y") + 0.1
    err = w * F.pow(F.col("yhat") - F.col("y"), 2)
    side = lambda m: F.max(F.when(F.col("model") == m, err))
    diffs = pred.groupBy("child", "ts").agg((side(b) - side(a)).alias("d")).where(F.col("d").isNotNull())
    # position = rows of earlier entities + rank within the entity
    per = diffs.groupBy("child").agg(F.count("*").alias("c"))
    before = per.select("child", (F.sum("c").over(W.orderBy("child")) - F.col("c")).alias("before"))
    d = write_table(
        diffs.join(bounded(before), "child").select(
            (F.col("before") + F.row_number().over(W.partitionBy("child").orderBy("ts")) - 1).alias("pos"), "d"
        )
    )
    # A resample is a row that looks its draws up in the list of all differences; nothing but its mean leaves the task.
    spark = pred.sparkSession
    listed = write_table(d.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]).alias("ds")), "differences")
    rows = spark.range(0, resamples, 1, spark.sparkContext.defaultParallelism).select(F.col("id").alias("r")).join(F.broadcast(listed))
    n = F.size("ds").cast("long")

    def drawn(k: Column) -> Column:
        start = hash_index(n, seed, F.col("r"), F.floor(k / block))
        return F.get("ds", F.pmod(start + k % block, n).cast("int"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0.0), lambda a, k: a + drawn(k))
    means = rows.where(n > 0).select("r", (total / n).alias("m"))
    return means.agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("m") > 0).cast("double")).alias("prob_better"), F.count("*").alias("resamples"),
    ).select(d.agg(F.avg("d")).scalar().alias("mean_diff"), "*")


def placebo(attributions: DataFrame, reach: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: absolute attributions of pairs with and without a directed path."""
    r = reach.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(True).alias("linked"))
    a = attributions.join(r, ["source", "target"], "left").withColumn("a", F.abs("attribution"))
    linked = F.coalesce("linked", F.lit(False))
    zero = F.lit(0.0)
    out = a.agg(
        F.count_if(linked).alias("n_connected"), F.count_if(~linked).alias("n_unconnected"),
        F.coalesce(F.avg(F.when(linked, F.col("a"))), zero).alias("mean_connected"),
        F.coalesce(F.avg(F.when(~linked, F.col("a"))), zero).alias("mean_unconnected"),
        F.coalesce(F.max(F.when(~linked, F.col("a"))), zero).alias("max_unconnected"),
    )
    return out.withColumn("passes", F.col("max_unconnected") < tolerance)


def temporal_placebo(attributions: DataFrame) -> DataFrame:
    """One row: mean and maximum absolute attribution over a calm window."""
    a = F.abs("attribution")
    return attributions.agg(
        F.coalesce(F.avg(a), F.lit(0.0)).alias("mean_calm"), F.coalesce(F.max(a), F.lit(0.0)).alias("max_calm")
    )


def external_validity(ranking: DataFrame, transmitters: list[str], absorbers: list[str]) -> DataFrame:
    """(separation, concordance): documented transmitters against absorbers by exported risk."""
    role = F.when(F.col("entity").isin(transmitters), "t").when(F.col("entity").isin(absorbers), "a")
    r = ranking.select("entity", "exported_risk", role.alias("role")).where(F.col("role").isNotNull())
    mean = lambda k: F.avg(F.when(F.col("role") == k, F.col("exported_risk")))
    scores = lambda k: F.collect_list(F.when(F.col("role") == k, F.col("exported_risk")))
    s = r.agg((mean("t") - mean("a")).alias("separation"), scores("t").alias("t"), scores("a").alias("a"))
    wins = F.aggregate(
        "t", F.lit(0.0), lambda acc, x: acc + F.size(F.filter("a", lambda y: x > y))
    )
    return s.select("separation", F.try_divide(wins, (F.size("t") * F.size("a")).cast("double")).alias("concordance"))


def ranking_agreement(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman of two rankings over their common entities; NULL with fewer than three."""
    out = spearman(a.join(b, "entity"), x, y)
    enough = F.col("n") >= 3
    return out.select(F.when(enough, F.col("rho")).alias("rho"), "n", F.when(enough, F.col("p_value")).alias("p_value"))


def weakest_edges(sensitivity: DataFrame) -> DataFrame:
    """(src, dst): the quarter of the edges (at least one) of lowest robustness value.

    One row per edge of the collapsed graph, so the ranking is small.
    """
    w = W.orderBy("robustness_value", "child", "parent")
    n = sensitivity.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 4)).cast("int")).scalar()
    return sensitivity.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(
        F.col("parent").alias("src"), F.col("child").alias("dst")
    )
