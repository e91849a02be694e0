"""Backtests of a rolling historical value at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.functions.tails import chi2_tail_1, chi2_tail_2
from flowrisk.operators.slices import SLICED, own, sliced

EPS = 1e-12


def rolling_var(returns: DataFrame, window: int = 100, q: float = 0.05) -> DataFrame:
    """(ts, key, value, var): q-quantile of the preceding ``window`` returns; NULL before that many."""
    w = W.partitionBy(*SLICED).orderBy("ts").rowsBetween(-window, -1)
    var = F.when(F.count("value").over(w) == window, F.percentile("value", F.lit(q)).over(w))
    return own(sliced(returns.select("ts", "key", "value"), window).withColumn("var", var)).select("ts", "key", "value", "var")


def violations(var: DataFrame) -> DataFrame:
    """(ts, key, hit): returns strictly below the forecast."""
    return var.where(F.col("var").isNotNull()).select("ts", "key", (F.col("value") < F.col("var")).cast("int").alias("hit"))


def _ll(count: Column, p: Column) -> Column:
    return count * F.ln(p + EPS)


def coverage_tests(hits: DataFrame, q: float = 0.05) -> DataFrame:
    """Per key: failure rate, likelihood ratios of coverage, independence and both, with p values."""
    w = W.partitionBy(*SLICED).orderBy("ts")
    h = own(sliced(hits, 1).withColumn("prev", F.lag("hit").over(w)))

    def trans(a: int, b: int) -> Column:
        return F.count_if((F.col("prev") == a) & (F.col("hit") == b)).cast("double")

    c = h.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("hit").alias("failures"),
        trans(0, 0).alias("n00"), trans(0, 1).alias("n01"), trans(1, 0).alias("n10"), trans(1, 1).alias("n11"),
    )
    n, x = F.col("n").cast("double"), F.col("failures").cast("double")
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    zero = F.lit(0.0)
    pi01 = F.coalesce(F.try_divide(n01, n00 + n01), zero)
    pi11 = F.coalesce(F.try_divide(n11, n10 + n11), zero)
    pi = F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    rate = x / n
    lr_pof = -2 * (_ll(x, F.lit(q)) + _ll(n - x, F.lit(1 - q)) - _ll(x, rate) - _ll(n - x, 1 - rate))
    lr_ind = -2 * (
        _ll(n00 + n10, 1 - pi) + _ll(n01 + n11, pi)
        - _ll(n00, 1 - pi01) - _ll(n01, pi01) - _ll(n10, 1 - pi11) - _ll(n11, pi11)
    )
    c = c.withColumns({"rate": rate, "lr_pof": lr_pof, "lr_ind": F.when(n >= 2, lr_ind)})
    c = c.withColumn("lr_cc", F.col("lr_pof") + F.col("lr_ind"))
    return c.select(
        "key", "n", "failures", "rate", "lr_pof", chi2_tail_1(F.col("lr_pof")).alias("p_pof"),
        "lr_ind", chi2_tail_1(F.col("lr_ind")).alias("p_ind"), "lr_cc", chi2_tail_2(F.col("lr_cc")).alias("p_cc"),
    )


def backtest_var(returns: DataFrame, window: int = 100, q: float = 0.05) -> DataFrame:
    return coverage_tests(violations(rolling_var(returns, window, q)), q)
