"""Distribution tails and rank statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _series(first: Column, ratio, terms: Column | int) -> Column:
    """``sum t_k`` for k = 0 .. terms, where t_0 = first and t_k = t_(k-1) * ratio(k)."""
    n = terms if isinstance(terms, Column) else F.lit(terms)
    ks = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc: Column, k: Column) -> Column:
        t = acc["t"] * ratio(k.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.aggregate(ks, start, step, lambda acc: acc["s"])


def chi2_tail_1(x: Column) -> Column:
    """P(chi-square with 1 df > x): up to 4 by the all-positive series of the error function, beyond by the
    continued fraction of its complement. Both have converged to double precision after these terms."""
    z2 = F.greatest(x, F.lit(0.0)) / 2
    near = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-z2) * _series(F.sqrt(z2), lambda k: 2 * z2 / (2 * k + 1), 40)
    z = F.sqrt(F.greatest(z2, F.lit(2.0)))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda d, k: z + k / 2 / d)
    return F.when(x <= 4, near).otherwise(F.exp(-z2) / (math.sqrt(math.pi) * fraction))


def chi2_tail_2(x: Column) -> Column:
    """P(chi-square with 2 df > x)."""
    return F.exp(-F.greatest(x, F.lit(0.0)) / 2)


# Coefficients of 1/z, 1/z^3, ... in ln(gamma(z + 1/2) / gamma(z)) - ln(z) / 2.
_HALF_STEP = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432, 691 / 180224)
#: Steps up from which that series is exact to double precision; depth at which the continued fraction has converged for any degrees of freedom.
_SHIFT, _DEPTH = 20, 120


def _ln_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for positive ``a``."""
    z = a + _SHIFT
    series = sum((c / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(_HALF_STEP)), F.ln(z) / 2)
    down = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1.0), lambda p, i: p * (a + i) / (a + i + 0.5))
    return series + F.ln(down)


def _beta_fraction(a: Column | float, b: Column | float, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its far end."""

    def step(v: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / v

    return 1 / F.aggregate(F.sequence(F.lit(_DEPTH), F.lit(1), F.lit(-1)), F.lit(1.0), step)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for Student's t, by the incomplete beta function; the cost does not depend on the degrees of freedom.

    Near the middle the complement is taken, where its fraction converges fast.
    """
    nu = dof.cast("double")
    a, t2 = nu / 2, t * t
    y = t2 / (nu + t2)
    front = F.exp(_ln_half_step(a) - math.log(math.pi) / 2 - a * F.log1p(t2 / nu)) * F.sqrt(y)
    near = 1 - 2 * front * _beta_fraction(0.5, a, y)
    far = front * _beta_fraction(a, 0.5, nu / (nu + t2)) / a
    return F.when(F.isnan(t), t).when(t2 == float("inf"), 0.0).when(t2 < 3, F.greatest(near, F.lit(0.0))).otherwise(far)


def average_rank(col: str, *by: str) -> Column:
    """Rank with ties averaged, within groups of bounded size."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(col)) + (F.count("*").over(W.partitionBy(*by, col)) - 1) / 2.0


def spearman(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Per group: rank correlation ``rho``, its t-based ``p_value`` and the number of pairs.

    Groups are entity rankings, so they are small.
    """
    ranked = pairs.withColumns({"_rx": average_rank(x, *by), "_ry": average_rank(y, *by)})
    rho, n = F.col("rho"), F.col("n")
    t = rho * F.sqrt((n - 2) / F.nullif(1 - rho * rho, F.lit(0.0)))
    return (
        ranked.groupBy(*by)
        .agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
        .withColumn("p_value", F.when(n > 2, F.coalesce(t_two_sided(t, n - 2), F.lit(0.0))))
    )
