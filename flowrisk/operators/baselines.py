"""Price-based baselines: conditional quantile measures and estimated contagion graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.functions.linalg import pinball_lines
from flowrisk.functions.tails import t_two_sided
from flowrisk.operators.dense import column_sums, entries, numbered, products, pseudo_inverse, tiles
from flowrisk.operators.joins import bounded
from flowrisk.operators.series import complete_cases, covariance
from flowrisk.operators.slices import SLICED, own, sliced
from flowrisk.session import write_table


def with_system(returns: DataFrame, system: str | None = None) -> DataFrame:
    """Complete returns with ``sys``: the mean of the other assets, or one named asset."""
    at_ts = W.partitionBy("ts")  # one row per asset
    r = complete_cases(returns).withColumns({
        "total": F.sum("value").over(at_ts), "n": F.count("*").over(at_ts),
        "named": F.max(F.when(F.col("key") == F.lit(system), F.col("value"))).over(at_ts),
    })
    sys = F.try_divide(F.col("total") - F.col("value"), F.col("n") - 1) if system is None else F.col("named")
    return r.where("n > 1").select("ts", "key", "value", sys.alias("sys"))


def tail_mean(returns: DataFrame, q: float = 0.05) -> DataFrame:
    """(asset, mes, rank): mean return where the rest of the system is in its q-tail."""
    r = with_system(returns)
    cut = r.groupBy("key").agg(F.percentile("sys", F.lit(q)).alias("cut"))
    m = r.join(bounded(cut), "key").groupBy(F.col("key").alias("asset")).agg(
        F.avg(F.when(F.col("sys") <= F.col("cut"), F.col("value"))).alias("mes")
    )
    return m.withColumn("rank", F.rank().over(W.orderBy("mes")))


def quantile_regression(data: DataFrame, q: float) -> DataFrame:
    """(key, a, b): the line minimising the pinball loss of ``y`` on ``x``, for every key of ``data(key, ts, x, y)``.

    One job: a key's points, two numbers per time step, are fitted in the task that gets them, and keys spread over tasks.
    Points that tie are tried one by one, so the walk always ends at an optimum; rows with a null are left out.
    """
    points = data.where("x is not null and y is not null").select("key", "ts", "x", "y")
    return points.groupBy("key").applyInPandas(pinball_lines(q), "key string, a double, b double")


def delta_covar(returns: DataFrame, system: str | None = None, q: float = 0.05) -> DataFrame:
    """(asset, var_q, covar_q, delta_covar, rank): conditional quantile of the system given each asset."""
    r = write_table(with_system(returns, system), "system")
    line = quantile_regression(r.select("key", "ts", F.col("value").alias("x"), F.col("sys").alias("y")), q)
    var = r.groupBy("key").agg(
        F.percentile("value", F.lit(q)).alias("var_q"), F.percentile("value", F.lit(0.5)).alias("var_50")
    )
    out = var.join(bounded(line), "key").select(
        F.col("key").alias("asset"), "var_q", (F.col("a") + F.col("b") * F.col("var_q")).alias("covar_q"),
        (F.col("b") * (F.col("var_q") - F.col("var_50"))).alias("delta_covar"),
    )
    return out.withColumn("rank", F.rank().over(W.orderBy("delta_covar")))


def correlation_graph(returns: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(src, dst, weight): pairs whose absolute correlation reaches the threshold, both orientations."""
    return (
        covariance(returns)
        .where((F.col("i") != F.col("j")) & (F.abs("corr") >= threshold))
        .select(F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("corr").alias("weight"))
    )


def granger_tests(returns: DataFrame) -> DataFrame:
    """(src, dst, t_stat, dof, p_value, n) of ``r_dst(t) ~ 1 + r_dst(t-1) + r_src(t-1)`` for ordered pairs.

    The products of two lagged series, and of a lagged and a current one, are added up tile by tile and stay rows (src, dst); sums of
    single series join them by key. Each 3x3 system is then solved in closed form on the centred moments.
    """
    w = W.partitionBy(*SLICED).orderBy("ts")
    both = own(sliced(complete_cases(returns), 1).withColumn("lagged", F.lag("value").over(w))).where(F.col("lagged").isNotNull())
    both = write_table(both.select("ts", "key", "value", "lagged"), "lagged")
    x, y = F.col("lagged"), F.col("value")
    single = write_table(column_sums(both, {"x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}), "sums")
    pairs = products(both, numbered(single), [("lagged", "lagged"), ("lagged", "value")])
    of = lambda side, names: single.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names])
    g = pairs.withColumnsRenamed({"i": "src", "j": "dst"}).where("src <> dst")
    g = g.join(of("dst", ["n", "x", "y", "xx", "xy", "yy"]), "dst").join(of("src", ["x", "xx"]), "src")

    def centred(product: str, a: str, b: str) -> Column:
        return F.col(product) - F.col(a) * F.col(b) / F.col("dst_n")

    g = g.select(
        "src", "dst", F.col("dst_n").alias("n"), centred("dst_xx", "dst_x", "dst_x").alias("s11"), centred("src_xx", "src_x", "src_x").alias("s22"),
        centred("p0", "src_x", "dst_x").alias("s12"), centred("dst_xy", "dst_x", "dst_y").alias("s1y"),
        centred("p1", "src_x", "dst_y").alias("s2y"), centred("dst_yy", "dst_y", "dst_y").alias("syy"),
    )
    s11, s22, s12, s1y, s2y = (F.col(c) for c in ("s11", "s22", "s12", "s1y", "s2y"))
    det = s11 * s22 - s12 * s12
    # Two entities may share an asset. With collinear regressors the minimum-norm solution has
    # the t statistic of the single regressor.
    collinear = det <= 1e-10 * s11 * s22
    g = g.withColumns({
        "b1": F.when(collinear, F.try_divide(s1y, s11)).otherwise(F.try_divide(s22 * s1y - s12 * s2y, det)),
        "b2": F.when(~collinear, F.try_divide(s11 * s2y - s12 * s1y, det)).otherwise(0.0),
        "dof": F.greatest(F.col("n") - 3, F.lit(1)),
    })
    s2 = (F.col("syy") - F.col("b1") * s1y - F.col("b2") * s2y) / F.col("dof")
    se = F.sqrt(F.greatest(s2 * F.try_divide(s11, det), F.lit(1e-18)))
    single_t = F.signum(s12) * F.col("b1") / F.sqrt(F.greatest(F.try_divide(s2, s11), F.lit(1e-18)))
    g = g.withColumn("t_stat", F.when(collinear, single_t).otherwise(F.col("b2") / se))
    return g.select("src", "dst", "t_stat", "dof", t_two_sided(F.col("t_stat"), F.col("dof")).alias("p_value"), "n")


def granger_graph(returns: DataFrame, alpha: float = 0.10, min_obs: int = 20) -> DataFrame:
    """(src, dst, p_value): significant pairs; none with fewer than ``min_obs`` observations."""
    return granger_tests(returns).where((F.col("n") + 1 >= min_obs) & (F.col("p_value") < alpha)).select(
        "src", "dst", "p_value"
    )


def partial_correlations(returns: DataFrame) -> DataFrame:
    """(src, dst, pcorr) of all ordered pairs, from the pseudo-inverse of the covariance matrix; none with fewer than two more observations than assets.

    Matrix and inverse are tables of tiles. A series without variance has no partial correlation (null).
    """
    cov = write_table(covariance(returns), "covariance")
    keys = numbered(cov.select(F.col("i").alias("key")))
    size = keys.count()
    cov = cov.where(F.col("n") >= size + 2)
    if cov.isEmpty():
        return returns.sparkSession.createDataFrame([], "src string, dst string, pcorr double")
    by = lambda side: keys.select(F.col("key").alias(side), F.col("k").alias(f"k{side}"))
    inverse = write_table(pseudo_inverse(tiles(cov.join(by("i"), "i").join(by("j"), "j"), "cov"), size), "precision")
    p = entries(inverse).join(by("i"), "ki").join(by("j"), "kj").select("i", "j", "value")
    own = p.where("i = j")
    p = p.where("i <> j").join(own.select("i", F.col("value").alias("ii")), "i").join(own.select("j", F.col("value").alias("jj")), "j")
    return p.select(F.col("j").alias("src"), F.col("i").alias("dst"), F.try_divide(-F.col("value"), F.sqrt(F.col("ii") * F.col("jj"))).alias("pcorr"))


def partial_correlation_graph(returns: DataFrame, threshold: float = 0.2) -> DataFrame:
    return partial_correlations(returns).where(F.abs("pcorr") >= threshold)
