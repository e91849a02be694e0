"""Long time-series panels (ts, key, value): grids, fills, returns, rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.functions.time import bucket
from flowrisk.operators.dense import column_sums, numbered, products
from flowrisk.operators.joins import keys_array, sized
from flowrisk.operators.slices import SLICED, fill_forward, own, sliced
from flowrisk.session import write_table

KEYS_PER_LIST = 1_000


def last_quote(points: DataFrame, unit: str) -> DataFrame:
    """(ts, key, price): the last quote of every bucket; of simultaneous ones the last ``seq``.

    Two hash aggregations over numbers: the last time per bucket, then the last of the quotes
    at that time. One aggregation over (ts, seq) pairs would sort all quotes.
    """
    q = points.withColumn("b", bucket(F.col("ts"), unit))
    last = sized(q.groupBy("b", "key").agg(F.max("ts").alias("ts")))
    at_last = q.join(last, ["b", "key", "ts"], "left_semi")
    return at_last.groupBy("b", "key").agg(F.max_by("price", "seq").alias("price")).select(F.col("b").alias("ts"), "key", "price")


def grid(calendar: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Every timestamp of ``calendar(ts)`` with every key of ``keys``.

    Keys are dealt by hash to lists of about ``KEYS_PER_LIST``; a timestamp meets the lists by their number and
    explodes them.
    """
    names = keys.select(F.col(key_col).alias("key")).where(F.col("key").isNotNull()).distinct()
    n = names.agg(F.greatest(F.ceil(F.count("*") / KEYS_PER_LIST), F.lit(1)).cast("int").alias("n")).scalar()
    lists = names.withColumn("list", F.pmod(F.xxhash64("key"), n).cast("int")).groupBy("list").agg(F.collect_list("key").alias("keys"))
    numbered = calendar.select("ts").distinct().select("ts", F.explode(F.sequence(F.lit(0), n - 1)).alias("list"))
    return numbered.join(lists, "list").select("ts", F.explode("keys").alias("key"))


def dense(calendar: DataFrame, unit: str) -> DataFrame:
    """(ts): every bucket from the first to the last one of the calendar."""
    step = F.make_interval(**{"hour": {"hours": F.lit(1)}, "day": {"days": F.lit(1)}, "week": {"weeks": F.lit(1)}}[unit])
    span = calendar.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", step)).alias("ts"))


def on_grid(grid: DataFrame, panel: DataFrame) -> DataFrame:
    """``panel`` reindexed to the grid; absent observations are NULL."""
    return grid.join(panel, ["ts", "key"], "left")


def fill_both_ways(series: DataFrame, col: str) -> DataFrame:
    """Forward, then backward fill of one series over a calendar (one row per bucket).

    The runs between observations are numbered by a running count per year and the
    totals of earlier years, so no window holds more than a year of buckets.
    """
    year = F.year("ts")
    s = series.select("ts", col, year.alias("yr"))
    w = W.partitionBy("yr").orderBy("ts")
    local = s.withColumns({
        "_prev": F.last(col, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_next": F.first(col, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)),
    })
    per_year = s.where(F.col(col).isNotNull()).groupBy("yr").agg(
        F.max_by(col, "ts").alias("last_v"), F.min_by(col, "ts").alias("first_v")
    )
    years = s.select("yr").distinct().join(per_year, "yr", "left")
    yw = W.orderBy("yr")  # one row per calendar year
    carry = years.select(
        "yr",
        F.last("last_v", ignorenulls=True).over(yw.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("first_v", ignorenulls=True).over(yw.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    return local.join(carry, "yr", "left").select(
        "ts", F.coalesce("_prev", "_before", "_next", "_after").alias(col)
    )


def price_panel(prices: DataFrame) -> DataFrame:
    """Prices of all assets on the union of their timestamps, forward filled."""
    return fill_forward(on_grid(grid(prices, prices), prices), "price", calendar=prices)


def log_returns(panel: DataFrame) -> DataFrame:
    """(ts, key, value): log returns; timestamps without any return are dropped."""
    w = W.partitionBy(*SLICED).orderBy("ts")
    r = own(sliced(panel, 1).withColumn("value", F.ln(F.col("price") / F.lag("price").over(w)))).select("ts", "key", "value")
    return r.where(F.col("value").isNotNull())


def complete_cases(panel: DataFrame) -> DataFrame:
    """Rows of the timestamps at which every key of the panel has a value.

    A timestamp holds at most one row per key, so the windows are small.
    """
    observed = panel.where(F.col("value").isNotNull())
    n_keys = observed.agg(F.count_distinct("key")).scalar()
    counted = observed.withColumn("_n", F.count("*").over(W.partitionBy("ts")))
    return counted.where(F.col("_n") == n_keys).drop("_n")


def rolling(win: int, *by: str) -> W:
    """The last ``win`` rows of a series, or of a slice with ``by=SLICED``."""
    return W.partitionBy(*(by or ("key",))).orderBy("ts").rowsBetween(-(win - 1), 0)


def rolling_mean(x: Column, w: W, min_periods: int) -> Column:
    """Mean over the frame, NULL with fewer than ``min_periods`` values; zero becomes NULL."""
    return F.when(F.count(x).over(w) >= min_periods, F.nullif(F.avg(x).over(w), F.lit(0.0)))


def zscore(x: Column, w: W, min_periods: int) -> Column:
    """Rolling z-score; 0 during warm-up, for missing values and in constant windows."""
    constant = F.max(x).over(w) == F.min(x).over(w)
    z = (x - F.avg(x).over(w)) / F.stddev_samp(x).over(w)
    return F.coalesce(F.when((F.count(x).over(w) >= min_periods) & ~constant, z), F.lit(0.0))


def drawdown(x: Column, w: W, min_periods: int) -> Column:
    """One minus the ratio to the rolling maximum, at least 0; 0 during warm-up."""
    peak = F.when(F.count(x).over(w) >= min_periods, F.max(x).over(w))
    return F.greatest(F.coalesce(1 - x / peak, F.lit(0.0)), F.lit(0.0))


def covariance(panel: DataFrame) -> DataFrame:
    """(i, j, n, cov, corr) over the complete cases, both orders and the diagonal.

    Products are added up tile by tile; the sums of single series join them by key.
    """
    full = write_table(complete_cases(panel).select("ts", "key", "value"), "complete")
    x = F.col("value")
    single = write_table(column_sums(full, {"s": x, "ss": x * x}), "sums")
    variance = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    of = lambda side: single.select(F.col("key").alias(side), F.col("s").alias(f"s{side}"), variance.alias(f"v{side}"), F.col("n").alias(f"n{side}"))
    m = products(full, numbered(single), [("value", "value")]).join(of("i"), "i").join(of("j"), "j").withColumn("n", F.col("ni"))
    cov = F.when(F.col("i") == F.col("j"), F.col("vi")).otherwise((F.col("p0") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1))
    return m.withColumn("cov", cov).select("i", "j", "n", "cov", F.try_divide(F.col("cov"), F.sqrt(F.col("vi") * F.col("vj"))).alias("corr"))


def wide(panel: DataFrame) -> DataFrame:
    """(ts, x[]): the values of all keys in key order; one row per complete timestamp."""
    return panel.groupBy("ts").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda s: s["value"]).alias("x")
    )


def pair_moments(panel: DataFrame) -> DataFrame:
    """(i, j, n, s_x, s_y, s_xy) of a complete panel over a bounded key dimension, one Gram matrix per task.

    For panels of many keys ``dense.products`` works in tiles.
    """
    from flowrisk.functions.linalg import gram_partials

    keys = keys_array(panel, "key")
    parts = wide(panel).select("x").mapInPandas(gram_partials, "i int, j int, n long, s_x double, s_y double, s_xy double")
    m = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s_x", "s_y", "s_xy")])
    return m.withColumns({"i": F.get(keys, F.col("i")), "j": F.get(keys, F.col("j"))})
