"""Stress panels (ts, key, value): higher is more distressed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.functions.draws import normal
from flowrisk.operators.joins import bounded
from flowrisk.operators.resolve import RESIDUAL, endpoints
from flowrisk.operators.series import dense, drawdown, grid, on_grid, rolling, rolling_mean, zscore
from flowrisk.operators.slices import SLICED, fill_forward, own, sliced
from flowrisk.session import write_table


@dataclass(frozen=True)
class Roll:
    """Length of the rolling frame in buckets, and the least number of values in it."""

    win: int
    min_periods: int


DAILY, HOURLY, EVENT = Roll(30, 5), Roll(48, 6), Roll(14, 3)


def calendar(flows: DataFrame, unit: str | None = None) -> DataFrame:
    """(ts): the buckets with flow; with ``unit`` also the empty ones between them."""
    cal = flows.select(F.col("bucket").alias("ts")).distinct()
    return cal if unit is None else dense(cal, unit)


def flow_entities(flows: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(entity): endpoints of the flows and, if given, registered entities without flow."""
    e = endpoints(flows).select("entity")
    return (e.union(extra.select("entity")) if extra is not None else e).distinct()


def entity_flow_series(flows: DataFrame, entities: DataFrame, unit: str | None = None) -> DataFrame:
    """(ts, key, inflow, outflow, net_outflow) on the flow calendar, zero where idle.

    The grid enters as zero rows of the same aggregation, which saves a join.
    """
    zero = F.lit(0.0)
    legs = flows.select(
        F.col("bucket").alias("ts"),
        F.inline(
            F.array(
                F.struct(F.col("dst").alias("key"), F.col("usd").alias("inflow"), zero.alias("outflow")),
                F.struct(F.col("src").alias("key"), zero.alias("inflow"), F.col("usd").alias("outflow")),
            )
        ),
    ).join(bounded(entities.select(F.col("entity").alias("key"))), "key", "left_semi")
    base = grid(calendar(flows, unit), entities, "entity").select("ts", "key", zero.alias("inflow"), zero.alias("outflow"))
    return (
        base.unionByName(legs)
        .groupBy("key", "ts")
        .agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
        .select("ts", "key", "inflow", "outflow", (F.col("outflow") - F.col("inflow")).alias("net_outflow"))
    )


def _net_ratio(series: DataFrame, roll: Roll) -> DataFrame:
    total = F.col("inflow") + F.col("outflow")
    s = series.withColumn("total", total)
    ratio = F.col("net_outflow") / rolling_mean(F.col("total"), rolling(roll.win, *SLICED), roll.min_periods)
    return s.withColumn("ratio", F.coalesce(ratio, F.lit(0.0)))


def flow_stress(flows: DataFrame, entities: DataFrame, roll: Roll = HOURLY, unit: str | None = None) -> DataFrame:
    """0.6 z(net outflow ratio) + 0.4 z(throughput)."""
    s = _net_ratio(sliced(entity_flow_series(flows, entities, unit), 2 * roll.win, calendar=calendar(flows, unit)), roll)
    w = rolling(roll.win, *SLICED)
    z = 0.6 * zscore(F.col("ratio"), w, roll.min_periods) + 0.4 * zscore(F.col("total"), w, roll.min_periods)
    return own(s.withColumn("value", z)).select("ts", "key", "value")


def _on_calendar(cal: DataFrame, prices: DataFrame, asset_of: DataFrame, col: str) -> DataFrame:
    """Quotes of each entity's asset on the calendar, filled forward after the reindexing.

    ``asset_of(key, ref)`` is a bounded registry. Quotes between buckets are not carried over.
    """
    quotes = prices.join(bounded(asset_of.withColumnRenamed("key", "entity")),
                         F.col("key") == F.col("ref")).select("ts", F.col("entity").alias("key"), F.col(col))
    return fill_forward(on_grid(grid(cal, asset_of, "key"), quotes), col, calendar=cal)


def _quotes_of(refs: DataFrame, prices: DataFrame, tvl: DataFrame) -> DataFrame:
    """(ts, key, peg, price, tvl): each entity's quotes of its own series, one row per time with any of them.

    The three series are stacked with their kind, so that one join and one aggregation serve all.
    """
    kinds = {"peg": ("price", "peg_ref"), "price": ("price", "price_ref"), "tvl": ("tvl", "tvl_ref")}
    of = refs.select(F.col("entity").alias("owner"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(table).alias("table"), F.col(c).alias("ref")) for k, (table, c) in kinds.items()
    ])))
    points = prices.select("ts", F.col("key").alias("ref"), F.col("price").alias("x"), F.lit("price").alias("table")).unionByName(
        tvl.select("ts", F.col("key").alias("ref"), F.col("value").alias("x"), F.lit("tvl").alias("table"))
    )
    quotes = points.join(bounded(of.where(F.col("ref").isNotNull())), ["table", "ref"])
    return quotes.groupBy("ts", F.col("owner").alias("key")).agg(*[F.max(F.when(F.col("kind") == k, F.col("x"))).alias(k) for k in kinds])


def typed_stress(flows: DataFrame, types: DataFrame, refs: DataFrame, prices: DataFrame, tvl: DataFrame,
                 market: str | None = None, roll: Roll = DAILY) -> DataFrame:
    """Type-specific stress: exchanges by flow, issuers by peg and redemptions, lenders by drawdowns.

    ``types(entity, type)``; ``refs(entity, peg_ref, tvl_ref, price_ref)`` with NULL where an
    entity has no such series; ``market`` is the asset whose drawdown stands for the residual.
    """
    cal = calendar(flows)
    ents = types.where(F.col("entity") != RESIDUAL)
    series = entity_flow_series(flows, ents).join(bounded(ents.withColumnRenamed("entity", "key")), "key")
    filled = fill_forward(series.join(_quotes_of(refs, prices, tvl), ["ts", "key"], "left"), "peg", "price", "tvl", calendar=cal)
    s = _net_ratio(sliced(filled, 2 * roll.win, calendar=cal), roll)
    w, m = rolling(roll.win, *SLICED), roll.min_periods
    s = s.withColumns({
        "peg_dev": F.abs(1 - F.col("peg")),
        "redemption": F.greatest("ratio", F.lit(0.0)),
        "tvl_dd": drawdown(F.col("tvl"), w, m),
        "px_dd": drawdown(F.col("price"), w, m),
    })
    z = {c: zscore(F.col(c), w, m) for c in ("ratio", "peg_dev", "redemption", "tvl_dd", "px_dd")}
    value = (
        F.when(F.col("type").isin("CEX", "RETAIL"), z["ratio"])
        .when(F.col("type") == "STABLECOIN_ISSUER", 0.6 * z["peg_dev"] + 0.4 * z["redemption"])
        .when(F.col("type").isin("LENDING", "LST"), z["tvl_dd"] + 0.5 * z["px_dd"])
        .otherwise(0.0)
    )
    out = own(s.withColumn("value", value)).select("ts", "key", "value")
    return out if market is None else out.unionByName(market_stress(cal, prices, market, RESIDUAL, roll))


def market_stress(cal: DataFrame, prices: DataFrame, asset: str, name: str, roll: Roll = DAILY) -> DataFrame:
    """z(drawdown) of one asset, as the series ``name``."""
    p = prices.where(F.col("key") == asset).select("ts", "price")
    s = sliced(fill_forward(cal.join(p, "ts", "left").withColumn("key", F.lit(name)), "price", calendar=cal), 2 * roll.win, calendar=cal)
    w = rolling(roll.win, *SLICED)
    s = s.withColumn("dd", drawdown(F.col("price"), w, roll.min_periods))
    return own(s.withColumn("value", zscore(F.col("dd"), w, roll.min_periods))).select("ts", "key", "value")


def peg_stress(cal: DataFrame, prices: DataFrame, asset: str, name: str, roll: Roll) -> DataFrame:
    """z(|1 - price|) of one asset, as the series ``name``."""
    p = prices.where(F.col("key") == asset).select("ts", "price")
    s = sliced(fill_forward(cal.join(p, "ts", "left").withColumn("key", F.lit(name)), "price", calendar=cal), roll.win, calendar=cal)
    z = zscore(F.abs(1 - F.col("price")), rolling(roll.win, *SLICED), roll.min_periods)
    return own(s.withColumn("value", z)).select("ts", "key", "value")


def with_peg(panel: DataFrame, peg: DataFrame) -> DataFrame:
    """Average the series named in ``peg`` with its peg stress; other series stay."""
    p = peg.select("ts", "key", F.col("value").alias("peg"))
    v = F.when(F.col("peg").isNotNull(), 0.5 * F.col("value") + 0.5 * F.col("peg")).otherwise(F.col("value"))
    return panel.join(p, ["ts", "key"], "left").select("ts", "key", v.alias("value"))


def nonflow_stress(cal: DataFrame, prices: DataFrame, sources: DataFrame, roll: Roll = HOURLY) -> DataFrame:
    """Stress from prices only. ``sources(entity, kind, asset)``, kind 'peg' or 'drawdown'."""
    ref = sources.select(F.col("entity").alias("key"), F.col("asset").alias("ref"))
    s = _on_calendar(cal, prices, ref, "price").join(
        bounded(sources.select(F.col("entity").alias("key"), "kind")), "key"
    )
    s = sliced(s, 2 * roll.win, calendar=cal)
    w, m = rolling(roll.win, *SLICED), roll.min_periods
    signal = F.when(F.col("kind") == "peg", F.abs(1 - F.col("price"))).otherwise(drawdown(F.col("price"), w, m))
    return own(s.withColumn("sig", signal).withColumn("value", zscore(F.col("sig"), w, m))).select("ts", "key", "value")


def nonflow_sources(entities: DataFrame, known: DataFrame, default_kind: str, default_asset: str) -> DataFrame:
    """Every entity with its price source, or the default one."""
    return entities.join(known, "entity", "left").select(
        "entity", F.coalesce("kind", F.lit(default_kind)).alias("kind"),
        F.coalesce("asset", F.lit(default_asset)).alias("asset"),
    )


AR_DECAY = 0.7
#: Steps of a block of the scan.
AR_BLOCK = 128


def affine_scan(steps: DataFrame, size: int) -> DataFrame:
    """(pos, x) of ``x_pos = a * x_(pos - 1) + b`` from zero, for ``steps(pos, a, b)`` numbered without gaps.

    Steps compose: a block of them is one step again. Blocks are scanned apart, their totals by the same scan one level up, and
    what comes in from earlier blocks is added; each level has a block's size fewer rows, so no task sees more than a block.
    """
    blocked = steps.withColumn("block", F.floor(F.col("pos") / AR_BLOCK))
    w = W.partitionBy("block").orderBy("pos")
    so_far = F.collect_list(F.struct("a", "b")).over(w.rowsBetween(W.unboundedPreceding, 0))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    total = F.aggregate(so_far, start, lambda acc, s: F.struct((acc["a"] * s["a"]).alias("a"), (acc["b"] * s["a"] + s["b"]).alias("b")))
    own = blocked.select("pos", "block", total.alias("t"))
    if size <= AR_BLOCK:
        # At most two blocks, as numbers may start anywhere in the first.
        ends = own.groupBy("block").agg(F.max_by("t", "pos").alias("t"))
        carry = ends.select((F.col("block") + 1).alias("block"), F.col("t.b").alias("carry"))
    else:
        own = write_table(own, "scanned")
        ends = own.groupBy("block").agg(F.max_by("t", "pos").alias("t")).select(F.col("block").alias("pos"), "t.a", "t.b")
        above = affine_scan(ends, -(-size // AR_BLOCK) + 1)
        carry = above.select((F.col("pos") + 1).alias("block"), F.col("x").alias("carry"))
    joined = own.join(carry, "block", "left")
    return joined.select("pos", (F.col("t.b") + F.col("t.a") * F.coalesce("carry", F.lit(0.0))).alias("x"))


def latent_shock(panel: DataFrame, seed: int) -> DataFrame:
    """(ts, shock): a standardised AR(1) path on the calendar of the panel.

    Buckets are numbered within their year and by the totals of earlier years; the recursion is an ``affine_scan``.
    """
    cal = panel.select("ts").distinct().withColumn("yr", F.year("ts"))
    years = cal.groupBy("yr").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("yr").rowsBetween(W.unboundedPreceding, -1))
    offsets = years.select("yr", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(W.partitionBy("yr").orderBy("ts"))
    numbered = cal.withColumn("local", local).join(offsets, "yr").withColumn("pos", F.col("before") + F.col("local"))
    eps = numbered.select("ts", "pos", F.lit(AR_DECAY).alias("a"), normal("latent", seed, F.col("pos")).alias("b"))
    eps = write_table(eps, "innovations")
    x = affine_scan(eps.select("pos", "a", "b"), eps.count()).join(eps.select("ts", "pos"), "pos").select("ts", "x")
    m = x.agg(F.struct(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))).scalar()
    return x.select("ts", ((F.col("x") - m["mean"]) / m["sd"]).alias("shock"))


def inject(panel: DataFrame, shock: DataFrame, strength: float) -> DataFrame:
    """Add a common shock to every series."""
    return panel.join(shock, "ts").select(
        "ts", "key", (F.col("value") + F.lit(strength) * F.col("shock")).alias("value")
    )
