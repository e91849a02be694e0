"""Entity resolution: address book, resolved flows, top-k collapse, sweep detection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.names import root_entity
from flowrisk.functions.time import between, bucket
from flowrisk.operators.joins import fits, sized
from flowrisk.session import write_table

RESIDUAL = "retail"
# Provenance of a resolved name, and the documented confidence per source.
SEED, LABEL = "seed", "dune_cex"
SOURCE_CONFIDENCE = [
    ("seed", 1.0),
    ("dune_cex", 0.9),
    ("sweep", 0.8),
    ("classifier", 0.6),
    ("cluster", 0.5),
    ("retail", 0.3),
]


# Aggregates over strings sort their whole input first; provenance is therefore compared as its
# position in name order, which gives the same maximum from a hash aggregation.
_SOURCES = sorted(name for name, _ in SOURCE_CONFIDENCE)


def _source_rank(col: str) -> Column:
    return F.array_position(F.array(*map(F.lit, _SOURCES)), F.col(col)).cast("int")


def _greatest(rank: Column) -> Column:
    """The greatest provenance of a group by name."""
    return F.get(F.array(*map(F.lit, _SOURCES)), F.max(rank) - 1)


def _max_source(col: str) -> Column:
    return _greatest(_source_rank(col))


def dedupe_labels(labels: DataFrame) -> DataFrame:
    """One name per address: the greatest."""
    return labels.groupBy("addr").agg(F.max("name").alias("name"))


def address_book(seed: DataFrame, labels: DataFrame) -> DataFrame:
    """(addr, name, prov, root): seed names take priority over labels.

    One lookup table serves both priorities, so a transfer endpoint needs a single join.
    Seed names are roots as they stand.
    """
    seed_addr = seed.groupBy("addr").agg(F.max("name").alias("seed_name"))
    seed_names = seed.select(F.col("name").alias("seed_root")).distinct()
    book = dedupe_labels(labels).join(seed_addr, "addr", "full_outer").select(
        "addr",
        F.coalesce("seed_name", "name").alias("name"),
        F.when(F.col("seed_name").isNotNull(), SEED).otherwise(LABEL).alias("prov"),
    )
    return book.join(seed_names, book.name == seed_names.seed_root, "left").select(
        "addr", "name", "prov", F.coalesce("seed_root", root_entity(F.col("name"))).alias("root")
    )


def scaled_transfers(transfers: DataFrame, tokens: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Transfers of the registered tokens within ``[start, end)``, in token units."""
    scale = tokens.select("token_addr", "sym", F.pow(F.lit(10.0), F.col("dec")).alias("scale"))
    return (
        transfers.where(between(F.col("block_time"), start, end))
        .join(scale, "token_addr")  # broadcast if its size is known to be small
        .withColumn("amount", F.col("value").cast("double") / F.col("scale"))
    )


#: Number of the residual among the numbered names; other names that are not to be known have smaller ones.
_UNKNOWN = -1


def numbered_names(book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(addr, id, rank) of a written address book, and (id, root): each name with its root is a number, each provenance its position.

    Unknown addresses, names and roots are the residual; only other names have numbers from 0 on.
    """
    filled = book.fillna(RESIDUAL, ["name", "prov", "root"])
    residual, row = F.col("name") == RESIDUAL, F.monotonically_increasing_id()
    number = F.when(residual & (F.col("root") == RESIDUAL), _UNKNOWN).when(residual, _UNKNOWN - 1 - row).otherwise(row)
    names = write_table(filled.select("name", "root").distinct().withColumn("id", number), "names")
    numbers = filled.join(names, ["name", "root"]).select("addr", "id", _source_rank("prov").alias("rank"))
    return write_table(numbers, "numbered-book"), names.select("id", "root")


def with_numbers(t: DataFrame, numbers: DataFrame) -> DataFrame:
    """Attach the number of the name and the rank of the provenance of both endpoints."""
    rank = F.lit(_SOURCES.index(RESIDUAL) + 1)
    for side in ("from", "to"):
        n = numbers.select(
            F.col("addr").alias(f"{side}_addr"), F.col("id").alias(f"{side}_known"), F.col("rank").alias(f"{side}_found"), F.lit(True).alias(f"{side}_met")
        )
        t = t.join(n, f"{side}_addr", "left").withColumns({
            f"{side}_id": F.coalesce(f"{side}_known", F.lit(_UNKNOWN).cast("long")),
            f"{side}_rank": F.when(F.col(f"{side}_met"), F.col(f"{side}_found")).otherwise(rank),
        })
    return t


def _rollup(flows: DataFrame, *by: str) -> DataFrame:
    return flows.groupBy(*by, "bucket", "src", "dst").agg(
        F.sum("usd").alias("usd"),
        F.sum("n_tx").alias("n_tx"),
        _max_source("src_prov").alias("src_prov"),
        _max_source("dst_prov").alias("dst_prov"),
    )


def resolved_flows(
    transfers: DataFrame,
    tokens: DataFrame,
    book: DataFrame,
    unit: str = "day",
    min_volume: float = 5e6,
    start: str | None = None,
    end: str | None = None,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Bucketed entity-to-entity flows (bucket, src, dst, usd, n_tx, src_prov, dst_prov).

    The volume filter applies to raw names, before sub-wallets collapse to roots. Token units
    count as USD unless ``rates(bucket, sym, rate)`` says otherwise.
    """
    t = scaled_transfers(transfers, tokens, start, end).withColumn("bucket", bucket(F.col("block_time"), unit))
    return _resolved(t.withColumn("least", F.lit(min_volume)), book, rates)


@dataclass(frozen=True)
class Period:
    """A time range ``[start, end)`` whose flows are bucketed by ``unit`` and kept from ``min_volume`` on."""

    unit: str
    min_volume: float
    start: str | None = None
    end: str | None = None


def resolved_periods(transfers: DataFrame, tokens: DataFrame, book: DataFrame, periods: dict[str, Period],
                     rates: DataFrame | None = None) -> DataFrame:
    """``resolved_flows`` of several named periods from one scan: (period, bucket, src, dst, usd, ...).

    Periods may overlap; a transfer comes once per period that holds it, and only those inside any are read.
    """
    time = F.col("block_time")
    inside = {name: between(time, p.start, p.end) for name, p in periods.items()}
    rows = F.array_compact(F.array(*[
        F.when(inside[name], F.struct(F.lit(name).alias("period"), bucket(time, p.unit).alias("bucket"), F.lit(float(p.min_volume)).alias("least")))
        for name, p in periods.items()
    ]))
    t = scaled_transfers(transfers.where(reduce(Column.__or__, inside.values())), tokens).select("*", F.inline(rows))
    return _resolved(t, book, rates, "period")


def _resolved(t: DataFrame, book: DataFrame, rates: DataFrame | None, *by: str) -> DataFrame:
    """Flows of scaled transfers with ``bucket``, ``least`` (volume from which a pair of names is kept) and the columns ``by``."""
    if rates is not None:
        t = t.join(sized(rates), ["bucket", "sym"], "left").withColumn("amount", F.col("amount") * F.coalesce("rate", F.lit(1.0)))
    keys = [*by, "least", "bucket"]
    t = t.select(*keys, "from_addr", "to_addr", "amount", F.lit(1).cast("long").alias("n_tx"))
    numbers, names = numbered_names(write_table(book, "address-book"))
    if fits(numbers):
        numbers, names = F.broadcast(numbers), F.broadcast(names)
    else:
        # The transfers are shuffled by address, so those of a pair are added up first: what
        # a busy pair sends to a join is one row per bucket.
        t = t.groupBy(*keys, "from_addr", "to_addr").agg(F.sum("amount").alias("amount"), F.sum("n_tx").alias("n_tx"))
    raw = (
        with_numbers(t, numbers)
        .where((F.col("from_id") >= 0) | (F.col("to_id") >= 0))
        # the keys are numbers; names are not needed again, and roots only for what the filter keeps
        .groupBy(*keys, "from_id", "to_id")
        .agg(
            F.sum("amount").alias("usd"), F.sum("n_tx").alias("n_tx"), F.max("from_rank").alias("from_rank"), F.max("to_rank").alias("to_rank"),
        )
        .where(F.col("usd") >= F.col("least"))
    )
    for side, root in (("from", "src"), ("to", "dst")):
        raw = raw.join(names.select(F.col("id").alias(f"{side}_id"), F.col("root").alias(root)), f"{side}_id", "left")
    return raw.fillna(RESIDUAL, ["src", "dst"]).where("src <> dst").groupBy(*by, "bucket", "src", "dst").agg(
        F.sum("usd").alias("usd"), F.sum("n_tx").alias("n_tx"),
        _greatest(F.col("from_rank")).alias("src_prov"), _greatest(F.col("to_rank")).alias("dst_prov"),
    )


def merge_batches(*batches: DataFrame) -> DataFrame:
    """Union flow batches and aggregate again."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return _rollup(out)


def labelled_token_flows(transfers: DataFrame, tokens: DataFrame, seed: DataFrame, unit: str = "day",
                         start: str | None = None, end: str | None = None) -> DataFrame:
    """Flows per token between registry entities; at least one side must be registered."""
    t = scaled_transfers(transfers, tokens, start, end)
    names = sized(seed.groupBy("addr").agg(F.max("name").alias("name")))
    for side, out in (("from_addr", "src"), ("to_addr", "dst")):
        t = t.join(names.select(F.col("addr").alias(side), F.col("name").alias(out)), side, "left")
    return (
        t.where(F.col("src").isNotNull() | F.col("dst").isNotNull())
        .fillna(RESIDUAL, ["src", "dst"])
        .groupBy(bucket(F.col("block_time"), unit).alias("bucket"), "sym", "src", "dst")
        .agg(F.sum("amount").alias("volume"), F.count("*").alias("n_tx"))
    )


def to_usd(token_flows: DataFrame, price: DataFrame | None, scaled: list[str], default: float = 3000.0) -> DataFrame:
    """Token flows in USD: ``scaled`` tokens times the (filled) price, all others one to one."""
    if price is None:
        f = token_flows.withColumn("px", F.lit(default))
    else:
        from flowrisk.operators.series import fill_both_ways

        token_flows = write_table(token_flows, "token-flows")  # read for the calendar and for the volumes
        calendar = token_flows.select(F.col("bucket").alias("ts")).distinct()
        filled = fill_both_ways(calendar.join(price.select("ts", "price"), "ts", "left"), "price")
        mean = price.agg(F.avg("price")).scalar()
        f = token_flows.join(
            sized(filled.select(F.col("ts").alias("bucket"), F.coalesce("price", mean).alias("px"))), "bucket"
        )
    rate = F.when(F.col("sym").isin(scaled), F.col("px")).otherwise(1.0)
    return f.groupBy("bucket", "src", "dst").agg(
        F.sum(F.col("volume") * rate).alias("usd"), F.sum("n_tx").alias("n_tx")
    )


def endpoints(flows: DataFrame) -> DataFrame:
    """One row per flow and endpoint: (entity, usd)."""
    return flows.select(F.explode(F.array("src", "dst")).alias("entity"), "usd")


def throughput(flows: DataFrame) -> DataFrame:
    """Total in plus out per entity."""
    return endpoints(flows).groupBy("entity").agg(F.sum("usd").alias("usd"))


def keep_entities(flows: DataFrame, keep: DataFrame) -> DataFrame:
    """Collapse every entity outside ``keep(entity)`` to the residual and aggregate again."""
    keep = sized(keep.select("entity").distinct())
    f = flows
    for side in ("src", "dst"):
        k = keep.select(F.col("entity").alias(side), F.col("entity").alias(f"{side}_kept"))
        f = f.join(k, side, "left").withColumn(side, F.coalesce(f"{side}_kept", F.lit(RESIDUAL)))
    return _rollup(f.where("src <> dst"))


def top_k_entities(flows: DataFrame, seed_names: DataFrame, k: int = 12) -> DataFrame:
    """Keep the k entities of greatest throughput and all seeds; the others become the residual."""
    top = (
        throughput(flows)
        .where(F.col("entity") != RESIDUAL)
        .orderBy(F.desc("usd"), "entity")
        .limit(k)
        .select("entity")
    )
    return keep_entities(flows, top.union(seed_names.select("name")))


def seed_only(flows: DataFrame, seed_names: DataFrame) -> DataFrame:
    """Flows with everything but the seeds collapsed."""
    return keep_entities(flows, seed_names.select(F.col("name").alias("entity")))


def entity_types(flows: DataFrame, seed_types: DataFrame) -> DataFrame:
    """(entity, type): registry type, else CEX; the residual is RETAIL. Idle seeds appear too."""
    seen = endpoints(flows).select("entity").distinct()
    residual = F.when(F.col("entity") == RESIDUAL, F.lit("RETAIL"))
    everyone = seen.union(seed_types.select("name")).union(
        seen.sparkSession.range(1).select(F.lit(RESIDUAL))
    ).distinct()
    return everyone.join(seed_types.withColumnRenamed("name", "entity"), "entity", "left").select(
        "entity", F.coalesce(residual, "type", F.lit("CEX")).alias("type")
    )


def deposit_sweeps(traces: DataFrame, hot: DataFrame, start: str | None = None, end: str | None = None,
                   min_ratio: float = 0.8, limit: int = 500, scale: float = 1e18) -> DataFrame:
    """Addresses forwarding at least ``min_ratio`` of their inflow to a hot wallet; the largest first.

    Two aggregations over one pass of the traces: each transfer counts as inflow of its
    receiver and, if that receiver is hot, as swept volume of its sender.
    """
    t = traces.where(between(F.col("block_time"), start, end) & F.col("success") & (F.col("value") > 0))
    v = F.col("value").cast("double")
    flagged = t.join(sized(hot.select(F.col("addr").alias("to_addr"), F.lit(True).alias("is_hot"))), "to_addr", "left")
    both = flagged.select(
        F.inline(
            F.array(
                F.struct(F.col("to_addr").alias("addr"), v.alias("inflow"), F.lit(None).cast("double").alias("to_hot")),
                F.struct(
                    F.when(F.col("is_hot"), F.col("from_addr")).alias("addr"),
                    F.lit(None).cast("double").alias("inflow"),
                    v.alias("to_hot"),
                ),
            )
        )
    ).where(F.col("addr").isNotNull())
    return (
        both.groupBy("addr")
        .agg(F.sum("to_hot").alias("to_hot"), F.sum("inflow").alias("inflow"))
        .where(F.col("to_hot").isNotNull() & F.col("inflow").isNotNull())
        .select(
            "addr",
            (F.col("to_hot") / scale).alias("swept"),
            (F.col("inflow") / scale).alias("inflow"),
            F.try_divide("to_hot", "inflow").alias("sweep_ratio"),
        )
        .where(F.col("sweep_ratio") >= min_ratio)
        .orderBy(F.desc("swept"), "addr")
        .limit(limit)
    )
