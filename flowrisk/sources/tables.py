"""The driver's star-schema tables read as the domain relations of the engine.

Buyers and suppliers are addresses, line items are token transfers, nations are
the entities behind the addresses, order priorities and event types are assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.time import bucket
from flowrisk.sources.registry import literal_relation

# Fixed values of the test mapping: minor units per token, entity type per region key.
TOKENS = [("A", "A", 4), ("N", "N", 4), ("R", "R", 4)]
ETH_LIKE_TOKENS = ["R"]
REGION_TYPES = [
    (0, "CEX"),
    (1, "STABLECOIN_ISSUER"),
    (2, "LENDING"),
    (3, "LST"),
    (4, "CEX"),
]
ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DOCUMENTED_EDGES = [(f"NATION_{k}", f"NATION_{(k + 1) % 25}") for k in range(0, 25, 2)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a large scan that one task sorts for a join.
TASK_ROWS = 500_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows of a scan with fewer splits than cores (one small file) over all cores.

    Of a table so large that the session's shuffle partitions would hold more than ``TASK_ROWS`` rows, as many partitions as keep to
    that; a join on ``key`` takes them over, so a task's memory does not grow with the table. Other tables are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks, key) if tasks > max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))) else df


def tokens(spark: SparkSession) -> DataFrame:
    return literal_relation(spark, TOKENS, "token_addr string, sym string, dec int")


def documented_edges(spark: SparkSession) -> DataFrame:
    return literal_relation(spark, DOCUMENTED_EDGES, "src string, dst string")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_time, token_addr, from_addr, to_addr, value): buyer pays supplier or is refunded."""
    # Amounts are taken at the scan, so that one number per line item goes through the join.
    li = spread(read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", (F.col("l_linestatus") == "F").alias("paid"),
        whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).alias("value"),
    ), "l_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    supplier = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_shipdate").alias("block_time"),
        F.col("l_returnflag").alias("token_addr"),
        F.when(F.col("paid"), buyer).otherwise(supplier).alias("from_addr"),
        F.when(F.col("paid"), supplier).otherwise(buyer).alias("to_addr"),
        "value",
    )


#: Doubles below this have exact fractions, so halves are told without decimal digits.
EXACT = 2.0**52


def whole(x: Column) -> Column:
    """``round(x)`` as decimal(18,0), without a decimal number per row where ``x`` is small enough."""
    size = F.abs(x)
    below = F.floor(size)
    rounded = F.when(size - below >= 0.5, below + 1).otherwise(below)
    return F.when(size < EXACT, F.when(x < 0, -rounded).otherwise(rounded).cast("decimal(18,0)")).otherwise(F.round(x).cast("decimal(18,0)"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native value transfers with a success flag."""
    return transfers(spark, sf_dir).select(
        "block_time", "from_addr", "to_addr", "value", (F.col("token_addr") != "R").alias("success")
    )


def _supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("addr"),
        "s_suppkey",
        "n_name",
        "n_regionkey",
    )


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-curated registry (addr, name)."""
    return (
        _supplier_nation(spark, sf_dir)
        .where(F.col("s_suppkey") % 5 == 0)
        .select("addr", F.col("n_name").alias("name"))
    )


def seed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, type) for the seed entities."""
    types = literal_relation(spark, REGION_TYPES, "n_regionkey int, type string")
    return (
        _supplier_nation(spark, sf_dir)
        .where(F.col("s_suppkey") % 5 == 0)
        .join(types, "n_regionkey")
        .select(F.col("n_name").alias("name"), "type")
        .distinct()
    )


def address_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(addr, name): sub-wallet names, several rows per address."""
    s = _supplier_nation(spark, sf_dir)
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    name = (
        F.when(k % 3 == 0, F.concat_ws(" ", "n_name", k.cast("string")))
        .when(k % 3 == 1, F.concat(F.col("n_name"), F.lit(" Hot Wallet")))
        .otherwise(F.col("n_name"))
    )
    deposits = (
        c.where(F.col("c_mktsegment") == "MACHINERY")
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("addr"),
            F.concat_ws(" ", "n_name", F.lit("Deposit"), F.col("c_custkey").cast("string")).alias("name"),
        )
    )
    return (
        s.select("addr", name.alias("name"))
        .unionByName(s.where(k % 7 == 0).select("addr", F.concat(F.col("n_name"), F.lit(" Cold 2")).alias("name")))
        .unionByName(deposits)
    )


def hot_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the seed registry, as the sweep detector's targets."""
    return seed(spark, sf_dir).select("addr").distinct()


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quotes (key, ts, seq, price) per event type."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price")
    )


def priority_prices(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """(ts, key, price): mean order value per priority and time bucket."""
    return (
        read(spark, sf_dir, "orders")
        .groupBy(bucket(F.col("o_orderdate"), unit).alias("ts"), F.col("o_orderpriority").alias("key"))
        .agg(F.avg("o_totalprice").alias("price"))
    )


def peg_prices(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Priority prices divided by their overall mean, so that they hover around one."""
    p = priority_prices(spark, sf_dir, unit)
    mean = p.groupBy("key").agg(F.avg("price").alias("m"))
    return p.join(mean, "key").select("ts", "key", (F.col("price") / F.col("m")).alias("price"))


def nation_tvl(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """(ts, key, value): order value per nation and bucket, as the locked value of a protocol."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .groupBy(bucket(F.col("o_orderdate"), unit).alias("ts"), F.col("n_name").alias("key"))
        .agg(F.sum("o_totalprice").alias("value"))
    )


def entity_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, asset): the market proxy of each nation."""
    idx = F.col("n_nationkey") % len(ASSETS)
    return read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("entity"), F.get(F.array(*map(F.lit, ASSETS)), idx).alias("asset")
    )
