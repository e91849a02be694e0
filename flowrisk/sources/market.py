"""Landed market documents: one JSON text per request, as price or locked-value series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.time import bucket

# Fixed formats of the landed documents.
PRICE_SCHEMA = "struct<coins: map<string, struct<prices: array<struct<timestamp: double, price: double>>>>>"
POINTS_PER_DOCUMENT = 480
TVL_SCHEMA = "struct<tvl: array<struct<date: double, totalLiquidityUSD: double>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): one row per landed file; large folders spread over the tasks."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def _moment(seconds: Column) -> Column:
    """Zone-less UTC time of epoch seconds, whatever the session's time zone."""
    return _epoch() + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def price_series(docs: DataFrame, unit: str) -> DataFrame:
    """(ts, key, price) from ``coins.<id>.prices[]``; the last point of a bucket wins.

    Broken documents parse to NULL and contribute nothing.
    """
    parsed = docs.select(F.from_json("doc", PRICE_SCHEMA).alias("d"))
    points = (
        parsed.select(F.explode("d.coins").alias("coin", "body"))
        .select("coin", F.posexplode("body.prices").alias("seq", "p"))
        .select(
            F.element_at(F.split("coin", ":"), -1).alias("key"), _moment(F.col("p.timestamp")).alias("ts"), "seq",
            F.col("p.price").alias("price"),
        )
    )
    return points.groupBy(bucket(F.col("ts"), unit).alias("b"), "key").agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price")
    ).select(F.col("b").alias("ts"), "key", "price")


def tvl_series(docs: DataFrame) -> DataFrame:
    """(ts, key, value) per day from ``tvl[]`` of ``docs(key, doc)``; a missing series is simply absent."""
    points = docs.select("key", F.from_json("doc", TVL_SCHEMA).alias("d")).select("key", F.posexplode("d.tvl").alias("seq", "p"))
    ts = _moment(F.col("p.date"))
    return points.groupBy(bucket(ts, "day").alias("ts"), "key").agg(
        F.max_by(F.col("p.totalLiquidityUSD"), F.struct(ts, "seq")).alias("value")
    )


def _seconds(ts: Column) -> Column:
    span = ts - _epoch()
    part = lambda name: F.extract(F.lit(name), span).cast("double")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def _points(quotes: DataFrame, time_field: str, value_field: str) -> DataFrame:
    """Arrays of at most ``POINTS_PER_DOCUMENT`` points of one key, in quote order."""
    chunk = F.floor(F.col("seq") / POINTS_PER_DOCUMENT)
    point = F.struct(F.col("ts"), F.col("seq"), _seconds(F.col("ts")).alias(time_field), F.col("price").alias(value_field))
    ordered = F.array_sort(F.collect_list(point))
    slim = F.transform(ordered, lambda s: F.struct(s[time_field].alias(time_field), s[value_field].alias(value_field)))
    return quotes.groupBy("key", chunk.alias("chunk")).agg(slim.alias("points"))


def pack_price_documents(quotes: DataFrame) -> DataFrame:
    """(doc): quotes (key, ts, seq, price) in the landed layout, a limited number of points each."""
    body = F.struct(F.col("points").alias("prices"))
    doc = F.struct(F.create_map(F.concat(F.lit("asset:"), "key"), body).alias("coins"))
    return _points(quotes, "timestamp", "price").select(F.to_json(doc).alias("doc"))


def pack_tvl_documents(quotes: DataFrame) -> DataFrame:
    """(key, doc): quotes in the landed locked-value layout, a limited number of points each."""
    return _points(quotes, "date", "totalLiquidityUSD").select(
        "key", F.to_json(F.struct(F.col("points").alias("tvl"))).alias("doc")
    )
