"""Typing of raw rows whose fields arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(col: Column | str) -> Column:
    """A double; text that is no number, and NaN, become 0."""
    c = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def _value(raw: Column) -> Column:
    """Whole numbers of any length; up to 38 digits are rounded once, by the cast to double."""
    wide = F.when(raw.rlike(r"^\s*[+-]?[0-9]{39,}\s*$"), raw.try_cast("double"))
    return F.coalesce(raw.try_cast("decimal(38,0)").cast("double"), wide)


def typed_transfers(raw: DataFrame) -> DataFrame:
    """(block_time, token_addr, from_addr, to_addr, value) from text columns of the same names.

    Values are doubles, so that 256-bit integers fit. Rows whose value is no number or whose time is none are
    left out; ``rejected`` counts them.
    """
    return raw.select(
        F.col("block_time").try_cast("timestamp_ntz").alias("block_time"),
        *[F.lower(c).alias(c) for c in ("token_addr", "from_addr", "to_addr")],
        _value(F.col("value")).alias("value"),
    ).where(F.col("value").isNotNull() & F.col("block_time").isNotNull())


def rejected(raw: DataFrame) -> DataFrame:
    """(token_addr, n_rows, n_rejected) of raw transfers."""
    bad = _value(F.col("value")).isNull() | F.col("block_time").try_cast("timestamp_ntz").isNull()
    return raw.groupBy(F.lower("token_addr").alias("token_addr")).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_rejected"))
