"""Time buckets on zone-less timestamps (all times are UTC by convention)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(ts: Column, unit: str) -> Column:
    """Start of the hour, day or week containing ``ts``; days and longer go by the date, without a time zone's calendar."""
    if unit in ("week", "month", "quarter", "year"):
        return F.trunc(ts.cast("date"), unit).cast("timestamp_ntz")
    if unit == "day":
        return ts.cast("date").cast("timestamp_ntz")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def at(value: str) -> Column:
    """A timestamp literal."""
    return F.lit(value).cast("timestamp_ntz")


def between(ts: Column, start: str | None, end: str | None, closed: bool = False) -> Column:
    """``start <= ts < end``, or ``<= end`` when closed; open ends allowed."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= at(start))
    if end is not None:
        cond = cond & ((ts <= at(end)) if closed else (ts < at(end)))
    return cond
