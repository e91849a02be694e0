"""Windows over long series: slices of rows with a halo, so that no series has to fit one task.

A panel is (ts, key, ...), one row per key and time; rows without key or time belong to no series and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.session import write_table

# Rows of a series that one window holds, besides its halo.
SLICE_ROWS = 65_536

# Partition columns of a window over a sliced panel.
SLICED = ["key", "slice"]


def _day() -> Column:
    return F.to_date("ts").alias("_day")


def positions(panel: DataFrame) -> DataFrame:
    """Add ``pos``, the 1-based index of the row within its series.

    Rows are numbered per day, and the days by the totals of earlier ones: the only window over a whole series has
    one row per day. ``panel`` is read twice, so write it first if it is costly to build.
    """
    days = panel.groupBy("key", _day()).agg(F.count("*").alias("_n"))
    before = W.partitionBy("key").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("key", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("key", "_day").orderBy("ts"))
    numbered = panel.withColumn("_day", _day()).withColumn("_local", local).join(days, ["key", "_day"])
    return numbered.withColumn("pos", F.col("_before") + F.col("_local")).select(*panel.columns, "pos")


def _places(calendar: DataFrame) -> DataFrame:
    """(ts, pos): the times of a calendar, numbered."""
    return positions(calendar.select("ts").distinct().withColumn("key", F.lit(""))).drop("key")


def sliced(panel: DataFrame, halo: int, rows: int | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Add ``pos``, ``slice`` and ``halo``: the last ``halo`` rows of a slice come once more, marked, before the next one.

    A window by ``SLICED`` then has the ``halo`` rows before every row of its own, as one by key has. Frames in
    frames need the sum of their lengths. ``own`` drops the marked rows after the windows. Where every series has one
    row per time of a ``calendar(ts)``, the times are numbered instead of the rows, and ``panel`` is read once.
    """
    size = max(SLICE_ROWS if rows is None else rows, halo, 1)
    place = F.col("pos") - 1
    number = F.floor(place / size).cast("long")
    part = lambda n, h: F.struct(n.alias("slice"), F.lit(h).alias("halo"))
    both = F.array(part(number, False), part(number + 1, True))
    only = F.array(part(number, False))
    if calendar is None:
        placed = positions(panel)
    else:
        placed = panel.join(_places(calendar), "ts")
    return placed.select("*", F.inline(F.when(place % size >= size - halo, both).otherwise(only)))


def own(panel: DataFrame) -> DataFrame:
    """The rows of a sliced panel, each once."""
    return panel.where(~F.col("halo")).drop("slice", "halo")


def fill_forward(panel: DataFrame, *cols: str, calendar: DataFrame | None = None) -> DataFrame:
    """Replace NULL in ``cols`` by the last value before it in the series.

    Days, or slices of the ``calendar(ts)`` that every series has a row for, are filled by themselves; what the empty
    start of one takes over comes from the last values of earlier ones, one row per key and day or slice.
    """
    names = panel.columns
    if calendar is None:
        pieces = panel.withColumn("_piece", F.to_date("ts"))
    else:
        pieces = panel.join(_places(calendar).select("ts", F.floor((F.col("pos") - 1) / SLICE_ROWS).alias("_piece")), "ts")
    panel = write_table(pieces, "unfilled")
    last = panel.groupBy("key", "_piece").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_last_{c}") for c in cols]
    )
    before = W.partitionBy("key").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("key", "_piece", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in cols])
    past = W.partitionBy("key", "_piece").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    local = panel.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in cols})
    out = local.join(carried, ["key", "_piece"]).withColumns({c: F.coalesce(c, f"_last_{c}") for c in cols})
    return out.select(*names)
