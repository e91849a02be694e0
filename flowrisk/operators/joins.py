"""Lookup joins whose strategy follows the measured size of the dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.session import BROADCAST_ROWS, write_table

# Largest entity or asset dimension of a dense matrix.
MAX_KEYS = 2_000


def fits(dim: DataFrame, bound: int | None = None) -> bool:
    """Whether ``dim``, a written table, has at most ``bound`` rows (``BROADCAST_ROWS`` by default)."""
    return dim.count() <= (BROADCAST_ROWS if bound is None else bound)


def sized(dim: DataFrame, bound: int | None = None) -> DataFrame:
    """``dim``, written once, with a broadcast hint if it fits.

    Its rows are counted in the written files. Above the bound the join shuffles, and AQE splits the partitions of hot keys.
    """
    dim = write_table(dim, "dimension")
    return F.broadcast(dim) if fits(dim, bound) else dim


def bounded(small: DataFrame) -> DataFrame:
    """Broadcast hint for a relation with one row per entity, asset, model or combination of them.

    Entities are bounded by the top-k collapse and the number of seeds; ``keys_array`` enforces ``MAX_KEYS``
    where keys span a dense matrix.
    """
    return F.broadcast(small)


def keys_array(df: DataFrame, col: str) -> Column:
    """Sorted distinct values of a bounded dimension column, as a scalar-subquery column.

    More than ``MAX_KEYS`` values is an error: the dense entity-by-entity arrays would not fit.
    """
    few = df.select(col).distinct().limit(MAX_KEYS + 1)
    keys = few.agg(F.array_sort(F.collect_list(col)).alias("keys"))
    error = F.raise_error(F.lit(f"more than {MAX_KEYS} values of {col}; collapse entities first"))
    return keys.select(F.when(F.size("keys") <= MAX_KEYS, F.col("keys")).otherwise(error.cast("array<string>")).alias("keys")).scalar()
