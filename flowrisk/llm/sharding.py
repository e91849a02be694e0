"""Reproducible shuffle into shards: a keyed permutation of global row numbers, computable without the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import U, mixed, numbered
from flowrisk.session import write_table

ROUNDS = 8


class Permutation:
    """Feistel network over the smallest power of two that holds ``n`` numbers, closed by cycle walking.

    A network over ``2**bits`` numbers is a bijection; walking it until the value is below
    ``n`` restricts it to a bijection of ``0 .. n-1``. The domain is below ``2 n`` (or 4), so a walk
    takes fewer than two steps on average. ``forward`` and ``backward`` are exact inverses.
    """

    def __init__(self, n: int, seed: int):
        self.n, bits = n, max(2, (max(n, 1) - 1).bit_length())
        self.low = bits - bits // 2
        self.low_mask, self.high_mask = U((1 << self.low) - 1), U((1 << (bits // 2)) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) ^ U(seed & (2**64 - 1)))

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(U))
        while (out := x >= U(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        def step(x):
            high, low = x >> U(self.low), x & self.low_mask
            for i, k in enumerate(self.keys):
                if i % 2:
                    low = low ^ (mixed(high ^ k) & self.low_mask)
                else:
                    high = high ^ (mixed(low ^ k) & self.high_mask)
            return (high << U(self.low)) | low

        return self._walk(rows, step)

    def backward(self, places: np.ndarray) -> np.ndarray:
        def step(x):
            high, low = x >> U(self.low), x & self.low_mask
            for i, k in reversed(list(enumerate(self.keys))):
                if i % 2:
                    low = low ^ (mixed(high ^ k) & self.low_mask)
                else:
                    high = high ^ (mixed(low ^ k) & self.high_mask)
            return (high << U(self.low)) | low

        return self._walk(places, step)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of global row number ``row`` among ``n``, without reading any data."""
    place = int(Permutation(n, seed).forward(np.array([row]))[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number that lies at a slot of a shard; the inverse of ``locate``."""
    return int(Permutation(n, seed).backward(np.array([slot * shards + shard]))[0])


def place(row: Column, n: int, seed: int) -> Column:
    """The shuffled place of a row number."""

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).forward(rows.to_numpy()))

    return permuted(row)


def shard(docs: DataFrame, order: list[str], shards: int, seed: int = 1) -> DataFrame:
    """``docs`` with ``row_number``, ``shard`` and ``slot``.

    Rows are numbered in ``order`` over the whole table, the number is permuted, and place p
    lies in shard ``p mod shards`` at slot ``p div shards``: shards differ by one row at
    most and slots have no gaps. The same rows, order and seed give the same layout.

    Nulls in ``order`` come first; rows equal in ``order`` take neighbouring numbers, so
    with all columns in ``order`` repeated rows are interchangeable. An empty table
    gives an empty result; columns of the given names are replaced.
    """
    docs = docs.drop("row_number", "shard", "slot")
    rows = numbered(docs, order, "row_number", write_table)
    n = rows.count()
    p = place(F.col("row_number"), n, seed)
    return rows.withColumn("__place", p).select(
        *rows.columns,
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.expr(f"__place div {shards}L").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
