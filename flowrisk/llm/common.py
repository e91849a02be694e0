"""Helpers shared by the operators: byte buffers of Arrow text, numpy hashing, groups out of sorted batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that its tasks share what is costly to build."""
    module = sys.modules.setdefault("_flowrisk_llm_worker", types.ModuleType("_flowrisk_llm_worker"))
    return module.__dict__.setdefault(name, {})


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(col) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, j
        i = j


def segment_ids(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words between ASCII white space, and the offsets of rows in them."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    word_offsets = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U), word_offsets
    word = np.cumsum(first) - 1
    at = np.arange(len(data)) - starts[np.maximum(word, 0)]
    at[: starts[0]] = 0
    powers = np.full(int(at.max()) + 1, 0x9E3779B97F4A7C15, U)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U)
    letter = mixed(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))[_LOWER]
    value = letter[data] * powers[at]
    value[~solid] = 0
    return mixed(np.add.reduceat(value, starts)), word_offsets


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes of ``width`` consecutive words per row, and the offsets of rows in them.

    A row with fewer words has one shingle, the whole sequence; a row without words has none.
    """
    words, rows = word_hashes(data, offsets)
    n = np.diff(rows)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    start = ranges(rows[:-1], count)
    row = segment_ids(count)
    end = rows[1:][row]
    out = np.zeros(len(start), U)
    padded = np.append(words, np.zeros(width, U))
    for k, c in enumerate(constants(width, 17)):
        part = padded[start + k]
        part[start + k >= end] = U(0x51ED270B0A1F39C1)
        out += part * c
    out = mixed(out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(n) + 1))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, as one table each, out of batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two 64-bit hashes with different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7919), text)]


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str, table) -> DataFrame:
    """``df`` with global row numbers from 0 in ``order``, in column ``name``.

    Rows are range-partitioned and sorted; a part's first number is the row count of the
    parts before it. Rows that tie in ``order`` spread over parts by a random last key, so
    ``order`` should hold all columns that matter. ``table`` writes and rereads the numbered
    parts: the numbers come from one physical sort, whatever is retried later.
    """
    part, at = f"__{name}_part", f"__{name}_at"
    cut = df.withColumn("__tie", F.rand(11)).repartitionByRange(partitions(df), *order, "__tie")
    cut = cut.sortWithinPartitions(*order).drop("__tie")
    serial = F.monotonically_increasing_id()
    kept = table(cut.withColumn(part, F.spark_partition_id()).withColumn(at, serial.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = part_offsets(sizes, part, "n", "__first")
    return kept.join(F.broadcast(offsets), part).withColumn(name, F.col("__first") + F.col(at)).drop(part, at, "__first")


def part_offsets(sizes: DataFrame, part: str, size: str, out: str) -> DataFrame:
    """Sums of ``size`` over all earlier parts: one row per task of an earlier stage, so small whatever the data."""
    from pyspark.sql import Window

    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(out))
