"""Dense algebra over the keys of a panel, in square tiles: no task holds a whole matrix, no row more than one tile.

A matrix is a table of tiles (r, c, h, m): block row and column, the height of the tile, and its values row by row. Keys are
numbered in key order; tile ``r`` has the keys ``r * TILE`` to ``r * TILE + TILE - 1``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.session import write_table

#: Keys of a tile; time steps of a block of the panel; partial products that a task holds before it hands them on.
TILE, STEPS, HELD = 256, 512, 64
#: A pivot this much smaller than its diagonal entry belongs to a column that depends on earlier ones.
DEPENDENT = 1e-12

_TILES = "r int, c int, h int, m array<double>"


def numbered(panel: DataFrame) -> DataFrame:
    """(key, k): keys numbered from 0 in key order, written; one row per key."""
    return write_table(panel.select("key").distinct().withColumn("k", (F.row_number().over(W.orderBy("key")) - 1)), "keys")


def _matrix(values: np.ndarray, h: int) -> np.ndarray:
    return np.asarray(values, float).reshape(h, -1)


def panel_blocks(panel: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """(slice, tile, and one array per column): at most ``STEPS`` or so time steps of at most ``TILE`` keys, in (ts, key) order.

    Time steps are dealt to slices by hash; the panel must be complete, so a slice has the same steps for all tiles.
    """
    steps = panel.agg(F.count_distinct("ts")).first()[0]
    slices = max(1, -(-steps // STEPS))
    rows = panel.join(keys, "key").select(
        F.pmod(F.xxhash64("ts"), F.lit(slices)).cast("int").alias("slice"), (F.col("k") / TILE).cast("int").alias("tile"), F.struct("ts", "k", *cols).alias("s")
    )
    sorted_rows = rows.groupBy("slice", "tile").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def values(c: str) -> Column:
        return F.transform("s", lambda x: x[c]).alias(c)

    return sorted_rows.select("slice", "tile", *map(values, cols))


def products(panel: DataFrame, keys: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(i, j, p0, p1, ...): for every ordered pair of keys the sums over time of ``left_i * right_j``, for each (left, right) of ``pairs``.

    Blocks of the panel meet block by block; a task adds up what it has of a pair of tiles before it leaves.
    """
    n = keys.count()
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    blocks = write_table(panel_blocks(panel, keys, *cols), "panel-blocks")
    left = blocks.select("slice", F.col("tile").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = blocks.select("slice", F.col("tile").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for (a, b), sums in held.items():
                i, j = np.indices(sums[0].shape)
                yield pd.DataFrame({"i": a * TILE + i.ravel(), "j": b * TILE + j.ravel()} | {f"p{x}": s.ravel() for x, s in enumerate(sums)})

        for pdf in batches:
            for r in pdf.to_dict("records"):
                a, b = r["a"], r["b"]
                wide = {s: min(TILE, n - t * TILE) for s, t in (("a", a), ("b", b))}
                x = {(s, c): np.asarray(r[f"{s}_{c}"], float).reshape(-1, wide[s]) for s in "ab" for c in cols}
                sums = [x["a", p].T @ x["b", q] for p, q in pairs]
                old = held.get((a, b))
                held[a, b] = sums if old is None else [o + s for o, s in zip(old, sums, strict=True)]
                if len(held) > HELD:
                    yield from rows()
                    held.clear()
        yield from rows()

    names = [f"p{x}" for x in range(len(pairs))]
    parts = left.join(right, "slice").mapInPandas(multiplied, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    by = lambda side: keys.select(F.col("key").alias(f"key_{side}"), F.col("k").alias(side))
    named = sums.join(by("i"), "i").join(by("j"), "j")
    return named.select(F.col("key_i").alias("i"), F.col("key_j").alias("j"), *names)


def tiles(entries: DataFrame, value: str) -> DataFrame:
    """Tiles of the full matrix ``entries(ki, kj, value)`` given by key numbers."""
    at = lambda k: (F.col(k) / TILE).cast("int")
    rows = entries.select(at("ki").alias("r"), at("kj").alias("c"), F.struct("ki", "kj", F.col(value).alias("v")).alias("s"))
    packed = rows.groupBy("r", "c").agg(F.array_sort(F.collect_list("s")).alias("s"), F.count_distinct("s.ki").cast("int").alias("h"))
    return packed.select("r", "c", "h", F.transform("s", lambda x: x["v"]).alias("m"))


def entries(matrix: DataFrame) -> DataFrame:
    """(ki, kj, value) of all tiles."""
    rows = matrix.select("r", "c", "h", (F.size("m") / F.col("h")).cast("int").alias("w"), F.posexplode("m").alias("at", "value"))
    return rows.select(
        (F.col("r") * TILE + (F.col("at") / F.col("w")).cast("int")).alias("ki"), (F.col("c") * TILE + F.col("at") % F.col("w")).alias("kj"), "value"
    )


def _mapped(pairs: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles ``f(x, y)`` of rows (r, c, xh, x, yh, y)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [f(_matrix(p.x, p.xh), _matrix(p.y, p.yh)) for p in pdf.itertuples(index=False)]
            yield pd.DataFrame({"r": pdf["r"], "c": pdf["c"], "h": [len(m) for m in out], "m": [m.ravel() for m in out]})

    return pairs.select("r", "c", "xh", "x", "yh", "y").mapInPandas(work, _TILES)


def _added(parts: DataFrame) -> DataFrame:
    """Tiles of equal place added up; a place has one part per block of the inner dimension."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["m"].iloc[0].copy()
        for m in pdf["m"].iloc[1:]:
            total += m
        return pd.DataFrame({"r": pdf["r"].iloc[:1], "c": pdf["c"].iloc[:1], "h": pdf["h"].iloc[:1], "m": [total]})

    return parts.groupBy("r", "c").applyInPandas(add, _TILES)


def multiplied(x: DataFrame, y: DataFrame, transpose: str = "") -> DataFrame:
    """``x y`` tile by tile; ``transpose`` names the factors that are transposed first ("x", "y")."""
    xo, xi = ("c", "r") if "x" in transpose else ("r", "c")
    yi, yo = ("c", "r") if "y" in transpose else ("r", "c")
    left = x.select(F.col(xo).alias("r"), F.col(xi).alias("inner"), F.col("h").alias("xh"), F.col("m").alias("x"))
    right = y.select(F.col(yi).alias("inner"), F.col(yo).alias("c"), F.col("h").alias("yh"), F.col("m").alias("y"))
    turn = lambda m, side: m.T if side in transpose else m
    return _added(_mapped(left.join(right, "inner"), lambda a, b: turn(a, "x") @ turn(b, "y")))


def _pivot(m: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of the Cholesky factor of ``m`` with zero rows for the columns that depend on earlier ones, and which those are."""
    n = len(m)
    rest, lower, gone = m.copy(), np.zeros_like(m), np.zeros(n, bool)
    for j in range(n):
        if rest[j, j] <= DEPENDENT * diagonal[j]:
            gone[j] = True
            continue
        lower[j:, j] = rest[j:, j] / np.sqrt(rest[j, j])
        rest[j + 1 :, j + 1 :] -= np.outer(lower[j + 1 :, j], lower[j + 1 :, j])
    lower[gone] = 0.0
    lower[gone, gone] = 1.0
    inverse = np.linalg.inv(lower)
    inverse[gone] = 0.0
    return inverse, gone


def eliminated(matrix: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(upper factor, inverse of the lower factor, dependent columns) of a symmetric positive semidefinite matrix of ``size`` keys.

    Block elimination of [matrix | identity]: per round the rows of one block are scaled by the inverse of their pivot's
    factor and taken out of all later blocks, one product per tile. The result of every round is written.
    """
    blocks = -(-size // TILE)
    spark = matrix.sparkSession
    matrix = write_table(matrix, "tiles")
    diagonal = write_table(entries(matrix.where("r = c")).where("ki = kj").groupBy((F.col("ki") / TILE).cast("int").alias("r")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ki", "value"))), lambda s: s["value"]).alias("d")
    ), "diagonal")
    one = spark.range(blocks).select(
        F.col("id").cast("int").alias("r"), (F.col("id") + blocks).cast("int").alias("c"), F.least(F.lit(TILE), F.lit(size) - F.col("id") * TILE).cast("int").alias("h")
    ).withColumn("m", F.flatten(F.transform(F.sequence(F.lit(1), F.col("h")), lambda i: F.transform(
        F.sequence(F.lit(1), F.col("h")), lambda j: F.when(i == j, 1.0).otherwise(0.0)))))
    rest = write_table(matrix.where("c >= r").unionByName(one), "tiles")
    scaled_rows, gone_rows = [], []

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                inverse, gone = _pivot(_matrix(p.m, p.h), np.asarray(p.d))
                yield pd.DataFrame({"r": [p.r], "xh": [p.h], "x": [inverse.ravel()], "gone": [np.flatnonzero(gone).tolist()]})

    for k in range(blocks):
        own = rest.where(F.col("r") == k)
        pivot = own.where(F.col("c") == k).join(diagonal, "r").select("r", "h", "m", "d")
        pivot = write_table(pivot.mapInPandas(invert, "r int, xh int, x array<double>, gone array<int>"), "pivot")
        gone_rows.append(pivot.select("r", F.explode("gone").alias("at")))
        factor = F.broadcast(pivot.drop("gone"))  # one tile
        scaled = write_table(_mapped(own.withColumnsRenamed({"h": "yh", "m": "y"}).join(factor, "r"), lambda x, y: x @ y), "tiles")
        scaled_rows.append(scaled)
        if k + 1 == blocks:
            break
        left = scaled.where((F.col("c") > k) & (F.col("c") < blocks)).select(F.col("c").alias("r"), F.col("r").alias("inner"), F.col("h").alias("xh"), F.col("m").alias("x"))
        right = scaled.where(F.col("c") > k).select(F.col("r").alias("inner"), "c", F.col("h").alias("yh"), F.col("m").alias("y"))
        update = _mapped(left.join(right, "inner").where("c >= r"), lambda x, y: -(x.T @ y))
        rest = write_table(_added(rest.where(F.col("r") > k).unionByName(update)), "tiles")
    rows, gone = scaled_rows[0], gone_rows[0]
    for more, dependent in zip(scaled_rows[1:], gone_rows[1:], strict=True):
        rows, gone = rows.unionByName(more), gone.unionByName(dependent)
    return rows.where(F.col("c") < blocks), rows.where(F.col("c") >= blocks).withColumn("c", F.col("c") - blocks), gone


def pseudo_inverse(matrix: DataFrame, size: int) -> DataFrame:
    """Tiles of the Moore-Penrose inverse of a symmetric positive semidefinite matrix.

    Without dependent columns it is the product of the inverted factors. Otherwise, with L of full rank such that the matrix is
    L L', it is (L Q) (L Q)' for Q the inverse of L' L.
    """
    upper, inverse, gone = eliminated(matrix, size)
    if gone.isEmpty():
        return multiplied(inverse, inverse, "x")
    gone = gone.groupBy("r").agg(F.collect_set("at").alias("gone"))
    square = multiplied(upper, upper, "y").join(gone, "r", "left")
    unit = F.transform("m", lambda v, i: F.when(
        (F.col("r") == F.col("c")) & (i % (F.col("h") + 1) == 0) & F.coalesce(F.array_contains("gone", (i / (F.col("h") + 1)).cast("int")), F.lit(False)), 1.0
    ).otherwise(v))
    _, half, _ = eliminated(square.select("r", "c", "h", unit.alias("m")), size)
    root = write_table(multiplied(upper, multiplied(half, half, "x"), "x"), "tiles")
    return multiplied(root, root, "y")


def column_sums(panel: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per key of a panel: the number of rows ``n`` and the given sums."""
    return panel.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(name) for name, x in sums.items()])
