"""Near-duplicate vectors by lattice hashing: random projections decoded to points of E8, and their neighbours."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import mixed, partitions, sorted_groups
from flowrisk.llm.linking import clusters, components, spanning, tiles
from flowrisk.session import write_table

TILE = 1024


@dataclass(frozen=True)
class Settings:
    """``tables`` projections to 8 dimensions, scaled by ``scale``; the ``probes`` nearest neighbouring cells are searched too.

    At cosine 0.98 unit vectors differ by 0.2; a table finds such a pair with probability 0.87, six tables with 0.999995.
    """

    cosine: float = 0.98
    tables: int = 6
    probes: int = 4
    scale: float = 1.0
    seed: int = 8


DEFAULT = Settings()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if the sum is odd round the worst coordinate the other way."""
    point = np.rint(x)
    rest = x - point
    worst = np.abs(rest).argmax(axis=1)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    w = worst[odd]
    point[odd, w] += np.where(rest[odd, w] >= 0, 1.0, -1.0)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: even-sum integers, or the same shifted by a half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def shortest_vectors() -> np.ndarray:
    """The 240 vectors from a point of E8 to its neighbours."""
    out = [s * np.eye(8)[i] + t * np.eye(8)[j] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = shortest_vectors()


def _cell_keys(cells: np.ndarray, salt: np.ndarray) -> np.ndarray:
    out = salt.copy()
    for d in range(8):
        out = mixed(out ^ (np.rint(2 * cells[..., d]).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return out


def lattice_keys(vectors: np.ndarray, salt: np.ndarray, how: Settings) -> np.ndarray:
    """Keys of each vector: per table its own cell and the nearest neighbouring ones; equal only for equal ``salt``."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    keys = []
    for t in range(how.tables):
        projection = np.random.default_rng([how.seed, t, vectors.shape[1]]).normal(size=(vectors.shape[1], 8)) * how.scale
        y = unit @ projection
        home = nearest_point(y)
        own = mixed(salt ^ np.uint64(t + 1))
        keys.append(_cell_keys(home, own)[:, None])
        if how.probes:
            toward = (y - home) @ NEIGHBOURS.T - 0.5 * (NEIGHBOURS**2).sum(axis=1)
            near = np.argpartition(-toward, how.probes, axis=1)[:, : how.probes]
            cells = home[:, None, :] + NEIGHBOURS[near]
            keys.append(_cell_keys(cells, np.repeat(own[:, None], how.probes, axis=1)))
    return np.concatenate(keys, axis=1)


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), size)


def _keyed(firsts: DataFrame, how: Settings) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(2).value_lengths())
            for size in np.unique(sizes):
                i = pa.array(np.flatnonzero(sizes == size))
                salt = mixed(batch.column(1).take(i).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(int(size) << 32))
                keys = lattice_keys(_matrix(batch.column(2).take(i), int(size)), salt, how)
                member = np.repeat(batch.column(0).take(i).to_numpy(), keys.shape[1])
                columns = [pa.array(member), pa.array(keys.reshape(-1).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["member", "cell"])

    return firsts.select("rep", "label", "embedding").mapInArrow(hashed, "member long, cell long")


def links_of_tile(unit: np.ndarray, weight: np.ndarray, other: np.ndarray, reps: np.ndarray, rep: int, cosine: float):
    """Spanning links of a tile, and per member the weight of the members it is linked with.

    ``reps`` has the clusters of each member in a row. A pair that shares several clusters counts in the smallest one.
    """
    two = bool(other.any() and not other.all())
    left, right = (np.flatnonzero(other == 0), np.flatnonzero(other == 1)) if two else (np.arange(len(unit)),) * 2
    n = np.zeros(len(unit), np.int64)
    us, vs = [], []
    rows = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), rows):
        some = left[a : a + rows]
        i, j = np.nonzero(unit[some] @ unit[right].T >= cosine)
        i, j = some[i], right[j]
        keep = i != j if two else i < j
        i, j = i[keep], j[keep]
        us.append(i)
        vs.append(j)
        step = max(1, (1 << 22) // (reps.shape[1] ** 2 + 1))
        for b in range(0, len(i), step):
            p, q = i[b : b + step], j[b : b + step]
            own = reps[p]
            common = (own[:, :, None] == reps[q][:, None, :]).any(axis=2) & (own >= np.iinfo(np.int64).min + 1)
            first = np.where(common, own, np.iinfo(np.int64).max).min(axis=1) == rep
            np.add.at(n, p[first], weight[q[first]])
            np.add.at(n, q[first], weight[p[first]])
    u, v = spanning(np.concatenate(us), np.concatenate(vs), len(unit))
    return u, v, n


def near_duplicates(vectors: DataFrame, how: Settings = DEFAULT) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Vectors of equal, non-null ``label`` and equal size are linked if their cosine in double precision reaches
    ``how.cosine``; a component is what links connect, named by its smallest ``vec_id``. Candidates share a cell of
    the lattice in some table; every link is confirmed. Equal vectors of a label are compared once and count as linked with each other.
    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do rows with a null
    label or id: n_links 0, their own component, kept. Other columns are not read.
    """
    parts = F.coalesce(F.col("embedding"), F.array().cast("array<double>"))
    finite = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    usable = finite & F.exists(parts, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    h = [F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(7919), F.col("embedding")).alias("h1")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).select("*", *h)
    good = rows.filter("usable")
    classes = write_table(good.groupBy("label", "h0", "h1").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    firsts = good.join(classes, ["label", "h0", "h1"]).filter("vec_id = rep").dropDuplicates(["label", "h0", "h1"])
    firsts = write_table(firsts.select("rep", "label", "embedding", "n"), "vectors")
    clustered = write_table(clusters(write_table(_keyed(firsts, how), "cells"), "cell", "member"), "vector-clusters")
    of = clustered.groupBy("member").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    payload = firsts.join(of, firsts["rep"] == of["member"]).select("member", "label", "embedding", "n", "reps")
    work = tiles(clustered, TILE).join(payload, "member").select("rep", "lo", "hi", "block", "member", "label", "embedding", "n", "reps")
    work = work.repartition(partitions(vectors), "rep", "lo", "hi").sortWithinPartitions("rep", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["rep", "lo", "hi"]):
            t = t.combine_chunks()
            own = t["reps"].combine_chunks()
            sizes = np.array(own.value_lengths())
            reps = np.full((len(sizes), sizes.max()), np.iinfo(np.int64).min)
            reps[np.arange(sizes.max())[None, :] < sizes[:, None]] = own.flatten().to_numpy()
            embedding = t["embedding"].combine_chunks()
            x = _matrix(embedding, len(embedding[0]))
            x /= np.linalg.norm(x, axis=1)[:, None]
            other = (t["block"].to_numpy() != t["lo"].to_numpy()).astype(int)
            u, v, n = links_of_tile(x, t["n"].to_numpy(), other, reps, t["rep"][0].as_py(), how.cosine)
            member, linked = t["member"].to_numpy(), np.flatnonzero(n)
            columns = [np.append(member[u], member[linked]), np.append(member[v], np.full(len(linked), -1)), np.append(np.zeros(len(u), np.int64), n[linked])]
            kinds = np.append(np.zeros(len(u), bool), np.ones(len(linked), bool))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(kinds)], names=["u", "v", "n", "counts"])

    found = write_table(work.mapInArrow(compare, "u long, v long, n long, counts boolean"), "vector-links")
    degree = found.filter("counts").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    connected = components(found.filter("not counts")).withColumnRenamed("node", "rep")
    named = classes.join(degree, "rep", "left").join(connected, "rep", "left")
    named = named.select("label", "h0", "h1", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    keys = [F.when(F.col("usable"), F.col(c)).alias(c) for c in ("label", "h0", "h1")]
    out = rows.select("vec_id", *keys).join(named, ["label", "h0", "h1"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
