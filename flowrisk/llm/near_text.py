"""Near-duplicate texts by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import constants, mixed, partitions, shingle_hashes, slices, sorted_groups, text_buffer
from flowrisk.llm.linking import clusters, components, spanning, tiles
from flowrisk.session import write_table

SLICE_BYTES = 1 << 19
#: The keys of candidates are broadcast to the texts up to this size; beyond it texts are shuffled to them.
BROADCAST_BYTES, MEMBER_BYTES = 64 << 20, 32


@dataclass(frozen=True)
class Settings:
    """Words per shingle, and the share (in 100) of common shingles at which texts are linked.

    ``side`` partial keys of ``rows`` minhashes each are computed in two collections; every
    pair of one from each is the key of a table: ``side**2`` tables from ``2 * side * rows`` minhashes. At
    similarity s a pair meets in a table with probability (1 - (1 - s**rows)**side)**2, 0.9998 at 0.85.
    """

    width: int = 5
    percent: int = 85
    side: int = 16
    rows: int = 5


DEFAULT = Settings()


def signatures(docs: DataFrame, key: str, how: Settings = DEFAULT) -> DataFrame:
    """``key``, ``n_shingles``, ``same`` (two hashes of the set; null if empty) and ``parts`` (partial keys) per row."""
    factors = constants(2 * how.side * how.rows, 101)
    flips = constants(2 * how.side * how.rows, 202)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                sh, rows = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], how.width)
                n = np.diff(rows)
                full = np.flatnonzero(n)
                starts = rows[:-1][full]
                parts = np.zeros((2 * how.side, len(full)), np.uint64)
                same = np.zeros((2, len(full)), np.uint64)
                if len(full):
                    work = np.empty_like(sh)
                    for h, (c, f) in enumerate(zip(factors, flips, strict=True)):
                        np.bitwise_xor(sh, f, out=work)
                        np.multiply(work, c, out=work)
                        part = parts[h // how.rows]
                        part *= np.uint64(0x9E3779B97F4A7C15)
                        part += mixed(np.minimum.reduceat(work, starts))
                    same[0] = np.add.reduceat(mixed(sh), starts)
                    same[1] = np.add.reduceat(mixed(sh ^ np.uint64(0x5BD1E995)), starts)
                flat = pa.array(mixed(parts.T.reshape(-1)).view(np.int64))
                cut = np.zeros(b - a + 1, np.int32)
                cut[1:] = np.cumsum(np.where(n > 0, 2 * how.side, 0))
                same_cut = np.zeros(b - a + 1, np.int32)
                same_cut[1:] = np.cumsum(np.where(n > 0, 2, 0))
                lists = pa.ListArray.from_arrays(pa.array(cut), flat)
                sames = pa.ListArray.from_arrays(pa.array(same_cut), pa.array(same.T.reshape(-1).view(np.int64)))
                columns = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), sames, lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "same", "parts"])

    schema = "key long, n_shingles long, same array<long>, parts array<long>"
    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(sign, schema)


def table_keys(signed: DataFrame, how: Settings = DEFAULT) -> DataFrame:
    """``key``, ``table_key``: the keys of a row in all tables where both partial keys are shared with another row."""
    parts = signed.select("key", F.posexplode("parts").alias("place", "part"))
    shared = parts.groupBy("place", "part").agg(F.count("*").alias("n")).filter("n > 1").select("place", "part")
    kept = parts.join(shared, ["place", "part"]).groupBy("key").agg(F.collect_list(F.struct("place", "part")).alias("p"))
    first = F.filter("p", lambda x: x["place"] < how.side)
    second = F.filter("p", lambda x: x["place"] >= how.side)
    pairs = kept.select("key", first.alias("a"), second.alias("b")).filter("size(a) > 0 and size(b) > 0")
    pairs = pairs.select("key", F.explode("a").alias("a"), "b").select("key", "a", F.explode("b").alias("b"))
    return pairs.select("key", F.xxhash64("a.place", "a.part", "b.place", "b.part").alias("table_key"))


def shingle_sets(docs: DataFrame, key: str, width: int) -> DataFrame:
    """``key`` and ``shingles``: the sorted distinct shingle hashes as bytes."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                sh, rows = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                raw = sh.tobytes()
                sets = pa.array([raw[8 * i : 8 * j] for i, j in zip(rows[:-1], rows[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["key", "shingles"])

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(shingle, "key long, shingles binary")


def links_of_tile(members: np.ndarray, sets: list[np.ndarray], other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (spanning ones) among the sets of a tile, from exact intersections.

    ``other`` tells the two blocks of a tile apart; pairs within a block belong to that block's own tile.
    """
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    left, right = (np.flatnonzero(other == 0), np.flatnonzero(other == 1)) if other.any() and not other.all() else (np.arange(len(sets)),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        step = max(1, (8 << 20) // len(sets))
        for a in range(0, int(column[-1]) + 1, step):
            i, j = np.searchsorted(column, [a, a + step])
            has = np.zeros((len(sets), min(step, int(column[-1]) + 1 - a)), np.float32)
            has[owner[i:j], column[i:j] - a] = 1
            common += has[left] @ has[right].T
    union = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero(100 * common.astype(np.float64) >= percent * union)
    i, j = left[i], right[j]
    apart = i != j
    u, v = spanning(i[apart], j[apart], len(sets))
    return members[u], members[v]


def links(clustered: DataFrame, sets: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """``u``, ``v``: links that connect all rows of each cluster that exact similarity connects."""
    per_tile = tiles(clustered)
    work = per_tile.join(sets, per_tile["member"] == sets["key"]).drop("key")
    work = work.repartition(n_parts, "rep", "lo", "hi").sortWithinPartitions("rep", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["rep", "lo", "hi"]):
            found = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
            block = t["block"].to_numpy()
            u, v = links_of_tile(t["member"].to_numpy(), found, (block != t["lo"].to_numpy()).astype(int), percent)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return work.select("rep", "lo", "hi", "block", "member", "shingles").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", how: Settings = DEFAULT) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Two texts are linked if their shingle sets have at least ``percent`` of 100 in common; a component is what
    links connect, named by its smallest key, which is kept. Candidates come from tables keyed by
    pairs of partial minhash keys; every link is confirmed on the full sets. Equal sets are collapsed before the
    search and never compared with each other. Null, empty and blank texts have an empty set and are linked with nothing,
    so their component is their own key. Rows with a null key
    are linked with nothing and kept. Rows that repeat a key are one row. Only ``key`` and ``text`` are read.
    """
    signed = write_table(signatures(docs, key, how), "signatures")
    full = signed.filter("n_shingles > 0 and key is not null")
    same = [F.get("same", F.lit(i)).alias(f"s{i}") for i in (0, 1)]
    classes = full.groupBy(*same).agg(F.min("key").alias("rep"), F.max("key").alias("last"))
    firsts = full.join(classes.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    clustered = write_table(clusters(write_table(table_keys(firsts.select("key", "parts"), how), "table-keys"), "table_key", "key"), "clusters")
    wanted = write_table(clustered.select(F.col("member").alias(key)).distinct(), "members")
    if wanted.count() * MEMBER_BYTES <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    sets = write_table(shingle_sets(docs.select(key, "text").join(wanted, key, "left_semi"), key, how.width), "shingles")
    found = links(clustered, sets.dropDuplicates(["key"]), how.percent, partitions(docs))
    connected = components(found)
    named = classes.filter("rep < last").select("s0", "s1", "rep")
    rows = signed.select("key", "n_shingles", *same).distinct()
    rows = rows.join(named, ["s0", "s1"], "left").withColumn("rep", F.coalesce("rep", "key"))
    rows = rows.join(connected.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return rows.select(
        F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", how: Settings = DEFAULT) -> DataFrame:
    """``docs`` with the document of the smallest key of each component; rows that repeat a key stay or go together."""
    gone = near_duplicates(docs, key, how).filter("not kept").select(key)
    return docs.join(gone, key, "left_anti").select(*docs.columns)
