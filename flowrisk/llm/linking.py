"""From table keys to links to components, without listing the pairs of a group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.session import write_table

#: Members of a block; two blocks of a cluster meet in one tile, which is one piece of work for a task.
TILE = 256


def clusters(keyed: DataFrame, key: str, member: str) -> DataFrame:
    """``rep``, ``member``: who shares a key with whom, through the smallest member of each key.

    All members of a key are in the cluster of its smallest member, so every pair that shares a
    key shares a cluster. The many keys that a group of similar rows has in common mostly have the same smallest
    member and fall together. Keys with one member drop out. Both aggregations combine on the map side; a
    hot key's rows meet its one aggregate row, written before, in a join that AQE can split.
    """
    shared = keyed.groupBy(key).agg(F.min(member).alias("rep"), F.max(member).alias("last")).filter("rep < last")
    shared = write_table(shared, "shared-keys")
    return keyed.join(shared.select(key, "rep"), key).select("rep", F.col(member).alias("member")).distinct()


def tiles(clustered: DataFrame, tile: int = TILE) -> DataFrame:
    """``rep``, ``lo``, ``hi``, ``block``, ``member``: clusters cut into blocks, one tile per pair of blocks.

    A cluster of n members has n / tile blocks, dealt by hash; each member goes to every tile of
    its block. So a tile holds about two blocks at most, however large the cluster.
    """
    sizes = write_table(clustered.groupBy("rep").agg(F.count("*").alias("n")), "cluster-sizes")
    sized = clustered.join(sizes, "rep").withColumn("blocks", F.ceil(F.col("n") / tile).cast("int"))
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "rep", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "member"
    )


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect what the links a-b connect among ``n`` members."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node``, ``component``: the smallest node that each node of the links reaches.

    Links are turned into stars around ever smaller centres (large-star, then small-star) until
    nothing changes. A node's links are never gathered: its smallest neighbour is an aggregate, which
    its links meet in a join. Each round is written to the shared folder.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """Links (x, y), y < x, after each node has sent its smallest neighbour to its larger (or smaller) ones."""
        if larger:
            both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        else:
            both = pairs
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        met = both.join(least, "x")
        if larger:
            sent = met.filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        else:
            sent = met.select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(least.select("x", F.col("m").alias("y")))
        return sent.filter("y < x").distinct()

    pairs = edges.select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).filter("y < x").distinct()
    pairs = write_table(pairs, "links")
    mark = _mark(pairs)
    while True:
        pairs = write_table(star(star(pairs, True), False), "links")
        new = _mark(pairs)
        if new == mark:
            break
        mark = new
    return pairs.select(F.col("x").alias("node"), F.col("y").alias("component")).unionAll(
        pairs.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )


def _mark(pairs: DataFrame) -> tuple:
    """Stands for a set of links: equal sets have equal marks, and unequal ones practically never."""
    total: Column = F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))
    return tuple(pairs.agg(F.count("*"), total).first())
