"""Audit of sources: how far the term shares of a source are from those of every other source and of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowrisk.llm.common import partitions, ranges
from flowrisk.session import write_table

#: A term is kept if it occurs in so many documents of its language.
LEAST_DOCS = 10
#: Shares are integers of this unit; every term counts as seen SMOOTH times more.
UNIT, SMOOTH = 1_000_000_000, 2
#: Ranks of terms that are reported.
TOP_TERMS = 10
#: Posting steps of a group that are worked on at once.
STEPS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Runs of letters a-z and of characters beyond ASCII, only A-Z lower-cased."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x60\x7B-\x7F]+"), "")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), exact; null where nothing is kept."""
    over = F.nullif((total + kept * SMOOTH).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    whole = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return (F.call_function("div", whole, over) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares; null if one is null."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it); one row of null term per group at least.

    A document's terms are followed by its distinct ones in one list, so one pass adds up both, and partial sums leave a task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), terms(text).alias("t"))
    rows = rows.select("lang", "source", F.size("t").alias("size"), F.concat("t", F.array_distinct("t")).alias("t"))
    rows = rows.select("lang", "source", "size", F.posexplode_outer("t").alias("at", "term"))
    first = (F.col("at") < F.col("size")).cast("long")
    return rows.groupBy("lang", "source", "term").agg(
        F.coalesce(F.sum(first), F.lit(0)).alias("n"), F.coalesce(F.sum(1 - first), F.lit(0)).alias("docs")
    )


def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row accumulation over term-major rows (``lang``, ``postings`` of source, share and zero share).

    Every group (lang, source) goes through the postings of its own terms and adds, into a dense array over its peers, what a term that both have
    differs by from the value that the zero baselines give it. Half of the pairs is enough, as the value is symmetric; one row per pair of groups leaves a batch.
    """
    for batch in batches:
        postings = batch.column(1)
        flat = postings.flatten()
        if not len(flat):
            continue
        lens = np.array(postings.value_lengths())
        lang = np.repeat(np.arange(batch.num_rows), lens)
        langs, lang_code = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        names, name_code = np.unique(flat.field(0).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        key = lang_code[lang] * len(names) + name_code
        groups, group = np.unique(key, return_inverse=True)
        p, zero = flat.field(1).to_numpy(), flat.field(2).to_numpy()
        order = np.lexsort((group, lang))  # within a term by group, so that the peers after a posting have larger numbers
        group, p, zero = group[order], p[order], zero[order]
        end = np.repeat(np.cumsum(lens), lens)
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(groups) + 1))
        out_u, out_v, out_n = [], [], []
        for g in range(len(groups)):
            accumulator, seen = np.zeros(len(groups), np.int64), np.zeros(len(groups), bool)
            own = by_group[starts[g] : starts[g + 1]]
            after = end[own] - own - 1
            cuts = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + STEPS, STEPS)[1:], side="right")
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                mine = np.repeat(own[a:b], after[a:b])
                peer = ranges(own[a:b] + 1, after[a:b])
                delta = _gap(p[mine], p[peer]) - _gap(p[mine], zero[peer]) - _gap(zero[mine], p[peer]) + _gap(zero[mine], zero[peer])
                np.add.at(accumulator, group[peer], delta)
                seen[group[peer]] = True
            peers = np.flatnonzero(seen)
            out_u.append(np.full(len(peers), g))
            out_v.append(peers)
            out_n.append(accumulator[peers])
        u, v = groups[np.concatenate(out_u)], groups[np.concatenate(out_v)]
        yield pa.RecordBatch.from_arrays([
            pa.array(langs[u // len(names)], pa.string()), pa.array(names[u % len(names)], pa.string()),
            pa.array(names[v % len(names)], pa.string()), pa.array(np.concatenate(out_n)),
        ], names=["lang", "source", "peer", "delta"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` of every (lang, source) group of ``docs``.

    A language keeps the terms of at least ``least_docs`` of its documents. A group gives each kept term a smoothed integer share. Part ``pair`` compares
    a group with each other source of its language: the sum of gaps over all kept terms, 0 if there are none. Part ``term`` has the ``top`` terms that
    the group uses more than its language does. Ranks count from 1 by falling value, then by item in UTF-8 order. All arithmetic is on integers.

    Only terms that two groups share are met, through the term-major index; all others follow from each group's share of an unseen term and from its
    distinct shares with their numbers. Null text, lang and source are empty; a group without terms has pairs and no terms; an empty table gives no rows;
    repeated rows count each time. Only text, lang and source are read, so other columns cannot clash. Pairs of the sources of a language are the result itself;
    a term's postings have one entry per source.
    """
    counts = write_table(counted(docs), "term-counts")
    by_term = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = write_table(by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "total"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_total"))
    mine = write_table(counts.filter("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")
    seen = mine.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count(F.lit(1)).alias("own"))
    groups = counts.select("lang", "source").distinct().join(seen, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["group_total", "own", "v", "lang_total"])
    groups = write_table(groups.withColumn("zero", share(F.lit(0), F.col("group_total"), F.col("v"))), "groups")

    shares = mine.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_total"), F.col("v")))
    shares = shares.withColumn("q", share(F.col("total"), F.col("lang_total"), F.col("v")))
    shares = write_table(shares.select("lang", "source", "term", "p", "q", "zero"), "shares")
    index = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("postings")).filter(F.size("postings") > 1)
    index = index.select("lang", "postings").repartition(partitions(docs))
    both = index.mapInArrow(scattered, "lang string, source string, peer string, delta long")
    both = both.groupBy("lang", "source", "peer").agg(F.sum("delta").alias("delta"))
    both = write_table(both, "shared-terms")
    both = both.unionByName(both.select("lang", F.col("peer").alias("source"), F.col("source").alias("peer"), "delta"))

    peers = groups.select("lang", F.col("source").alias("peer"), F.col("zero").alias("peer_zero"), F.col("own").alias("peer_own"))
    distinct = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = distinct.join(peers, "lang").filter("source <> peer").groupBy("lang", "source", "peer").agg(
        F.sum(F.col("times") * gap(F.col("p"), F.col("peer_zero"))).alias("alone")
    )
    alone = write_table(alone, "terms-against-zero")
    back = alone.select("lang", F.col("source").alias("peer"), F.col("peer").alias("source"), F.col("alone").alias("back"))
    pairs = groups.join(peers, "lang").filter("source <> peer")
    for part in (both, alone, back):
        pairs = pairs.join(part, ["lang", "source", "peer"], "left")
    neither = (F.col("v") - F.col("own") - F.col("peer_own")) * gap(F.col("zero"), F.col("peer_zero"))
    value = sum((F.coalesce(c, F.lit(0)) for c in (F.col("alone"), F.col("back"), F.col("delta"), neither)), F.lit(0))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.unionByName(over)
