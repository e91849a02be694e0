"""Benchmark passages in training text by spaced seeds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import text_key
from flowrisk.session import write_table

#: Positions of a window of words that a seed looks at; the others may differ.
MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 5, 7))
SPAN = 8
#: An overlap is a stretch of this many words of an item (all of a shorter item) of which MATCHED in 100 agree in place.
STRETCH, MATCHED = 12, 80
#: Seeds are broadcast up to this size; each takes SEED_BYTES.
BROADCAST_BYTES, SEED_BYTES = 64 << 20, 48


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def _masked(h: Column, mask: tuple[int, ...], number: int, span: int) -> Column:
    """The seed of every window of ``span`` words; seeds of different masks differ."""
    places = F.when(F.size(h) >= span, F.sequence(F.lit(0), F.size(h) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(number), *[F.get(h, i + k) for k in mask]))


def _spaced(h: Column) -> list[Column]:
    return [_masked(h, m, n, SPAN) for n, m in enumerate(MASKS)]


def _whole(h: Column, size: int) -> Column:
    """Windows of ``size`` words with no free place, for items below the span."""
    return _masked(h, tuple(range(size)), 100 + size, size)


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Pairs of a document and a benchmark item that overlap: key, item, at, matched, item_words.

    Windows of ``SPAN`` words are hashed under each mask, on both sides; equal seeds propose to lay
    the item over the document so that the windows coincide. A pair counts if in some such position
    a stretch of ``STRETCH`` words of the item (the whole item if it is shorter) agrees with
    the document in at least ``MATCHED`` of 100 places; words outside the document do not agree.
    Per pair the position with most agreeing words is given (``at``: document word below the item's first,
    the smallest one on ties).

    Items shorter than a window are looked up as a whole; items and documents without words have
    no overlap, null is empty. Rows of equal key (null included) give one row per item. Only ``key``, ``item`` and ``text`` are read, so other columns cannot clash.
    """
    k1, k2 = text_key(F.coalesce("text", F.lit("")))
    items = benchmark.select(F.col(item).alias("item"), _hashed(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = write_table(items, "benchmark-words")
    short = [r[0] for r in items.filter(F.size("w") < SPAN).select(F.size("w")).distinct().collect()]  # below SPAN values
    by_size = F.when(F.size("w") >= SPAN, F.array(*_spaced(F.col("w"))))
    for k in short:
        by_size = by_size.when(F.size("w") == k, F.array(_whole(F.col("w"), k)))
    seeds = items.select("item", F.explode(by_size).alias("s")).select("item", F.posexplode("s").alias("item_at", "seed"))
    seeds = write_table(seeds, "benchmark-seeds")
    small = seeds.count() * SEED_BYTES <= BROADCAST_BYTES

    hashed = docs.select(k1.alias("k1"), k2.alias("k2"), _hashed(F.col("text")).alias("w"))
    windows = hashed.select("k1", "k2", F.explode(F.array(*_spaced(F.col("w")), *[_whole(F.col("w"), k) for k in short])).alias("s"))
    windows = windows.select("k1", "k2", F.posexplode("s").alias("doc_at", "seed"))
    hits = windows.join(F.broadcast(seeds) if small else seeds, "seed")
    laid = hits.select("k1", "k2", "item", (F.col("doc_at") - F.col("item_at")).alias("at")).distinct()
    laid = laid.groupBy("k1", "k2", "item").agg(F.collect_list("at").alias("laid"))
    laid = write_table(laid, "benchmark-hits")

    # One row per text and item, written: the text is hashed once, however many positions there are to verify.
    texts = docs.select(F.col(key).alias("key"), k1.alias("k1"), k2.alias("k2"), "text").join(laid, ["k1", "k2"])
    pairs = texts.join(items, "item").select("key", "item", "laid", "w", _hashed(F.col("text")).alias("d"), F.size("w").alias("item_words"))
    pairs = write_table(pairs, "benchmark-pairs")
    wide = F.least(F.lit(STRETCH), F.col("item_words"))

    def verified(at: Column) -> Column:
        agree = F.transform("w", lambda x, i: F.when(x == F.get("d", at + i), 1).otherwise(0))
        total = F.aggregate(agree, F.lit(0), lambda a, x: a + x)
        return F.struct(total.alias("matched"), (-at).alias("at"), agree.alias("agree"))

    def enough(v: Column) -> Column:
        best = F.array_max(F.transform(
            F.sequence(F.lit(0), F.col("item_words") - wide),
            lambda i: F.aggregate(F.slice(v["agree"], i + 1, wide), F.lit(0), lambda a, x: a + x),
        ))
        return (v["matched"] * 100 >= wide * MATCHED) & (best * 100 >= wide * MATCHED)

    good = F.transform(F.filter(F.transform("laid", verified), enough), lambda v: F.struct(v["matched"].alias("matched"), v["at"].alias("at")))
    found = pairs.select("key", "item", "item_words", F.array_max(good).alias("top")).filter("top is not null")
    top = F.max(F.struct("top.matched", "top.at", "item_words"))
    return found.groupBy("key", "item").agg(top.alias("t")).select(
        F.col("key").alias(key), F.col("item").alias(item), (-F.col("t.at")).alias("at"), "t.matched", "t.item_words"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the documents that overlap with any item."""
    return overlaps(docs, benchmark, key).select(key).distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that overlap with an item; documents with a null key stay."""
    return docs.join(contaminated(docs, benchmark, key), key, "left_anti").select(*docs.columns)
