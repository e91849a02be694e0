"""Removal of repeated byte strings by longest-previous-factor arrays over sampled, bucketed suffixes.

A suffix array of a whole corpus has no place in one task. Every start of a ``LENGTH``-byte string is dealt to
a bucket by the string's anchor, the smallest hash among its ``GRAM``-byte substrings: equal strings have equal
anchors, so they meet in one bucket, and consecutive starts with the same anchor (a run) travel as
one fragment of text. Buckets with one run hold nothing repeated. Equal fragments are collapsed to the first of
them; where a bucket is left with different fragments, a task sorts their suffixes, and the previous and next
smaller positions in suffix order give each start its longest previous (and next) factor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import U, mixed, partitions, ranges, slices, sorted_groups, text_buffer
from flowrisk.session import write_table

#: LENGTH is at least 8, GRAM at most LENGTH.
LENGTH = 200
GRAM = 32
SLICE_BYTES = 1 << 19
CHUNK_BYTES = 1 << 20
#: A bucket with more different fragments than this is cut further, by the strings themselves.
HOT = 4096
BASE = 0x9E3779B97F4A7C15
_LETTER = mixed(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


class Hashes:
    """Polynomial hashes of all substrings of a byte array, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, BASE, U)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=U)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_LETTER[data] * powers[:n], dtype=U, out=self.sums[1:])
        self.inverse = np.full(n + 1, pow(BASE, -1, 1 << 64), U)
        self.inverse[0] = 1
        self.inverse = np.cumprod(self.inverse, dtype=U)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U) * U(BASE))


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value, the leftmost on ties, of every window of ``width`` values."""
    at = np.arange(len(x), dtype=np.int64)

    def join(shift: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(x) - shift
        right = x[shift:] < x[:n]
        return np.where(right, x[shift:], x[:n]), np.where(right, at[shift:], at[:n])

    reach = 1
    while reach * 2 <= width:
        x, at = join(reach)
        reach *= 2
    return join(width - reach)[1] if reach < width else at


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, first start in the row, number of starts, anchor and fragment hash of every run."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    anchor = sliding_argmin(grams, length - gram + 1)
    room = np.maximum(np.diff(offsets) - length + 1, 0)  # starts of each row
    row = np.repeat(np.arange(len(room)), room)
    at = ranges(offsets[:-1], room)
    place = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    return row[first], start - offsets[row[first]], n, grams[place[first]], hashes.of(start, start + n + length - 1)


def _ranks(data: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of the 8-, 16-, ... byte strings at every position, up to ``length``, by prefix doubling."""
    padded = np.append(data, np.zeros(8, np.uint8)).astype(U)
    word = np.zeros(len(data), U)
    for k in range(8):
        word = (word << U(8)) | padded[k : k + len(data)]
    out = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
    while 16 << len(out) - 1 <= length:
        last, size = out[-1], 8 << len(out) - 1
        after = np.append(last[size:] + 1, np.zeros(min(size, len(last)), np.int64))[: len(last)]
        out.append(np.unique(last * (len(last) + 2) + after, return_inverse=True)[1].astype(np.int64))
    return out


def previous_factors(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """For each start, the length (capped) of the longest factor that also begins at an earlier position.

    Suffixes are sorted, neighbours' common prefixes are read off the ranks (in steps of 8 bytes below
    ``length``, exact at ``length``), and the nearest suffixes of smaller position before and after each suffix,
    found by jumping, bring the longest earlier match.
    """
    levels = _ranks(data, length)
    last, top = len(data) - 1, 8 << len(levels) - 1
    parts = [levels[-1][starts + at] for at in (*range(0, length - top, top), length - top)]
    order = np.lexsort((position, *reversed(parts)))
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        size = 8 << level
        i, j = np.minimum(a + common, last), np.minimum(b + common, last)
        common += np.where((levels[level][i] == levels[level][j]) & (common + size <= length), size, 0)
    same = np.ones(len(a), bool)
    for p in parts:
        same &= p[order[:-1]] == p[order[1:]]
    common = np.where(same, length, np.minimum(common, length - 1))
    pos = position[order]
    before = _match_of_smaller(pos, common)
    after = _match_of_smaller(pos[::-1], common[::-1])[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _match_of_smaller(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix with the nearest earlier entry of smaller position; 0 without one."""
    n = len(pos)
    link = np.arange(-1, n - 1)
    match = np.append(0, common)
    while True:
        i = np.flatnonzero((link >= 0) & (pos[np.maximum(link, 0)] > pos))
        if not len(i):
            break
        j = link[i]
        match[i] = np.minimum(match[i], match[j])
        link[i] = link[j]
    return np.where(link >= 0, match, 0)


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def fragment_repeats(fragments: list[bytes], key: np.ndarray, start: np.ndarray, length: int):
    """Fragment number, first and last + 1 start, and whether an earlier (else: a later) equal string exists."""
    size = np.array([len(f) for f in fragments])
    data = np.frombuffer(b"".join(fragments), np.uint8)
    offsets = np.append(0, np.cumsum(size))
    n = size - length + 1
    at = ranges(offsets[:-1], n)
    owner = np.repeat(np.arange(len(n)), n)
    inner = ranges(np.zeros(len(n), np.int64), n)
    value = Hashes(data).grams(length)[at]
    order = np.argsort(value, kind="stable")
    twin = np.zeros(len(at), bool)
    equal = value[order][1:] == value[order][:-1]
    twin[order[1:]] |= equal
    twin[order[:-1]] |= equal
    if not twin.any():
        return [], [], [], []
    used = np.zeros(len(size), bool)  # suffixes of fragments without any repeated string stay out
    used[owner[twin]] = True
    shift = np.cumsum(np.where(used, 0, size)) - np.where(used, 0, size)
    compact = data[np.repeat(used, size)]
    starts = at[twin] - shift[owner[twin]]
    position = np.empty(len(starts), np.int64)
    position[np.lexsort((start[owner[twin]] + inner[twin], key[owner[twin]]))] = np.arange(len(starts))
    out: tuple[list, ...] = ([], [], [], [])
    for earlier in (True, False):
        factor = previous_factors(compact, starts, position if earlier else -position, length)
        flags = np.zeros(len(at), bool)
        flags[np.flatnonzero(twin)[factor >= length]] = True
        for f in np.unique(owner[flags]):
            lo = int(offsets[f]) - f * (length - 1)  # starts of fragment f in ``flags``
            a, b = _intervals(flags[lo : lo + int(n[f])])
            out[0].extend([f] * len(a))
            out[1].extend(a.tolist())
            out[2].extend(b.tolist())
            out[3].extend([earlier] * len(a))
    return out


def _identified(docs: DataFrame, key: str) -> DataFrame:
    """``key``, ``mark`` (24 bits of the text, to tell rows of equal keys apart) and ``text``."""
    text = F.coalesce("text", F.lit(""))
    mark = F.pmod(F.xxhash64(text), F.lit(1 << 24))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), mark.alias("mark"), text.alias("text"))


def _all_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            key, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(offsets, SLICE_BYTES):
                row, lo, n, anchor, content = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram)
                place = (mark[a:b][row] << 38) | lo
                columns = [anchor.view(np.int64), content.view(np.int64), key[a:b][row], place, n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "key", "place", "n"])

    return rows.filter(F.octet_length("text") >= length).mapInArrow(cut, "anchor long, content long, key long, place long, n int")


def _fragments(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """The wanted fragments of each text; in a hot bucket, its strings as hashes instead."""
    schema = "anchor long, content long, key long, lo long, base int, fragment binary, w0 long, w1 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                hashes = None
                for w in wanted:
                    lo, n = w["lo"], w["n"]
                    if w["m"] <= hot:
                        rows = [(0, raw[lo : lo + n + length - 1], None, None)]
                    else:
                        if hashes is None:
                            hashes = Hashes(np.frombuffer(raw, np.uint8)).grams(length)
                        w0 = hashes[lo : lo + n]
                        w1 = [int.from_bytes(hashlib.blake2b(raw[s : s + length], digest_size=8).digest(), "little", signed=True) for s in range(lo, lo + n)]
                        rows = [(i, None, x, y) for i, (x, y) in enumerate(zip(w0.view(np.int64).tolist(), w1, strict=True))]
                    for base, fragment, x, y in rows:
                        for col, v in zip(out, (w["anchor"], w["content"], key, lo, base, fragment, x, y), strict=True):
                            col.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return texts.select("key", "text", "wanted").mapInArrow(cut, schema)


def _factors(fragments: DataFrame, length: int, n_parts: int) -> DataFrame:
    schema = "anchor long, content long, a int, b int, earlier boolean"

    def solve(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        f, a, b, earlier = fragment_repeats(t["fragment"].to_pylist(), t["key"].to_numpy(), t["lo"].to_numpy(), length)
        f = np.array(f, np.int64)
        columns = [pa.array(t[c].to_numpy()[f]) for c in ("anchor", "content")]
        columns += [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(earlier, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "a", "b", "earlier"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for t in sorted_groups(batches, ["anchor"]):
            held.append(t)
            size += t.nbytes
            if size >= CHUNK_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    own = fragments.filter("fragment is not null").select("anchor", "content", "key", "lo", "fragment")
    return own.repartition(n_parts, "anchor").sortWithinPartitions("anchor").mapInArrow(search, schema)


def repeated(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``key``, ``mark``, ``starts``: where strings of ``length`` bytes begin that begin elsewhere too.

    ``starts`` is a list of (a, b, earlier): an equal string of each start in [a, b) exists at an earlier position
    (row order by key, then offset) or, with ``earlier`` false, at a later one. Rows without any have no row here.
    """
    rows = _identified(docs, key)
    n_parts = partitions(docs)
    all_runs = write_table(_all_runs(rows, length, gram), "runs")
    shared = write_table(all_runs.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "anchors")
    met = write_table(all_runs.join(shared, "anchor"), "runs-met")
    classes = met.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("key", "place", "n")).alias("first"))
    classes = write_table(classes, "run-classes")
    several = write_table(classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "mixed-anchors")
    lo = F.col("first.place").bitwiseAND(F.lit((1 << 38) - 1))
    wanted = classes.join(several, "anchor").select(
        F.col("first.key").alias("key"), F.shiftright("first.place", 38).alias("mark"),
        F.struct(lo.alias("lo"), F.col("first.n").alias("n"), "anchor", "content", "m").alias("w"),
    ).groupBy("key", "mark").agg(F.collect_list("w").alias("wanted"))
    texts = rows.join(wanted, ["key", "mark"])
    fragments = write_table(_fragments(texts, length, hot), "fragments")
    found = _factors(fragments, length, n_parts)
    strings = fragments.filter("fragment is null").withColumn("at", F.struct("key", F.expr("lo + base")))
    ends = strings.groupBy("w0", "w1").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high")
    strings = strings.join(ends, ["w0", "w1"]).select(
        "anchor", "content", F.col("base").alias("a"), (F.col("base") + 1).alias("b"),
        F.explode(F.array_compact(F.array(F.when(F.expr("low < at"), F.lit(True)), F.when(F.expr("at < high"), F.lit(False))))).alias("earlier"),
    )
    inside = found.unionByName(strings).groupBy("anchor", "content").agg(F.collect_set(F.struct("a", "b", "earlier")).alias("inside"))
    known = classes.join(inside, ["anchor", "content"], "left").filter("c > 1 or inside is not null")
    known = known.select("anchor", "content", "c", "first", F.coalesce("inside", F.array().cast("array<struct<a:int,b:int,earlier:boolean>>")).alias("inside"))
    hit = met.join(known, ["anchor", "content"])
    begin = F.col("place").bitwiseAND(F.lit((1 << 38) - 1))
    whole = lambda e: F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(e).alias("earlier"))
    is_first = F.struct("key", "place", "n") == F.col("first")
    copies = F.when(F.col("c") == 1, F.array().cast("array<struct<a:int,b:int,earlier:boolean>>")).when(
        is_first, F.array(whole(False))
    ).otherwise(F.array(whole(True)))
    ranges_ = F.transform(F.concat("inside", copies), lambda r: F.struct(
        (begin + r["a"]).alias("a"), (begin + r["b"]).alias("b"), r["earlier"].alias("earlier")
    ))
    hit = hit.select("key", F.shiftright("place", 38).alias("mark"), F.explode(ranges_).alias("r"))
    return hit.groupBy("key", "mark").agg(F.collect_set("r").alias("starts"))


def merged(starts: list[dict], length: int, earlier_only: bool) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    spans: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + length - 1) for s in starts if s["earlier"] or not earlier_only):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def without_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, keep_first: bool = True, **settings: int) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (removed, as start and end) and ``kept`` (the other bytes) for every row.

    Texts are UTF-8 bytes. With ``keep_first`` each byte goes that is covered by a string of ``length`` bytes with
    an earlier copy, so the first copy of everything stays; otherwise copies go in all places. Strings are judged on the input
    and never cross rows; a string may repeat within one text and overlap itself.

    Null is an empty text; texts below ``length`` stay whole. Rows are ordered by key, null first; equal keys with equal texts are
    copies without an order among them and lose the same bytes. Only ``key`` and ``text`` are read. An empty table gives an empty result.
    """
    found = repeated(docs, key, length, **settings)
    rows = _identified(docs, key).join(found, ["key", "mark"], "left")
    schema = f"`{key}` long, n_bytes long, spans array<array<long>>, kept binary"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, text, starts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                spans = merged(starts or [], length, keep_first)
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for col, v in zip(out, (None if k == -(1 << 63) else k, len(raw), spans, kept), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[key, "n_bytes", "spans", "kept"])

    return rows.select("key", "text", "starts").mapInArrow(remove, schema)


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: bytes, removed bytes and runs, and the SHA-256 of what is left."""
    size: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return removed.select(key, "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
